"""A: event logs to canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def select_runs(index: DataFrame, scores: DataFrame, by: list[str], same: list[str]) -> DataFrame:
    """Selected index rows grouped per run and joined to scores; consistent tells whether ``same`` agree."""
    agree = F.count_distinct(F.struct(*same)) == 1
    runs = index.where("selected").groupBy(*by).agg(F.count("*").alias("attempts"), agree.alias("consistent"))
    return runs.join(scores, by)


def drop_heartbeats(events: DataFrame, heartbeat: Column, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The other events, and the number of heartbeats per group."""
    return events.where(~heartbeat), events.where(heartbeat).groupBy(*by).agg(F.count("*").alias("heartbeats"))


def sequence_events(events: DataFrame, by: list[str], order: list[str], init: Column) -> DataFrame:
    """Physical sequence number, and number of session starts so far."""
    along = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("sequence", F.row_number().over(along)).withColumn("init_segment", F.sum(init.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def replay_flags(events: DataFrame, by: list[str], key: list[str], order: list[str], event: str) -> DataFrame:
    """The first event with the same key; null for that event itself. Nothing is dropped."""
    first = F.first(event).over(Window.partitionBy(*by, *key).orderBy(*order))
    return events.withColumn("replay_of", F.when(first != F.col(event), first))


def extract_calls(sightings: DataFrame, call: list[str], order: list[str], content: list[str]) -> DataFrame:
    """One action per id: its first sighting, later ones counted as replays, conflicting if their content differs."""
    along, whole = Window.partitionBy(*call).orderBy(*order), Window.partitionBy(*call)
    # one sort serves all of it: aggregates of the sorted rows would each hold a table of all calls beside it
    said = F.struct(*content)
    seen = sightings.select(*call, *content, F.row_number().over(along).alias("__rn"), (F.count("*").over(whole) - 1).alias("replays"), (~F.min(said).over(whole).eqNullSafe(F.max(said).over(whole))).alias("conflicting"))
    return seen.where("__rn = 1").drop("__rn")


def _whole(along: WindowSpec) -> WindowSpec:
    """All rows of a partition in the order of another window, so that one sort serves both."""
    return along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def pair_results(calls: DataFrame, results: DataFrame, call: list[str], at: str) -> DataFrame:
    """Results with their call, in order: result, repeat_result or orphan (before its call, or without one).

    calls: one row per call. Results and calls stand in one order per id, so one sort serves and no join is needed.
    """
    begun = calls.dropna(subset=call).select(*call, F.col(at).alias("call_at"), F.lit(True).alias("__call"))
    along = Window.partitionBy(*call).orderBy(at)
    both = results.unionByName(begun, allowMissingColumns=True).withColumn("call_at", F.min("call_at").over(_whole(along)))
    after = F.coalesce(F.col(at) > F.col("call_at"), F.lit(False))
    no = F.count_if(after).over(along.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("status", F.when(~after, "orphan").when(no > 1, "repeat_result").otherwise("result"))
    return found.where("__call is null").drop("__call")


def missing_results(calls: DataFrame, results: DataFrame, call: list[str], at: str) -> DataFrame:
    """The ids of calls without any result after the first call of theirs; one aggregate over both, no join."""
    said = calls.select(*call, F.col(at).alias("__first"), F.lit(None).cast(results.schema[at].dataType).alias("__last"), F.lit(True).alias("__call"))
    back = results.dropna(subset=call).select(*call, F.lit(None).cast(calls.schema[at].dataType).alias("__first"), F.col(at).alias("__last"), F.lit(False).alias("__call"))
    both = said.unionByName(back).groupBy(*call).agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.bool_or("__call").alias("__call"))
    return both.where(F.col("__call") & ~F.coalesce(F.col("__last") > F.col("__first"), F.lit(False))).select(*call)


def later_calls(calls: DataFrame, results: DataFrame, call: list[str], order: list[str], action: str) -> DataFrame:
    """Results that came before any call of theirs, with the next call of the same id, null where none follows.

    calls: call, order, action. results: call, order and what names them. A
    call at the very place of a result does not follow it; of several calls at
    one place the smallest action counts. Calls and results stand in one order
    per id, so no range join is needed, and that order is backwards, so that
    the next call is the last one seen.
    """
    names = [c for c in results.columns if c not in (*call, *order)]
    both = results.withColumn("__action", F.lit(None).cast(calls.schema[action].dataType)).withColumn("__call", F.lit(0))
    said = calls.select(*call, *order, *[F.lit(None).cast(results.schema[c].dataType).alias(c) for c in names], F.col(action).alias("__action"), F.lit(-1).alias("__call"))
    along = Window.partitionBy(*call).orderBy(*[F.desc(c) for c in (*order, "__call", "__action")])
    upto, is_call = along.rowsBetween(Window.unboundedPreceding, 0), F.col("__call") == -1
    calls_before = F.count_if(is_call).over(_whole(along)) - F.count_if(is_call).over(upto)
    following = F.last("__action", ignorenulls=True).over(upto)
    out = both.unionByName(said).withColumn("__before", calls_before).withColumn("matching_later_call", following)
    return out.where("__call = 0 and __before = 0").select(*call, *order, *names, "matching_later_call")


def message_exposures(results: DataFrame, by: list[str], message: str, order: list[str]) -> DataFrame:
    """A10: ordinal of each exposure of a message, first flag, and the first one's place."""
    along = Window.partitionBy(*by, message).orderBy(*order)
    return results.withColumn("exposure", F.row_number().over(along)).withColumn("first_exposure", F.col("exposure") == 1).withColumn("first_at", F.first(order[0]).over(along))


def faults(events: DataFrame, results: DataFrame, retry: Column, failed: Column, keep: list[str]) -> DataFrame:
    """Retry events and failed results in one table."""
    return events.where(retry).select(*keep, F.lit("event").alias("kind")).unionByName(results.where(failed).select(*keep, F.lit("result").alias("kind")))


def audit_coverage(raw: DataFrame, evidence: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys missing on a side or with another digest (empty if both match one to one)."""
    a, b = raw.select(*key, F.col(digest).alias("raw_digest")), evidence.select(*key, F.col(digest).alias("evidence_digest"))
    kind = F.when(F.col("evidence_digest").isNull(), "missing").when(F.col("raw_digest").isNull(), "extra").when(F.col("raw_digest") != F.col("evidence_digest"), "differs")
    return a.join(b, key, "full_outer").withColumn("problem", kind).where("problem is not null").select(*key, "problem")


def audit_pointers(refs: DataFrame, blocks: DataFrame, place: list[str], ident: str) -> DataFrame:
    """References that point at nothing, or at a block with another id."""
    b = blocks.select(*place, F.col(ident).alias("__there"))
    return refs.join(b, place, "left").where(~F.col("__there").eqNullSafe(F.col(ident))).select(*place, ident)


def prep_summary(expected: DataFrame, found: DataFrame, by: list[str], size: str) -> DataFrame:
    """Expected, ready and missing runs, and what the ready ones hold."""
    got = found.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(size).alias("size"))
    return expected.select(*by).distinct().join(got, by, "left").agg(F.count("*").alias("expected"), F.count("rows").alias("ready"), F.count_if(F.col("rows").isNull()).alias("missing"), F.sum("rows").alias("rows"), F.sum("size").alias("size"))


def observability(runs: DataFrame, source: DataFrame, by: list[str], reason: str) -> DataFrame:
    """Observed, or why the source of a run cannot be audited."""
    there = source.select(*by).distinct().withColumn("__there", F.lit(True))
    return runs.select(*by).join(there, by, "left").select(*by, F.when(F.col("__there"), "observed").otherwise(reason).alias("state"))
