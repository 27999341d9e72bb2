"""B: telemetry of calls, one row per run or per run and tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _outcome(flag: str) -> list[Column]:
    n, clean = F.count(flag), F.count_if(~F.col(flag))
    out = F.when(n == 0, "missing").when(clean == n, "success").when(clean == 0, "error").otherwise("mixed")
    return [n.alias("n_results"), out.alias("outcome")]


def call_outcome(results: DataFrame, call: list[str], flag: str = "is_error") -> DataFrame:
    """Missing without results (null flag), success if all are clean, error if none is, else mixed."""
    return results.groupBy(*call).agg(*_outcome(flag))


def call_flags(results: DataFrame, call: list[str], flags: str = "flags") -> DataFrame:
    """Outcome of each call by the error flags (B02) of its results, and which kinds of flags any of them has.

    A call without a result has one row with null flags. is_error: the flag of
    that name; content_error: any other.
    """
    f = F.col(flags)
    marked = results.withColumns({"__bad": F.when(f.isNotNull(), F.size(f) > 0), "__said": F.array_contains(f, "is_error"), "__other": F.size(F.array_remove(f, "is_error")) > 0})
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return marked.groupBy(*call).agg(*_outcome("__bad"), any_of("__said").alias("is_error"), any_of("__other").alias("content_error"))


def tool_breakdown(outcomes: DataFrame, by: list[str], also: dict[str, str] | None = None) -> DataFrame:
    """Calls, their four outcomes, and results; ``also`` names counts of calls for which a boolean column holds."""
    kinds = [F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in ("success", "error", "mixed", "missing")]
    more = [F.count_if(c).alias(name) for name, c in (also or {}).items()]
    return outcomes.groupBy(*by).agg(F.count("*").alias("calls"), *kinds, F.sum("n_results").alias("n_results"), *more)


def identical_calls(calls: DataFrame, by: list[str], signature: list[str]) -> DataFrame:
    """Distinct signatures and calls beyond the first of each."""
    per = calls.groupBy(*by, *[c for c in signature if c not in by]).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.count("*").alias("signatures"), F.sum(F.col("n") - 1).alias("repeats"))


def surfaces(calls: DataFrame, by: list[str], family: str, clean: str) -> DataFrame:
    """Families attempted and families that returned without an error, with their names."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    good = F.when(F.col(clean), F.col(family))
    return calls.groupBy(*by).agg(F.count_distinct(family).alias("attempted"), F.count_distinct(good).alias("returned"), names(F.col(family)).alias("attempted_names"), names(good).alias("returned_names"))


def recipients(asks: DataFrame, by: list[str], recipient: str, outcome: str | None = None) -> DataFrame:
    """Attempts and distinct recipients (nulls are none); with the column ``outcome`` (B03) also attempts by outcome, mixed ones in the total only."""
    kinds = [F.count_if(F.col(outcome) == k).alias(f"n_{k}") for k in ("success", "error", "missing")] if outcome else []
    return asks.groupBy(*by).agg(F.count("*").alias("attempts"), *kinds, F.count_distinct(recipient).alias("recipients"), F.array_join(F.array_sort(F.collect_set(recipient)), ",").alias("names"))


def dynamic_messages(exposures: DataFrame, by: list[str], message: str, prefix: str) -> DataFrame:
    """Occurrences, unique ids, repeats, and unique ids of three kinds and the rest."""
    kinds = ("notification", "answer", "question")
    counts = [F.count_distinct(F.when(F.col(prefix) == k, F.col(message))).alias(f"n_{k}") for k in kinds]
    out = exposures.groupBy(*by).agg(F.count("*").alias("occurrences"), F.count_distinct(message).alias("unique_ids"), *counts)
    return out.withColumn("repeats", F.col("occurrences") - F.col("unique_ids")).withColumn("n_other", F.col("unique_ids") - F.col("n_notification") - F.col("n_answer") - F.col("n_question"))


def api_retries(events: DataFrame, by: list[str], uuid: str, delay: str, order: str) -> DataFrame:
    """Retries raw and unique by uuid (the first one's delay counts), known delays summed, missing ones counted."""
    first = events.groupBy(*by, uuid).agg(F.count("*").alias("n"), F.min_by(delay, order).alias("delay"))
    known = F.when(F.col("delay") >= 0, F.col("delay"))
    return first.groupBy(*by).agg(F.sum("n").alias("raw"), F.count("*").alias("unique_events"), F.sum(known).alias("delay"), F.count_if(known.isNull()).alias("no_delay"))


def retry_status(retries: DataFrame, runs: DataFrame, by: list[str], reported: str) -> DataFrame:
    """Each run's raw count of retries (0 without any) against the count that its status reports; a missing report does not match."""
    raw = F.coalesce("raw", F.lit(0))
    return runs.select(*by, reported).join(retries.select(*by, "raw"), by, "left").select(*by, raw.alias("raw"), reported, raw.eqNullSafe(F.col(reported)).alias("matches"))


def message_usage(observations: DataFrame, by: list[str], message: str, fields: list[str]) -> DataFrame:
    """The largest value of each field per message, summed; a lower bound."""
    per = observations.groupBy(*by, message).agg(F.count("*").alias("n"), *[F.max(f).alias(f) for f in fields])
    return per.groupBy(*by).agg(F.count("*").alias("messages"), F.sum(F.col("n") - 1).alias("duplicates"), *[F.sum(f).alias(f) for f in fields])


def usage_crosscheck(usage: DataFrame, saved: DataFrame, by: list[str], field: str) -> DataFrame:
    """Does the sum equal the saved figure; null where none was saved."""
    s = saved.select(*by, F.col(field).alias("saved"))
    return usage.select(*by, field).join(s, by, "left").select(*by, field, "saved", F.when(F.col("saved").isNotNull(), F.col("saved") == F.col(field)).alias("agrees"))


def run_invariants(counts: DataFrame, by: list[str], total: str, parts: list[str]) -> DataFrame:
    """Rows whose parts do not add up to their total (empty if all is well)."""
    added = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return counts.where(added != F.col(total)).select(*by, F.col(total).alias("total"), added.alias("added"))


def telemetry_totals(t: DataFrame, cols: list[str], gap: str) -> DataFrame:
    """Column totals over runs and how many runs have a gap."""
    return t.agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in cols], F.count_if(F.col(gap)).alias("gap_runs"))


def gap_rows(t: DataFrame, key: list[str], gaps: dict[str, str]) -> DataFrame:
    """A row for each run and gap that it has; gaps are SQL conditions by name."""
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in gaps.items()]))
    return t.select(*key, F.explode(found).alias("gap"))
