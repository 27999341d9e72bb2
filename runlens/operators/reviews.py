"""B, C, D, F, H, J, K: result flags, usage reports, evidence labels, review and diagnosis tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Prefixes, states and keys of the recorded formats.
EXCEPTION_PREFIXES = ("RuntimeError:", "Traceback (most recent call last):")
FAILED_STATES = ("error", "failed", "failure")
EMPTY_ERRORS = ("", "false", "[]", "{}", "0")
CLASS_KEYS = ("classification", "failureKind", "failure_reason_code", "failure_class", "failure_kind", "category", "kind_of_failure", "failure_category", "error_class", "failure_type", "reason_code", "class")
REASON_KEYS = ("reason", "failure_reason", "error_kind")
MESSAGE_KEYS = ("message", "detail", "reason", "output_tail", "tail", "stderr", "stdout", "output", "error", "trace")
GENERIC_LABELS = ("failed", "fail", "failure", "error", "false", "f2p", "p2p", "passed", "pass", "true", "ok")
LABEL_PATTERN = "^[A-Za-z][A-Za-z0-9_-]{2,60}$"

PAYLOAD = "isError boolean, is_error boolean, success boolean, ok boolean, error string, status string, exit_code bigint"


def error_flags(results: DataFrame, payloads: str, text: str, is_error: str, terminal: Column) -> DataFrame:
    """``results`` and ``flags``, the sorted names of the signs of failure that hold.

    payloads: array of JSON objects as text. A field of another type counts as
    absent; an error counts unless it is null, false, 0 or empty.
    """
    p = F.transform(payloads, lambda x: F.from_json(x, PAYLOAD))
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda test: F.exists(p, lambda x: yes(test(x)))
    starts = reduce(Column.__or__, [F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith(e) for e in EXCEPTION_PREFIXES])
    signs = {
        "is_error": F.col(is_error),
        "structured_is_error": has(lambda x: yes(x["isError"]) | yes(x["is_error"])),
        "structured_false_success": has(lambda x: yes(~x["success"]) | yes(~x["ok"])),
        "structured_error": has(lambda x: ~x["error"].isin(*EMPTY_ERRORS)),
        "structured_failed_status": has(lambda x: x["status"].isin(*FAILED_STATES)),
        "terminal_nonzero_exit": terminal & has(lambda x: x["exit_code"] != 0),
        "transport_exception_prefix": starts,
    }
    return results.withColumn("flags", F.array_compact(F.array(*[F.when(signs[n], F.lit(n)) for n in sorted(signs)])))


def result_usage(reports: DataFrame, key: list[str], order: list[str], totals: list[str], models: str) -> DataFrame:
    """The first report of each key, and whether every total equals the sum over its models; reports are never added.

    models: array of structs with the fields ``totals``; without models, or with a null total, it doesn't match.
    """
    first = reports.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")
    summed = lambda c: F.aggregate(models, F.lit(0).cast("bigint"), lambda acc, m: acc + F.coalesce(m[c], F.lit(0)))
    same = [F.coalesce(F.col(c) == summed(c), F.lit(False)) for c in totals]
    return first.withColumn("matches", reduce(Column.__and__, same, F.coalesce(F.size(models) > 0, F.lit(False))))


def phase_usage(events: DataFrame, by: list[str], digest: list[str], usage: str) -> DataFrame:
    """Per usage key the phases that report it and their sum, null (not 0) where none does; identical events count once."""
    phases = events.dropDuplicates([*by, *digest]).select(*by, F.explode(usage).alias("usage_key", "value"))
    return phases.groupBy(*by, "usage_key").agg(F.count("value").alias("reporting"), F.sum("value").alias("total"))


#: Levels of nested usage that are read.
USAGE_DEPTH = 8


def flat_usage(usage: Column) -> Column:
    """The numbers of usage given as JSON, by their keys joined with dots; other values are left out, and so is what lies deeper than USAGE_DEPTH."""
    entries = F.map_entries(F.from_json(usage, "map<string,string>"))

    def opened(e: Column) -> Column:
        inner = F.map_entries(F.from_json(e["value"], "map<string,string>"))
        named = F.transform(inner, lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(e["value"].startswith("{"), F.coalesce(named, F.array().cast("array<struct<key:string,value:string>>"))).otherwise(F.array(e))

    for _ in range(USAGE_DEPTH - 1):
        entries = F.flatten(F.transform(entries, opened))
    numbers = F.filter(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: e["value"].rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"))
    return F.map_from_entries(F.transform(numbers, lambda e: F.struct(e["key"], e["value"].cast("double"))))


def usage_by_event(events: DataFrame, by: list[str], digest: list[str], phases: str, usage: str, needed: tuple[str, ...] = ("input_tokens", "output_tokens")) -> DataFrame:
    """Per event, identical ones once: its phases, those that report all ``needed`` keys, and whether the sums of its phases equal its own usage.

    phases: an array of JSON usages; usage: the event's own. An event without
    phases matches nothing: null.
    """
    of = events.dropDuplicates([*by, *digest]).select(*by, *digest, F.coalesce(F.transform(phases, flat_usage), F.array().cast("array<map<string,double>>")).alias("__phases"), flat_usage(F.col(usage)).alias("__own"))
    keys = F.array_distinct(F.flatten(F.transform("__phases", F.map_keys)))
    total = F.transform(keys, lambda k: F.struct(k.alias("key"), F.aggregate("__phases", F.lit(0.0), lambda a, p: a + F.coalesce(p[k], F.lit(0.0))).alias("value")))
    own = F.transform(F.map_entries("__own"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    whole = F.filter("__phases", lambda p: F.size(F.array_intersect(F.map_keys(p), F.array(*map(F.lit, needed)))) == len(needed))
    n = F.size("__phases")
    return of.select(*by, *digest, n.alias("phases"), F.size(whole).alias("with_needed"), F.when(n > 0, F.array_sort(total) == F.array_sort(own)).alias("matches"))


def compact_index(rows: DataFrame, by: list[str], order: list[str], nested: str) -> DataFrame:
    """The scalars of a row, the fields of one struct as columns, and the row's line in its file."""
    inner = [F.col(f"{nested}.{f}").alias(f"{nested}_{f}") for f in rows.select(f"{nested}.*").columns]
    kept = [c for c in rows.columns if c != nested]
    return rows.select(*kept, *inner, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("line"))


def failure_label(record: Column, status: Column) -> Column:
    """The first text that reads as an identifier and isn't generic: nested ``extra`` (two deep), class keys, reasons, raw status."""
    keys = [*CLASS_KEYS, *REASON_KEYS]
    once = lambda c, then: F.transform(F.array(c), then)[0]  # noqa: E731  (``then`` of a value that is read once)
    named = lambda c: c.rlike(LABEL_PATTERN) & ~F.lower(c).isin(*GENERIC_LABELS)
    told = lambda m: F.try_element_at(F.filter(F.transform(F.array(*map(F.lit, keys)), lambda k: m[k]), named), F.lit(1))
    texts = "map<string,string>"
    inner, middle, top = F.from_json(record, f"extra struct<extra:{texts}>")["extra"]["extra"], F.from_json(record, f"extra {texts}")["extra"], F.from_json(record, texts)
    found = F.coalesce(*[once(m, told) for m in (inner, middle, top)])
    return F.coalesce(found, F.when(named(status), status), F.lit(""))


def failure_message(record: Column, tail: int = 4000) -> Column:
    """The ends of the record's message texts, one below the other; values that aren't texts are left out."""

    entries = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    ends = lambda m: F.transform(F.array(*map(F.lit, MESSAGE_KEYS)), lambda k: F.right(said(m[k]), F.lit(tail)))
    # the record is parsed once, and the object inside it read once
    of = lambda top: F.transform(F.array(entries(top["extra"])), lambda inner: F.array_join(F.concat(ends(top), F.array(said(top["outcome"]), said(top["extra"])), F.coalesce(ends(inner), F.array().cast("array<string>"))), "\n"))[0]
    return F.coalesce(F.transform(F.array(entries(F.try_parse_json(record))), of)[0], F.lit(""))


def evidence_source(runs: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """An accepted recovery folder that exists, else the original one that exists, else raw.

    runs: by, accepted, recovery, original. files: by, dir.
    """
    there = files.groupBy(*by).agg(F.collect_set("dir").alias("dirs"))  # the folders of one run
    has = lambda c: F.coalesce(F.array_contains("dirs", F.col(c)), F.lit(False))
    chosen = F.when(F.col("accepted") & has("recovery"), "recovery").when(has("original"), "original").otherwise("raw")
    return runs.join(there, by, "left").select(*by, chosen.alias("source"))


def last_goal_summary(actions: DataFrame, by: list[str], order: list[str], complete: Column, text: str) -> DataFrame:
    """the sentences of the last completed goal's summary; a null summary is empty and has none."""
    last = actions.where(complete).groupBy(*by).agg(F.max_by(F.coalesce(text, F.lit("")), F.struct(*order)).alias("t"))
    return last.select(*by, F.posexplode(F.split("t", r"[.!?\n]+\s*")).alias("place", "sentence")).where(F.trim("sentence") != "")


def review_tables(reports: DataFrame, by: list[str], episodes: str, lensed: tuple[str, ...]) -> DataFrame:
    """One row per episode of a report, with its evidence joined; the lens stands only for the kinds that have one."""
    flat = reports.select(*by, F.inline(episodes))
    lens = F.when(F.col("kind").isin(*lensed), F.col("lens"))
    return flat.select(*by, "episode", "kind", lens.alias("lens"), F.array_join("evidence", ",").alias("evidence"), F.size("evidence").alias("n_evidence"))


def stopping_table(stops: DataFrame, by: list[str]) -> DataFrame:
    """How a run ended, whether too early, and how many known items it left; null items are 0."""
    return stops.select(*by, "ending", "premature", F.coalesce(F.size("items"), F.lit(0)).alias("unresolved"))


def stopping_stats(stops: DataFrame, runs: DataFrame, losses: DataFrame, by: list[str]) -> DataFrame:
    """Per ending and label the runs, median hours left, items left (sum, median), mean rate, and share of losses at the ask.

    runs: by, hours_left, rate. losses: by, stage.
    """
    lost = losses.groupBy(*by).agg(F.count("*").alias("lost"), F.count_if(F.col("stage") == "ask").alias("at_ask"))
    j = stops.join(runs, by, "left").join(lost, by, "left")
    return j.groupBy("ending", "premature").agg(
        F.count("*").alias("n"), F.median("hours_left").alias("hours_left"), F.sum("unresolved").alias("unresolved"), F.median("unresolved").alias("median_unresolved"),
        F.avg("rate").alias("rate"), F.try_divide(F.sum("at_ask"), F.sum("lost")).alias("ask_share"),
    )


def diagnosis_context(reqs: DataFrame, nodes: DataFrame, by: list[str], req: str) -> DataFrame:
    """Per run one JSON document of its requirements, each with its nodes, both in order.

    reqs: by, req and further scalars. nodes: by, req, node, status.
    """
    own = nodes.groupBy(*by, req).agg(F.array_sort(F.collect_list(F.struct("node", "status"))).alias("nodes"))
    fields = [c for c in reqs.columns if c not in (*by, req)]
    j = reqs.join(own, [*by, req], "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<struct<node:bigint,status:string>>")))
    doc = F.array_sort(F.collect_list(F.struct(req, *fields, "nodes")))
    return j.groupBy(*by).agg(F.count("*").alias("requirements"), F.to_json(doc).alias("document"))


def diagnosis_tables(reports: DataFrame, by: list[str], diagnoses: str) -> DataFrame:
    """One row per diagnosed requirement, its chain of steps as one text joined with arrows."""
    flat = reports.select(*by, F.inline(diagnoses))
    chain = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("["), s["phase"], F.lit("] "), s["description"])), " → ")
    return flat.withColumn("chain", chain).drop("steps")


def dimension_ranking(dims: DataFrame, top: int = 3) -> DataFrame:
    """Three lists over the dimensions: significant ones by rho, the ``top`` with most scores of 3, the lowest mean with its modal score.

    dims: dimension, rho, significant, n0 to n3: one row per dimension, of which a rubric has a few.
    """
    scores = F.array(*[F.struct(F.col(f"n{s}").alias("n"), F.lit(-s).alias("less")) for s in range(4)])
    rated = reduce(Column.__add__, [F.col(f"n{s}") for s in range(4)])
    mean = F.try_divide(reduce(Column.__add__, [F.col(f"n{s}") * s for s in range(4)]), rated)
    none = F.lit(None).cast("int")
    place = lambda *order: F.row_number().over(Window.orderBy(*order, "dimension"))
    strong = dims.where("significant").select(F.lit("significant").alias("list"), place(F.desc("rho")).alias("place"), "dimension", F.col("rho").alias("value"), none.alias("modal"))
    best = dims.select(F.lit("most_3").alias("list"), place(F.desc("n3")).alias("place"), "dimension", F.col("n3").cast("double").alias("value"), none.alias("modal")).where(F.col("place") <= top)
    low = dims.select(F.lit("lowest_mean").alias("list"), place(F.asc_nulls_last(mean)).alias("place"), "dimension", mean.alias("value"), (-F.array_max(scores)["less"]).alias("modal")).where("place = 1")
    return strong.unionByName(best).unionByName(low)


def review_detail(episodes: DataFrame, phases: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """Counts of episode kinds, of phase tags (comma-joined, blanks dropped) and of issues by category and severity, each with its runs."""
    tags = phases.select(*by, F.explode(F.split("tags", ",")).alias("name")).where("name <> ''")
    parts = {"episode": episodes.withColumnRenamed("kind", "name"), "phase": tags, "issue": issues.withColumnRenamed("category", "name")}
    rows = [d.select(F.lit(n).alias("of"), "name", F.col("severity") if n == "issue" else F.lit("").alias("severity"), F.struct(*by).alias("run")) for n, d in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("of", "name", "severity").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))


def run_index(summary: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """The short row of each run: its key, some columns, and the rate as text."""
    rate = F.concat(F.col("f2p_passed").cast("string"), F.lit("/"), F.col("f2p_total").cast("string"))
    return summary.select(*by, *cols, rate.alias("f2p"))


def sidecar_log(events: DataFrame, by: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Events in order, each as JSON of the given fields that aren't null or empty."""
    kept = [F.when(F.col(f).cast("string") != "", F.col(f)).alias(f) for f in fields]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return events.select(*by, place.alias("place"), F.to_json(F.struct(*kept)).alias("event"))


def envelopes(results: DataFrame, key: list[str], content: str) -> DataFrame:
    """The JSON objects that a result's content is, or that its text is wholly, or that its text blocks are; free text is not searched.

    content: JSON text. Content that isn't JSON, or holds no object, gives no row.
    """
    is_a = lambda c, kind: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith(kind), F.lit(False))
    blocks = F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda b: b["type"] == "text")
    found = (
        F.when(is_a(F.col(content), "OBJECT"), F.array(content))
        .when(is_a(F.col(content), "STRING"), F.array(F.variant_get(F.try_parse_json(content), "$", "string")))
        .when(is_a(F.col(content), "ARRAY"), F.transform(blocks, lambda b: b["text"]))
    )
    return results.select(*key, F.posexplode(F.filter(found, lambda x: is_a(x, "OBJECT"))).alias("place", "payload"))


def visible_messages(exposures: DataFrame, actions: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """Each message body that a tool returned, with the tool and the time it was seen, numbered by line, then pointer.

    exposures: by, message, action, line, pointer and further columns. actions:
    by, action, tool. events: by, line, observed. Both have at most one row for
    each key; a tool or a time that isn't recorded is null.
    """
    order = Window.partitionBy(*by, "message").orderBy("line", "pointer")
    j = exposures.join(actions.select(*by, "action", "tool"), [*by, "action"], "left").join(events.select(*by, "line", "observed"), [*by, "line"], "left")
    return j.withColumn("exposure", F.row_number().over(order)).withColumn("first", F.col("exposure") == 1)


def claim_stats(claims: DataFrame, nodes: DataFrame, by: list[str], req: str) -> DataFrame:
    """One row on the claims whose delivery is known: failed ones by claim, silent shares per run, kinds of silent failure.

    claims: by, req, claim, delivered. nodes: by, req, status, failure_class. A
    failed requirement that is claimed done is silent; its kind is functional
    if a node failed so, build_or_load if all failed to build or load, else other.
    """
    classes = nodes.where("status = 'failed'").groupBy(*by, req).agg(F.collect_set("failure_class").alias("classes"))  # of a short taxonomy
    built = F.array(F.lit("solver_runtime_or_load_error"), F.lit("solver_compile_error"))
    none = F.coalesce(F.size("classes"), F.lit(0)) == 0
    kind = F.when(~none & F.array_contains("classes", "functional_failed"), "functional").when(~none & (F.size(F.array_except("classes", built)) == 0), "build_or_load").otherwise("other")
    known = claims.where("delivered is not null").join(classes, [*by, req], "left")
    done, failed = F.col("claim") == "claimed_done", ~F.col("delivered")
    silent = done & failed
    per_run = known.groupBy(*by).agg(
        F.count("*").alias("scored"), F.count_if(done).alias("claimed_done"), F.count_if(failed).alias("failed"), F.count_if(silent).alias("silent"),
        F.count_if(failed & (F.col("claim") == "claimed_partial_or_open")).alias("listed_open"), *[F.count_if(silent & (kind == k)).alias(k) for k in ("functional", "build_or_load", "other")],
    )
    share = F.try_divide("silent", "failed")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scored", "claimed_done", "failed", "silent", "listed_open", "functional", "build_or_load", "other")]
    return per_run.agg(*sums, F.count_if(F.col("failed") > 0).alias("runs_with_failures"), F.median(share).alias("median_silent_share"), F.count_if(share > 0).alias("runs_silent"), F.count_if(share >= 0.5).alias("runs_half_silent"))


def reviewer_usage(records: DataFrame, by: list[str], response: str, seq: list[str], usage: list[str]) -> DataFrame:
    """Requests, responses, those with usage, and the sums of the ``usage`` columns per run.

    A response has several snapshots; the last one that reports any usage
    counts as a whole, what it leaves out as 0. A record without a response id
    counts as a request only. Without any usage a run's sums are null.
    """
    reports = reduce(Column.__or__, [F.col(c).isNotNull() for c in usage])
    told = F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in usage])
    last = F.max_by(told, F.when(reports, F.struct(*seq))).alias("last")
    per = records.groupBy(*by, response).agg(F.count("*").alias("n"), last)
    known = F.col(response).isNotNull()
    sums = [F.sum(F.when(known, F.col(f"last.{c}"))).alias(c) for c in usage]
    return per.groupBy(*by).agg(F.sum("n").alias("requests"), F.count(response).alias("responses"), F.count_if(known & F.col("last").isNotNull()).alias("with_usage"), *sums)
