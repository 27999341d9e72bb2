"""What claims add up to, ratios of linked events, documents for diagnoses, strata, short rows of runs and of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.operators.relational import exact_quantiles, ranked

DONE = "claimed_done"


def exclusive_quartiles(df: DataFrame, value: str) -> DataFrame:
    """p25 and p75 in one row, at the places (n + 1) / 4 and 3 (n + 1) / 4 of the sorted values; one value is both, none gives nulls.

    The places are found by counts of smaller values, so no task holds all values.
    """
    rows = ranked(df, [], value)
    total = F.col("total")
    place = lambda i: F.least(F.greatest(F.floor(i * (total + 1) / 4), F.lit(1)), F.greatest(total - 1, F.lit(1)))
    at = lambda p: F.max(F.when((F.col("below") < p) & (p <= F.col("below") + F.col("n")), F.col(value)))
    parts = [c for i in (1, 3) for c in (at(place(i)).alias(f"low{i}"), at(place(i) + 1).alias(f"high{i}"), F.max((i * (total + 1) - 4 * place(i)) / 4).alias(f"part{i}"))]
    between = lambda i: F.col(f"low{i}") + F.coalesce(F.col(f"high{i}") - F.col(f"low{i}"), F.lit(0)) * F.col(f"part{i}")
    return rows.agg(*parts).select(between(1).alias("p25"), between(3).alias("p75"))


def claim_runs(claims: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """per run the failed requirements, those of them claimed done and their share, claims of done and the failed ones.

    claims: by, claim, delivered (null: not known, left out).
    """
    known = claims.where("delivered is not null")
    done, failed = F.col("claim") == DONE, ~F.col("delivered")
    per = known.groupBy(*by).agg(F.count_if(failed).alias("failed"), F.count_if(failed & done).alias("silent"), F.count_if(done).alias("claimed_done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.select(*by).join(per, by, "left").select(*by, zero("failed"), zero("silent"), F.try_divide("silent", "failed").alias("silent_share"), zero("claimed_done"))


def claim_totals(claims: DataFrame, per_run: DataFrame) -> DataFrame:
    """one row: requirements, those with a known delivery, silent share of the failed, failed share of the claims of done,
    requirements listed as open, runs with a failed requirement, and median and quartiles of their silent shares.

    claims: claim, delivered, listed_as_open. per_run: of ``claim_runs``.
    """
    failed, done = F.col("delivered") == False, F.col("claim") == DONE  # noqa: E712
    row = claims.agg(
        F.count("*").alias("requirements"), F.count("delivered").alias("scored"), F.count_if(failed).alias("failed"), F.try_divide(F.count_if(failed & done), F.count_if(failed)).alias("silent_share"),
        F.try_divide(F.count_if(failed & done), F.count_if(done & F.col("delivered").isNotNull())).alias("done_failed_share"), F.count_if("listed_as_open").alias("listed_as_open"),
    )
    parts = (per_run.agg(F.count("*").alias("runs"), F.count("silent_share").alias("runs_with_failures")), exact_quantiles(per_run, [], "silent_share", {"median": 0.5}).select("median"), exclusive_quartiles(per_run, "silent_share"))
    for p in parts:
        row = row.join(F.broadcast(p), F.lit(True), "left")  # one row each
    return row


def claim_counts(claims: DataFrame) -> DataFrame:
    """of, name, n: known deliveries by claim and outcome, all requirements by the method that matched them."""
    delivered = F.concat_ws("/", "claim", F.when(F.col("delivered"), "delivered").when(~F.col("delivered"), "failed"))
    pairs = F.array_compact(F.array(F.when(F.col("delivered").isNotNull(), F.struct(F.lit("claim").alias("of"), delivered.alias("name"))), F.struct(F.lit("match_method").alias("of"), F.coalesce("match_method", F.lit("")).alias("name"))))
    return claims.select(F.inline(pairs)).groupBy("of", "name").agg(F.count("*").alias("n"))


#: Ratios of C12 by the columns of a run's communication coverage.
LINKS = {
    "question_to_ask": ("question_events_linked_to_ask", "sidecar_question_events"),
    "question_reply_visible": ("question_replies_model_visible", "sidecar_question_events"),
    "fact_declaration_reply_visible": ("fact_events_with_visible_reply_id", "declared_fact_events"),
    "notification_release_link": ("visible_notifications_with_release_link", "unique_visible_notifications"),
}


def linked_shares(coverage: DataFrame, pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Ratio, numerator, denominator, share over all runs; a run's null counts as 0, a ratio without events has no share."""
    pairs = pairs or LINKS
    columns = sorted({c for p in pairs.values() for c in p})
    sums = coverage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(a).alias("numerator"), F.col(b).alias("denominator")) for n, (a, b) in pairs.items()])
    return sums.select(F.inline(rows)).withColumn("share", F.try_divide("numerator", "denominator"))


def skipped_runs(runs: DataFrame, reconciled: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """The runs that get no document, with the reason. reconciled: by, match. links: by."""
    ok = reconciled.where("match").select(*by).distinct().withColumn("__match", F.lit(True))
    linked = links.select(*by).distinct().withColumn("__linked", F.lit(True))
    reason = F.when(F.col("__match").isNull(), "per-node outcomes not reconstructed").when(F.col("__linked").isNull(), "no requirement links")
    return runs.select(*by).join(ok, by, "left").join(linked, by, "left").select(*by, reason.alias("reason")).where("reason is not null")


def diagnosis_documents(runs: DataFrame, reqs: DataFrame, nodes: DataFrame, claims: DataFrame, broad: DataFrame, deferrals: DataFrame, failed: DataFrame, by: list[str]) -> DataFrame:
    """Per run one JSON document of its outcome, its requirements with nodes, loss stages, note and deferrals, and its
    failed regression nodes; lists in the order of req, node and owner, empty texts as null, nulls kept.

    runs: by, outcome (struct). reqs: by, req, card, topic, holder, acquisition,
    questions. nodes: by, req, node, status, failure_class, ask_detail,
    loss_stage, mapping_confidence, grader_output, one row per node and
    requirement. claims: by, req, claim_class, listed_as_open, match_method,
    excerpt, line. broad: by, req, claim_class. deferrals: by, card, owner,
    followed, disclosed, budget_left_hours, hours_until_run_end. failed: by, node,
    failure_class, grader_output. claims and broad have one row per requirement.
    """
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)

    def listed(c: Column) -> Column:
        return F.array_sort(F.collect_list(c))

    node = F.struct("node", "status", text("failure_class"), text("ask_detail"), "mapping_confidence", text("grader_output"))
    stages = F.array_sort(F.collect_set(F.nullif(F.col("loss_stage"), F.lit(""))))
    own = nodes.groupBy(*by, "req").agg(F.count("*").alias("nodes_total"), F.count_if(F.col("status") == "passed").alias("nodes_passed"), F.when(F.size(stages) > 0, stages).alias("pipeline_loss_stage"), listed(node).alias("nodes"))
    note = claims.select(*by, "req", F.col("claim_class").alias("__strict"), "listed_as_open", "match_method", text("excerpt"), text("line"))
    wide = broad.select(*by, "req", F.col("claim_class").alias("__broad"))
    put_off = deferrals.where("card <> ''").groupBy(*by, "card").agg(listed(F.struct("owner", "followed", "disclosed", "budget_left_hours", "hours_until_run_end")).alias("deferrals"))
    j = reqs.join(own.hint("merge"), [*by, "req"], "left").join(note, [*by, "req"], "left").join(wide, [*by, "req"], "left").join(put_off.hint("merge"), [*by, "card"], "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(like.schema[c].dataType)).alias(c)
    delivery = F.struct(F.col("__strict").alias("strict"), F.col("__broad").alias("broad"), "listed_as_open", "match_method", "excerpt", "line")
    requirement = F.struct(
        "req", text("card"), F.coalesce("topic", F.lit("")).alias("topic"), "holder", "acquisition", F.coalesce("questions", F.lit(0)).alias("questions"),
        F.coalesce("nodes_total", F.lit(0)).alias("nodes_total"), F.coalesce("nodes_passed", F.lit(0)).alias("nodes_passed"), "pipeline_loss_stage", none("nodes", own), delivery.alias("delivery_note"), none("deferrals", put_off),
    )
    required = j.groupBy(*by).agg(F.array_agg(requirement).alias("requirements"))
    regressions = failed.groupBy(*by).agg(listed(F.struct("node", text("failure_class"), text("grader_output"))).alias("p2p_failed"))
    whole = runs.join(required.hint("merge"), by, "left").join(regressions.hint("merge"), by, "left")
    in_order = F.array_sort(none("requirements", required), lambda a, b: F.when(a["req"] < b["req"], -1).when(a["req"] > b["req"], 1).otherwise(0))
    document = F.struct("outcome", in_order.alias("requirements"), none("p2p_failed", regressions))
    return whole.select(*by, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def _band(c: str, low: int, high: int, names: tuple[str, str, str]) -> Column:
    return F.when(F.col(c) < low, names[0]).when(F.col(c) <= high, names[1]).otherwise(names[2])


def release_strata(runs: DataFrame, release: DataFrame, by: list[str]) -> DataFrame:
    """Per axis and stratum the runs, mean rate in per cent, strict successes, and mean share of obtained facts in per cent
    over the runs that have one. Runs without release data are left out.

    runs: by, rate, strict, obtained. release: by, n_nodes, added (lines of production code), language, domain, one row per run.
    """
    known = lambda c, names: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.col(c)), F.lit("Other"))
    axes = {
        "verifier_nodes": _band("n_nodes", 28, 35, rules.NODE_BANDS), "edit_size": _band("added", 1000, 5000, rules.EDIT_BANDS),
        "language": known("language", rules.LANGUAGE_GROUPS), "domain": known("domain", {d: d for d in rules.DOMAINS}),
    }
    places = F.array(*[F.struct(F.lit(n).alias("axis"), c.alias("stratum")) for n, c in axes.items()])
    stacked = runs.select(*by, "rate", "strict", "obtained").join(release, by).select("rate", "strict", "obtained", F.inline(places))
    return stacked.groupBy("axis", "stratum").agg(F.count("*").alias("n"), (100 * F.avg("rate")).alias("rate_pct"), F.count_if("strict").alias("strict"), (100 * F.avg("obtained")).alias("obtained_pct"))


def short_index(summary: DataFrame, losses: DataFrame, by: list[str]) -> DataFrame:
    """Per run both rates, hours, messages, obtained facts, lost nodes by the first letter of their stage in the order of
    stages, abandoned threads and claims of done that fail, as texts; a null label shows as a dash.

    summary: by, task, f2p_passed, f2p_total, p2p_passed, p2p_total, end_reason,
    hours, messages, obtained, held, abandoned, threads, done_failed, done,
    premature. losses: by, stage, one row per lost node.
    """
    order = F.array(*map(F.lit, rules.LOSS_STAGES))
    per = losses.where(F.col("stage").isin(*rules.LOSS_STAGES)).groupBy(*by, "stage").agg(F.count("*").alias("n"))
    letters = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("stage")).alias("at"), F.concat(F.upper(F.left("stage", F.lit(1))), "n").alias("text"))))
    lost = per.groupBy(*by).agg(F.array_join(letters["text"], " ").alias("lost_at"))
    of = lambda a, b: F.concat_ws("/", F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    return summary.join(lost, by, "left").select(
        *by, "task", of("f2p_passed", "f2p_total").alias("f2p"), of("p2p_passed", "p2p_total").alias("p2p"), "end_reason", F.format_string("%.1f", F.coalesce("hours", F.lit(0)).cast("double")).alias("hours"), "messages",
        of("obtained", "held").alias("obtained"), F.coalesce("lost_at", F.lit("")).alias("lost_at"), of("abandoned", "threads").alias("deferrals"), of("done_failed", "done").alias("claims"), F.coalesce("premature", F.lit("–")).alias("premature"),
    )


#: Figures of a model's comparison row that are shares to be shown in per cent.
IN_PERCENT = ("obtained_rate", "first_fifth", "after_first_edit", "first_edit_median")


def model_rows(figures: DataFrame, names: list[str]) -> DataFrame:
    """A row per model with a column per figure, shares in per cent, and the silent share of failed requirements: what is
    neither listed as open nor claimed done (null without failed ones).

    figures: model, figure, value, one row per model and figure; ``failed``,
    ``listed_open_pct`` and ``claimed_done_pct`` are among the names.
    """
    scale = F.when(F.col("figure").isin(*IN_PERCENT), 100.0).otherwise(1.0)
    wide = figures.where(F.col("figure").isin(*names)).groupBy("model").agg(*[F.max(F.when(F.col("figure") == n, F.col("value") * scale)).alias(n) for n in names])
    told = F.coalesce("listed_open_pct", F.lit(0.0)) + F.coalesce("claimed_done_pct", F.lit(0.0))
    return wide.withColumn("silent_pct", F.when(F.col("failed") > 0, 100 - told))
