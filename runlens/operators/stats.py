"""H, J, K, L: review tables, statistics, wide tables, models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.operators.relational import QUARTILES, exact_quantiles, share_of_total, signed_rank, spearman


def outcome_macro(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Runs, mean of per-run rates (not pooled), runs that pass everything."""
    strict = (F.col("f2p_passed") == F.col("f2p_total")) & (F.col("p2p_passed") == F.col("p2p_total"))
    return runs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("f2p_rate").alias("macro"), F.count_if(strict).alias("strict"))


def rate_histogram(runs: DataFrame, rate: str) -> DataFrame:
    """Ten bins of ten points, 100 in the last; empty bins have 0."""
    bins = runs.where(F.col(rate).isNotNull()).groupBy(F.floor(F.least(F.col(rate) * 100, F.lit(99.999)) / 10).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return runs.sparkSession.range(10).toDF("bin").join(bins.hint("merge"), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate_marks(runs: DataFrame, rate: str) -> DataFrame:
    """Runs with 90 points or more, runs under 25, runs that keep all p2p nodes, and the median rate."""
    r, kept = F.col(rate), F.col("p2p_passed") == F.col("p2p_total")
    return runs.agg(F.count_if(r >= 0.9).alias("high"), F.count_if(r < 0.25).alias("low"), F.count_if(kept).alias("p2p_kept"), F.median(r).alias("median"))


def flagged_rows(runs: DataFrame, key: list[str], flag: str) -> DataFrame:
    """The runs that the sensitivity cohort leaves out."""
    return runs.where(flag).select(*key)


def effort_quantiles(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """N, median and quartiles with linear interpolation."""
    groups = df.select(*by).distinct()
    return groups.join(exact_quantiles(df, by, col, QUARTILES), by, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), *QUARTILES)


def acquisition_shares(reqs: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares."""
    return share_of_total(reqs, by, [])


def pass_by_state(nodes: DataFrame, state: str) -> DataFrame:
    """Pass rate of nodes by state."""
    return nodes.groupBy(state).agg(F.count("*").alias("n"), F.avg((F.col("status") == "passed").cast("int")).alias("rate"))


def confidence_counts(nodes: DataFrame, confidence: str) -> DataFrame:
    """Nodes, graded ones and unresolved ones by the confidence of their link."""
    open_ = F.col("status") == "unresolved"
    return nodes.groupBy(confidence).agg(F.count("*").alias("n"), F.count_if(~open_).alias("graded"), F.count_if(open_).alias("unresolved"))


def paired_gap(nodes: DataFrame, by: list[str], side: str) -> DataFrame:
    """Per run the pass rate with ``side`` less that without it, where both exist; mean, median, signs, signed-rank sum and its p value."""
    ok = (F.col("status") == "passed").cast("int")
    gaps = nodes.groupBy(*by).agg((F.avg(F.when(F.col(side), ok)) - F.avg(F.when(~F.col(side), ok))).alias("gap")).where("gap is not null")
    out = gaps.agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.count_if(F.col("gap") > 0).alias("positive"), F.count_if(F.col("gap") < 0).alias("negative"))
    median = exact_quantiles(gaps, [], "gap", {"median": 0.5}).select("median")
    ranks = signed_rank(gaps, [], "gap").select("w_plus", "p")
    return out.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(ranks))  # one row each


def strata(runs: DataFrame, axes: dict[str, str], rate: str) -> DataFrame:
    """N, macro rate and strict count of every stratum of several axes in one pass."""
    stacked = runs.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.expr(e).cast("string").alias("stratum")) for a, e in axes.items()])).alias("s"))
    return stacked.groupBy("s.axis", "s.stratum").agg(F.count("*").alias("n"), F.avg(rate).alias("macro"), F.count_if("strict").alias("strict"))


def pick_first(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The top row of each group with a full order, so ties are decided."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


def dimension_stats(ratings: DataFrame, by: list[str], score: str) -> DataFrame:
    """Rated n, histogram of scores 0 to 3, mean and median per dimension."""
    hist = [F.count_if(F.col(score) == s).alias(f"n{s}") for s in range(4)]
    return ratings.groupBy(*by).agg(F.count(score).alias("n"), *hist, F.avg(score).alias("mean"), F.median(score).alias("median"))


def check_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Does each quote, white space folded, stand in its cited text.

    quotes: place, quote. lines: place, text.
    """
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    j = quotes.join(lines, "place", "left")
    return j.select(*quotes.columns, F.coalesce(F.contains(fold(F.col("text")), fold(F.col("quote"))), F.lit(False)).alias("found"))


def find_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """In how many of all texts each quote stands, white space folded.

    quotes: place, quote. lines: text. A text that holds a quote holds each of
    its inner words between blanks, so texts and quotes meet by the quote's
    rarest inner word; quotes of one or two words are compared with every text.
    The quotes are sent to every executor, so that no text is shuffled.
    """
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    q = quotes.where("quote is not null").select("place", fold(F.col("quote")).alias("__quote")).withColumn("__inner", F.expr("array_distinct(slice(split(__quote, ' '), 2, greatest(size(split(__quote, ' ')) - 2, 0)))"))
    texts = lines.where("text is not null").select(fold(F.col("text")).alias("__text"))
    of_text = F.explode(F.array_distinct(F.split("__text", " "))).alias("__word")
    of_quote = q.select("place", "__quote", F.explode("__inner").alias("__word"))
    seen = texts.select(of_text).join(F.broadcast(of_quote.select("__word").distinct()), "__word").groupBy("__word").agg(F.count("*").alias("__n"))
    rarest = of_quote.hint("merge").join(seen, "__word", "left").groupBy("place", "__quote").agg(F.min_by("__word", F.struct(F.coalesce("__n", F.lit(0)), "__word")).alias("__word"))
    held = F.contains(F.col("__text"), F.col("__quote"))
    hits = texts.select("__text", of_text).join(F.broadcast(rarest), "__word").where(held).select("place")
    hits = hits.unionByName(texts.join(F.broadcast(q.where("size(__inner) = 0")), held).select("place"))
    n = hits.groupBy("place").agg(F.count("*").alias("texts"))
    return quotes.hint("merge").join(n, "place", "left").select(*quotes.columns, F.coalesce("texts", F.lit(0)).alias("texts"))


def violations(df: DataFrame, key: list[str], checks: dict[str, str]) -> DataFrame:
    """One row per row and rule that it breaks; checks are SQL conditions that hold for good rows."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def gate(reports: DataFrame, problems: DataFrame, key: list[str]) -> DataFrame:
    """Reports without a violation, and the others, counted by state."""
    bad = problems.select(*key).distinct().withColumn("__bad", F.lit(True))
    state = F.when(F.col("__bad"), "invalidated").otherwise("accepted")
    return reports.hint("merge").join(bad, key, "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def run_summary(runs: DataFrame, tables: list[DataFrame], by: list[str], zeros: list[str]) -> DataFrame:
    """One wide row per run, counts 0 where a table has none."""
    out = runs
    for t in tables:
        out = out.join(t, by, "left")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in zeros else F.col(c) for c in out.columns])


def timeline(events: DataFrame, by: list[str], at: str, clip: int | None = None) -> DataFrame:
    """Offset h:mm:ss from the run's start, and the text, with a clip only its head (2/3) and tail (1/3)."""
    start = F.min(at).over(Window.partitionBy(*by))
    secs = F.floor((F.col(at) - start) / 1_000_000)
    offset = F.format_string("%d:%02d:%02d", F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60)
    if not clip:
        return events.select(*events.columns, offset.alias("offset"), F.col("text").alias("shown"))
    head = clip * 2 // 3
    text = F.when(F.length("text") <= clip, F.col("text")).otherwise(F.concat(F.substring("text", 1, head), F.lit(" ... "), F.expr(f"right(text, {clip - head})")))
    return events.select(*events.columns, offset.alias("offset"), text.alias("shown"))


def trace_window(lines: DataFrame, where: str, offset: int, limit: int) -> DataFrame:
    """A slice of the texts of some lines, and whether more follows."""
    return lines.where(where).withColumn("part", F.substring("text", offset + 1, limit)).withColumn("more", F.length("text") > offset + limit)


def model_compare(metrics: DataFrame) -> DataFrame:
    """Per metric the models' mean, skipping nulls, and their number. metrics: model, metric, value."""
    return metrics.groupBy("metric").agg(F.count("value").alias("models"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def model_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row per model and a row Mean, which skips nulls, with a column per metric; two summaries of one model are an error.

    metrics: model, metric, value.
    """
    cell = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("more than one summary of model "), F.col("model")))).otherwise(F.max("value"))
    single = metrics.where(F.col("metric").isin(*names)).groupBy("model", "metric").agg(cell.alias("value"))
    column = lambda of: [of(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names]
    models = single.groupBy("model").agg(*column(F.max))
    return models.unionByName(single.agg(*column(F.avg)).withColumn("model", F.lit("Mean")))


def tool_totals(breakdown: DataFrame, tool: str = "tool", calls: str = "calls", errors: str = "n_error") -> DataFrame:
    """Calls, error calls and runs of each tool, of a row per run and tool."""
    return breakdown.groupBy(tool).agg(F.sum(calls).alias("calls"), F.sum(errors).alias("errors"), F.count("*").alias("runs"))


def end_reasons(runs: DataFrame, reason: str) -> DataFrame:
    """Runs by end reason, a missing one included."""
    return runs.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("runs"))


def failure_class_counts(nodes: DataFrame) -> DataFrame:
    """Failed nodes by class, those of f2p and p2p apart. nodes: node_class, status, failure_class."""
    counts = [F.count_if(F.col("node_class") == k).alias(k) for k in ("f2p", "p2p")]
    return nodes.where((F.col("status") == "failed") & F.col("node_class").isin("f2p", "p2p")).groupBy("failure_class").agg(*counts)


def regression_check(stats: DataFrame, expected: DataFrame) -> DataFrame:
    """Shared names whose formatted values agree, commas and blanks removed."""
    bare = lambda c: F.translate(F.col(c), ", ", "")
    j = stats.join(expected.withColumnRenamed("value", "expected"), "name")
    return j.agg(F.count("*").alias("shared"), F.count_if(bare("value") == bare("expected")).alias("agree"))


def collab_summary(runs: DataFrame, metrics: list[str], outcome: str) -> DataFrame:
    """N, mean, median and rank correlation with the outcome of every metric."""
    long = runs.unpivot([outcome], metrics, "metric", "value").where(F.col("value").isNotNull())
    out = long.groupBy("metric").agg(F.avg("value").alias("mean")).join(exact_quantiles(long, ["metric"], "value", {"median": 0.5}), "metric")
    rho = spearman(long, "value", outcome, ["metric"]).select("metric", "rho")
    return out.hint("merge").join(rho, "metric", "left").select("metric", "n", "mean", "median", "rho")


def stage_matrix(df: DataFrame, first: str, second: str) -> DataFrame:
    """How often two judges gave each pair of labels, and whether the pair agrees."""
    return df.groupBy(first, second).agg(F.count("*").alias("n")).withColumn("agrees", F.col(first).eqNullSafe(F.col(second)))
