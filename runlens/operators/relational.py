"""Building blocks that the domain operators share: top rows, ranks, intervals, tiered matches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top1(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group under a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")


#: Partitions of ``dealt`` for each one that Spark uses by default.
FINER = 4


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt out by ``by`` alone: windows and aggregates by these and further columns go on without moving them, and joins do in ``joined_in_place``.

    For steps that make many rows of one (names, words, keys), which then need no shuffle of their own. As a task
    makes more rows than it reads, there are more partitions than by default, and Spark does not join them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(FINER * parts, *by)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """While it holds, what is run joins rows that are dealt out by some of the join's columns where they are."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def interval_union(df: DataFrame, start: str, end: str, by: list[str], name: str = "covered") -> DataFrame:
    """Length covered by the union of intervals per group; touching intervals merge, reversed ones do not count.

    Gaps and islands: an island starts where an interval begins after all earlier ends.
    """
    along = Window.partitionBy(*by).orderBy(start, end)
    seen = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    valid = df.where(F.col(end) >= F.col(start)).select(*by, start, end)
    starts = valid.withColumn("__new", F.coalesce((F.col(start) > seen).cast("int"), F.lit(1)))
    islands = starts.withColumn("__island", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*by, "__island").agg((F.max(end) - F.min(start)).alias("__len"))
    return spans.groupBy(*by).agg(F.sum("__len").alias(name))


def interval_sum(df: DataFrame, start: str, end: str, by: list[str], name: str = "summed") -> DataFrame:
    """Plain sum of interval lengths."""
    return df.where(F.col(end) >= F.col(start)).groupBy(*by).agg(F.sum(F.col(end) - F.col(start)).alias(name))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}

#: Copies of the smaller side of a join whose keys may each hold a large share of the rows.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with a side that has one row for each key; the rows of a key are dealt over SALTS tasks."""
    rest = [c for c in left.columns if c not in on]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*(rest or on)), F.lit(SALTS)).cast("int"))
    copies = right.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))
    return salted.hint("shuffle_hash").join(copies, [*on, "__salt"]).drop("__salt")


def ranked(df: DataFrame, by: list[str], value: str, **sums: Column) -> DataFrame:
    """by, value, n, below, total, and further sums: the distinct values that are not null, how often each stands in its
    group, how many values of the group are smaller, and how many it has. The mean rank of a value is below + (n + 1) / 2.

    A group is cut at approximate quantiles of its distinct values, so that
    tasks order a part of it each; counts of the parts before are added. No task
    holds a whole group.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = by or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in sums.items()))
    cuts = counts.groupBy(*groups).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts).alias("__cuts"), F.sum("n").alias("total"))
    placed = salted_join(counts, cuts, groups).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    before = placed.groupBy(*groups, "__part").agg(F.sum("n").alias("__n"))
    # at most as many rows for each group as it has parts
    before = before.select(*groups, "__part", (F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.sum("n").over(Window.partitionBy(*groups, "__part").orderBy(value)) - F.col("n")
    out = placed.withColumn("__within", within).hint("merge").join(before, [*groups, "__part"])
    return out.select(*by, value, "n", (F.col("__before") + F.col("__within")).alias("below"), "total", *sums)


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """n, and quantiles by linear interpolation between the two nearest values, of each group that has a value."""
    r = ranked(df, by, value)
    at = {k: (F.col("total") - 1) * F.lit(p) for k, p in shares.items()}
    held = lambda i: F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col(value)))
    ends = [x for k, i in at.items() for x in (held(F.floor(i)).alias(f"__{k}0"), held(F.ceil(i)).alias(f"__{k}1"), F.max(i - F.floor(i)).alias(f"__{k}"))]
    out = r.groupBy(*by).agg(F.max("total").alias("n"), *ends)
    return out.select(*by, "n", *[(F.col(f"__{k}0") + (F.col(f"__{k}1") - F.col(f"__{k}0")) * F.col(f"__{k}")).alias(k) for k in shares])


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """N and rank correlation per group over rows with both values; null under three rows or if a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    pairs = both.groupBy(*by, "__x", "__y").agg(F.count("*").alias("__w"))
    centred = lambda c, name: ranked(both, by, c).select(*by, c, (F.col("below") + (F.col("n") - F.col("total")) / 2).alias(name))
    if not by:
        both, pairs, by = both.withColumn("__all", F.lit(0)), pairs.withColumn("__all", F.lit(0)), ["__all"]
    of = salted_join(salted_join(pairs, centred("__x", "__a"), [*by, "__x"]), centred("__y", "__b"), [*by, "__y"])
    a, b, w = F.col("__a"), F.col("__b"), F.col("__w")
    out = of.groupBy(*by).agg(F.sum("__w").alias("n"), F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb"), F.sum(w * a * b).alias("__ab"))
    usable = (F.col("n") >= 3) & (F.col("__aa") > 0) & (F.col("__bb") > 0)
    return out.select(*[c for c in by if c != "__all"], "n", F.when(usable, F.col("__ab") / F.sqrt("__aa") / F.sqrt("__bb")).alias("rho"))


def erfc(x: Column) -> Column:
    """The complement of the error function for x >= 0: a series under 1.5, a continued fraction above."""
    terms = F.sequence(F.lit(0), F.lit(40))
    series = F.aggregate(terms, F.struct(F.lit(0.0).alias("sum"), x.cast("double").alias("term")), lambda s, n: F.struct((s["sum"] + s["term"] / (2 * n + 1)).alias("sum"), (-s["term"] * x * x / (n + 1)).alias("term")), lambda s: 1 - 2 / F.sqrt(F.pi()) * s["sum"])
    tail = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), x.cast("double"), lambda t, k: x + k / 2 / t)
    return F.when(x < 1.5, series).otherwise(F.exp(-x * x) / F.sqrt(F.pi()) / tail)


#: Values at most whose signed-rank distribution is counted out.
EXACT_RANKS = 50


def signed_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the values that are not zero, the sum of the ranks of the positive ones by size, and the two-sided p value.

    Up to EXACT_RANKS values of different sizes the distribution is counted
    out; else it is the normal one with its variance corrected for ties. Under
    two values p is null.
    """
    sized = df.where(F.col(value) != 0).withColumn("__size", F.abs(F.round(value, 9)))
    r = ranked(sized, by, "__size", up=F.count_if(F.col(value) > 0))
    n, rank = F.col("n"), F.col("below") + (F.col("n") + 1) / 2
    out = r.groupBy(*by).agg(F.max("total").alias("n"), F.sum(F.col("up") * rank).alias("w_plus"), F.sum(n * n * n - n).alias("__ties"))
    m = F.col("n").cast("double")
    w = F.least(F.col("w_plus"), m * (m + 1) / 2 - F.col("w_plus"))
    # ways to reach each sum up to w with the ranks 1 to n
    start = F.transform(F.sequence(F.lit(0), w.cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, lambda acc, k: F.transform(acc, lambda v, i: v + F.when(i >= k, F.get(acc, i - k)).otherwise(0.0)))
    exact = 2 * F.aggregate(ways, F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), m)
    spread = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("__ties") / 2) / 24)
    normal = erfc(F.abs(w - m * (m + 1) / 4) / spread / F.sqrt(F.lit(2.0)))
    p = F.when(m < 2, None).when((m <= EXACT_RANKS) & (F.col("__ties") == 0), F.least(exact, F.lit(1.0))).otherwise(normal)
    return out.select(*by, "n", "w_plus", p.alias("p"))


def unique_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs whose key occurs once on either side."""
    once = lambda d: d.withColumn("__n", F.count("*").over(Window.partitionBy(*on))).where("__n = 1").drop("__n")
    return once(left).join(once(right), on)


def five_number(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """N, sum, median, quartiles, extremes of each column, blanks skipped."""
    by = by or []
    long = df.unpivot(by, cols, "metric", "value").where("value is not null")
    out = long.groupBy(*by, "metric").agg(F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.join(exact_quantiles(long, [*by, "metric"], "value", QUARTILES), [*by, "metric"]).select(*by, "metric", "n", "total", "least", "most", *QUARTILES)


def share_of_total(df: DataFrame, by: list[str], within: list[str], name: str = "share") -> DataFrame:
    """Counts per group and their share of the total of ``within`` (all rows if empty)."""
    counts = df.groupBy(*within, *by).agg(F.count("*").alias("n"))
    whole = df.groupBy(*within).agg(F.count("*").alias("__all")) if within else df.agg(F.count("*").alias("__all"))
    joined = counts.join(whole, within) if within else counts.crossJoin(F.broadcast(whole))  # one row
    return joined.select(*within, *by, "n", (F.col("n") / F.col("__all")).alias(name))
