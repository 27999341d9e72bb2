"""J: resampled correlations, and the cases that a report shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Outcomes under which a requirement reached the run.
OBTAINED = ("obtained", "returned_not_visible")


#: Draws of a resample that are made from one row.
BLOCK = 4096


def _parts(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _weighted_spearman(drawn: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by and the rank correlation, null as ``relational.spearman`` has it, of many groups at once: equal pairs are counted first, and ranks are running sums of the counts.

    ``by`` includes n, the rows of the group.
    """
    pairs = drawn.groupBy(*by, x, y).agg(F.count("*").alias("__w"))

    def centred(c: str) -> Column:
        # a window without a frame goes up to the last equal value
        upto = F.sum("__w").over(Window.partitionBy(*by).orderBy(c))
        equal = F.sum("__w").over(Window.partitionBy(*by, c))
        return upto - (equal + F.col("n")) / 2

    a, b, w = F.col("__a"), F.col("__b"), F.col("__w")
    of = pairs.withColumn("__a", centred(x)).withColumn("__b", centred(y))
    out = of.groupBy(*by).agg(F.sum(w * a * a).alias("__aa"), F.sum(w * b * b).alias("__bb"), F.sum(w * a * b).alias("__ab"))
    usable = (F.col("n") >= 3) & (F.col("__aa") > 0) & (F.col("__bb") > 0)
    return out.select(*by, F.when(usable, F.col("__ab") / F.sqrt("__aa") / F.sqrt("__bb")).alias("rho"))


def bootstrap_ci(df: DataFrame, x: str, y: str, by: list[str], order: str, reps: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """N, percentile interval of the rank correlation over ``reps`` resamples, and whether it leaves out zero.

    Each resample draws as many rows as the group has, with replacement; a
    draw is the start of the MD5 of (seed, replicate, place), so it is the
    same on every cluster. Resamples without a correlation are left out and
    counted. Groups without a usable resample have a null interval.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, order, x, y)
    placed = both.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(order, x, y)) - 1)
    sizes = both.groupBy(*by).agg(F.count("*").alias("n"))
    # few rows become many: dealt out before, so that no task makes the draws of a group
    blocks = sizes.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("__block"))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("__rep")).repartition(_parts(df), *by, "__rep", "__block")
    places = F.sequence(F.col("__block") * BLOCK, F.least((F.col("__block") + 1) * BLOCK, F.col("n")) - 1)
    draws = blocks.select(*by, "n", "__rep", F.explode(places).alias("__place"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "__rep", "__place")), 1, 8), 16, 10).cast("long")
    # never null, or a join would test that by making the code twice
    at = F.coalesce((code % F.col("n")).cast("int"), F.lit(0))
    drawn = draws.select(*by, "n", "__rep", at.alias("__at")).join(placed.hint("shuffle_hash"), [*by, "__at"])
    rho = _weighted_spearman(drawn, x, y, [*by, "n", "__rep"])
    ends = [(1 - level) / 2, (1 + level) / 2]
    out = rho.groupBy(*by).agg(F.percentile("rho", F.array(*map(F.lit, ends))).alias("q"), F.count("rho").alias("used"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return sizes.join(out.hint("merge"), by, "left").select(*by, "n", F.coalesce("used", F.lit(0)).alias("used"), lo.alias("lo"), hi.alias("hi"), F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("significant"))


def select_cases(losses: DataFrame, reqs: DataFrame, threads: DataFrame, run: str) -> DataFrame:
    """(case, run): the three runs that a report shows; ties go to the lowest run, a case without a run has no row.

    losses: run, loss_stage, one row per lost node. reqs: run, acquisition of
    each requirement that a colleague holds. threads: run, one row per
    abandoned thread. Most losses at ask, then their share; most losses at
    implement among the runs that obtained all (else among the five of highest
    rate); most abandoned threads, then losses at ask.
    """
    lost = losses.groupBy(run).agg(F.count("*").alias("fails"), F.count_if(F.col("loss_stage") == "ask").alias("ask"), F.count_if(F.col("loss_stage") == "implement").alias("implement"))
    got = reqs.groupBy(run).agg(F.avg(F.col("acquisition").isin(*OBTAINED).cast("int")).alias("rate"))
    left = threads.groupBy(run).agg(F.count("*").alias("abandoned"))
    runs = reduce(lambda a, b: a.join(b, run, "full_outer"), (got, left), lost).fillna(0)
    whole = runs.where("rate = 1")
    five = runs.orderBy(F.desc("rate"), run).limit(5)
    # the five stand in only where no run obtained all
    any_whole = whole.limit(1).agg(F.count("*").alias("__whole"))
    pool = whole.unionByName(five.crossJoin(F.broadcast(any_whole)).where("__whole = 0").drop("__whole"))  # one row each
    first = lambda df, case, *order: df.orderBy(*order, run).limit(1).select(F.lit(case).alias("case"), run)
    picks = (
        first(runs.where("ask > 0"), "ask_loss", F.desc("ask"), F.desc(F.col("ask") / F.greatest("fails", F.lit(1)))),
        first(pool.where("implement > 0"), "implement_despite_all_obtained", F.desc("implement")),
        first(runs.where("abandoned > 0"), "abandoned_deferrals", F.desc("abandoned"), F.desc("ask")),
    )
    return reduce(DataFrame.unionByName, picks)


def case_detail(cases: DataFrame, asks: DataFrame, undisclosed: DataFrame, starts: DataFrame, run: str, card: str) -> DataFrame:
    """Of each case's run the undisclosed card that is asked for most, and the hours of its questions since the start.

    asks: run, card, at (seconds). undisclosed: run, card. starts: run,
    started_at. The lowest card wins a tie; without one the card is null.
    """
    wanted = asks.join(undisclosed.select(run, card).distinct().hint("merge"), [run, card]).join(cases.select(run).distinct().hint("broadcast"), run)  # at most three runs
    hours = F.round((F.col("at") - F.col("started_at")) / 3600, 2)
    timed = wanted.join(starts.select(run, "started_at"), run, "left").groupBy(run, card).agg(F.count("*").alias("questions"), F.array_sort(F.collect_list(hours)).alias("hours"))
    best = timed.groupBy(run).agg(F.min(F.struct((-F.col("questions")).alias("__n"), card, "questions", "hours")).alias("b")).select(run, f"b.{card}", "b.questions", "b.hours")
    return cases.join(best, run, "left")
