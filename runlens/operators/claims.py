"""F: what a note says of each card, read by clauses, with topics for the cards that it does not name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.operators.mentions import card_ranges
from runlens.operators.workplace import claim_of, heard

OPEN, DONE, NONE = "claimed_partial_or_open", "claimed_done", "not_mentioned"
_END = r"(?:[。；;！!？?\n]|\.\s)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clause_around(text: Column, at: Column) -> Column:
    """the clause that holds the character at a place (from 0): between ends of sentences and clauses, Chinese ones too."""
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    head = F.regexp_replace(before, f"(?s)^.*{_END}", "")
    tail = F.regexp_extract(after, f"(?s)^(.*?{_END})", 1)
    return strip(F.concat(head, F.when(tail == "", after).otherwise(tail)))


def judge(text: Column, heads: Column, at: Column | None = None, multi: Column | None = None, blanket: Column | None = None, broad: bool = False) -> Column:
    """struct(claim, listed_open, also_done, said) of a mention in a unit.

    With a place, a long unit of several cards and a blanket mention are read
    by the clause around it. A blanket mention ignores headings, and tells of
    open points only, unless its clause speaks of all or every card.
    """
    no = F.lit(False)
    wide = no if blanket is None else F.coalesce(blanket, no)
    by_clause = no if at is None else at.isNotNull() & (wide | (F.coalesce(multi, no) & (F.length(text) > rules.LONG_UNIT)))
    said = F.when(by_clause, clause_around(text, F.coalesce(at, F.lit(0)))).otherwise(text) if at is not None else text
    known = F.when(wide, "").otherwise(heads)
    has_open, says_done, answered = heard(said)
    claim = claim_of(has_open, says_done, answered, known, broad)
    listed = known.rlike(rules.OPEN_HEAD) & ~(answered & ~has_open)
    implemented = known.rlike(rules.IMPLEMENT_HEAD_BROAD if broad else rules.IMPLEMENT_HEAD)
    done = says_done | (implemented & ~listed)
    silent = wide & ~has_open & ~said.rlike(rules.ALL_CARDS)
    word = lambda c: F.when(silent, no).otherwise(c)
    return F.struct(F.when(silent, NONE).otherwise(claim).alias("claim"), word(listed).alias("listed_open"), word(done).alias("also_done"), said.alias("said"))


def topic_features(topic: Column) -> Column:
    """words of a topic of three characters at least, cut to six, without common ones, and pairs of neighbouring Chinese characters."""
    words = F.regexp_extract_all(F.lower(topic), F.lit("[a-z0-9_.]{3,}"), F.lit(0))
    words = F.transform(F.filter(words, lambda w: ~w.isin(*rules.TOPIC_STOP)), lambda w: F.substring(w, 1, 6))
    runs = F.regexp_extract_all(topic, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def topic_scores(units: DataFrame, topics: DataFrame, by: list[str], unit: str, topic: str, text: str) -> DataFrame:
    """(by, topic, unit, score) of the units that hold features of a topic: the share of them, two at least, or the only one if it has six characters.

    units: by, unit, text. topics: by, topic and its array ``features``, as
    topic_features gives them. A feature may stand anywhere in a text, so units
    are known by the pieces of the features' lengths of their words.
    """
    wanted = topics.select(*by, topic, F.size("features").alias("__size"), F.explode("features").alias("__f"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_.]{3,}|[一-鿿]{2,}"), F.lit(0)))
    cut = lambda w, k: F.when(F.length(w) >= k, F.transform(F.sequence(F.lit(1), F.length(w) - (k - 1)), lambda i: F.substring(w, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    of_word = lambda w: F.when(w.rlike("^[a-z0-9_.]"), F.concat(*[cut(w, k) for k in range(3, 7)])).otherwise(cut(w, 2))
    pieces = units.select(*by, unit, F.explode(F.array_distinct(F.flatten(F.transform(words, of_word)))).alias("__f"))
    hits = pieces.hint("shuffle_hash").join(wanted, [*by, "__f"]).groupBy(*by, topic, unit)
    hits = hits.agg(F.count("*").alias("__n"), F.max("__size").alias("__size"), F.max(F.length("__f")).alias("__long"))
    enough = F.when(F.col("__size") == 1, F.col("__long") >= 6).otherwise(F.col("__n") >= 2)
    return hits.where(enough).select(*by, topic, unit, (F.col("__n") / F.col("__size")).alias("score"))


def card_claims(units: DataFrame, cards: DataFrame, by: list[str], broad: bool = False, least: float = 0.5, sure: float = 0.75, clip: int = 200) -> DataFrame:
    """per card its claim, listed_open, also_done, open_kind, note_claim, goal_claim, method, mentions and evidence.

    units: by, unit (their order), text, heads, prefix, is_head and is_goal
    (parts of the summary of the goal, which have no headings). cards: by,
    number, topic. A card that no unit makes a claim of by its number is known
    by its topic: the three best units of the best score. One that is named is
    open as well where a unit under an open heading has most of its topic. Open
    beats done; open_kind tells whether all open units are records that came late.
    """
    card = [*by, "number"]
    goal = F.col("is_goal")
    heads = F.when(goal, "").otherwise(F.col("heads"))
    named = card_ranges(units, cards.select(*card), by)
    several = F.size(F.collect_set("number").over(Window.partitionBy(*by, "unit"))) > 1
    named = named.withColumn("__multi", several & ~goal)
    named = named.select(*card, "unit", "is_goal", "at", F.lit("card_id").alias("method"), F.coalesce("blanket", F.lit(False)).alias("blanket"), judge(F.col("text"), heads, F.col("at"), F.col("__multi"), F.col("blanket"), broad).alias("j"))
    silent = F.col("j.claim") == NONE
    named = named.where(~(silent & (F.col("blanket") | goal))).drop("blanket")
    # lists of sources do not keep a card from claims elsewhere in the note
    claimed = F.max((~silent & ~goal).cast("int")).over(Window.partitionBy(*card))
    named = named.withColumn("__claimed", claimed).where(goal | ~silent | (F.col("__claimed") == 0)).drop("__claimed")
    known = named.select(*card).distinct()

    topics = cards.select(*card, topic_features(F.col("topic")).alias("features"))
    scores = topic_scores(units.where("not is_head"), topics, by, "unit", "number", "text")
    of_unit = scores.where(F.col("score") >= min(least, sure)).hint("merge").join(units.select(*by, "unit", "text", "heads", "is_goal"), [*by, "unit"])
    best = Window.partitionBy(*card).orderBy(F.desc("score"), "is_goal", "unit")
    told = of_unit.where(F.col("score") >= least).hint("merge").join(known, card, "left_anti")
    told = told.withColumn("__rn", F.row_number().over(best)).withColumn("__top", F.max("score").over(Window.partitionBy(*card))).where("__rn <= 3 and score = __top")
    told = told.select(*card, "unit", "is_goal", F.lit(0).alias("at"), F.lit("topic").alias("method"), judge(F.col("text"), heads, broad=broad).alias("j")).where(~(silent & goal))
    also = of_unit.where((F.col("score") >= sure) & ~goal & F.col("heads").rlike(rules.OPEN_HEAD)).hint("merge").join(known, card, "left_semi")
    also = also.select(*card, "unit", "is_goal", F.lit(1 << 30).alias("at"), F.lit("card_id").alias("method"), judge(F.col("text"), heads, broad=broad).alias("j")).where(F.col("j.claim") == OPEN)

    found = reduce(DataFrame.unionByName, [named, told, also])
    rank = lambda claim: F.when(claim == OPEN, 0).when(claim == DONE, 1).otherwise(2)
    claim, said = F.col("j.claim"), F.col("j.said")
    order = F.struct(rank(claim).alias("r"), F.col("is_goal").alias("g"), (F.col("at") == 1 << 30).alias("x"), F.col("unit").alias("u"), F.coalesce("at", F.lit(1)).alias("a"))
    first = F.min_by(F.struct(claim.alias("claim"), F.concat(F.when(goal, "[goal] ").otherwise(""), said).alias("said")), order)
    side = lambda of: F.min(F.when(of, rank(claim)))
    late = F.bool_and(F.when(claim == OPEN, said.rlike(rules.LATE)))
    out = found.groupBy(*card).agg(
        first.alias("first"), F.coalesce(F.bool_or(F.when(~goal, F.col("j.listed_open"))), F.lit(False)).alias("listed_open"), F.bool_or("j.also_done").alias("also_done"),
        late.alias("late"), side(~goal).alias("note"), side(goal).alias("goal"), F.min("method").alias("method"), F.count("*").alias("mentions"),
    )
    names = F.array(F.lit(OPEN), F.lit(DONE), F.lit(NONE))
    evidence = strip(F.regexp_replace(F.col("first.said"), r"(?U)\s+", " "))
    short = F.when(F.length(evidence) <= clip, evidence).otherwise(F.concat(F.substring(evidence, 1, clip - 1), F.lit("…")))
    j = cards.select(*card).distinct().hint("merge").join(out, card, "left")
    no = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    return j.select(
        *card, F.coalesce("first.claim", F.lit(NONE)).alias("claim"), no("listed_open", False), no("also_done", False),
        F.when(F.col("late").isNull(), "").when(F.col("late"), "late_record_only").otherwise("substantive").alias("open_kind"),
        names[F.coalesce("note", F.lit(2))].alias("note_claim"), names[F.coalesce("goal", F.lit(2))].alias("goal_claim"),
        no("method", "none"), no("mentions", 0), F.coalesce(short, F.lit("")).alias("evidence"),
    )
