"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``size`` consecutive words. All words of a
window must occur, so its necessary prefix under an order by rarity is one
word: its rarest in the corpus (the leftmost on a tie). Documents are joined on
that word only; the word's place in the window bounds where the window can lie
(positional bound) and how many words must stand around it (length bound).
Every document word is joined together with the stretch of words around it, so
the words that must stand there are compared in the join itself. Windows of an item
that share their rarest word are one candidate: the compared words tell which
of them occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import materialize, word_array, word_places

WINDOW_WORDS = 10
#: Rows of the items' words and anchors, and their words in bytes, that may be broadcast; beyond, they are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of ``a`` equal those of ``b``."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(first == 0, F.size(a)).otherwise((first - 1).cast("int"))


def _hinted(side: DataFrame, chars: Column) -> DataFrame:
    """``side`` with a join hint by its size."""
    rows, size = side.agg(F.count("*"), F.sum(chars)).first()
    return F.broadcast(side) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else side.hint("merge")


def anchors(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """item_id, word, at (its place), low and high (first and last window start), length, lefts, rights.

    lefts are the words before the anchor that its windows reach, the nearest first; rights those after it.
    """
    items = items.select("item_id", word_array(F.col("text")).alias("iw")).where("size(iw) > 0").distinct()
    items = items.withColumn("row", F.xxhash64("item_id", "iw"))
    vocabulary = materialize(items.select(F.explode("iw").alias("word")).distinct(), "item-words")
    words = docs.select(F.explode(F.array_distinct(word_array(F.col("text")))).alias("word"))
    counted = words.join(_hinted(vocabulary, F.length("word")), "word").groupBy("word").agg(F.count("*").alias("df"))
    placed = items.select("row", F.size("iw").alias("n"), F.posexplode("iw").alias("at", "word")).join(counted.hint("merge"), "word", "left")
    length = F.least(F.lit(size), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - length + 1), F.least(F.col("at"), F.col("n") - length))
    per_window = placed.withColumn("start", F.explode(starts)).groupBy("row", "start").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at")).alias("m"))
    shared = per_window.groupBy("row", F.col("m.at").alias("at")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    found = shared.join(items.hint("merge"), "row").withColumn("length", F.least(F.lit(size), F.size("iw")))
    return found.select(
        "item_id", F.expr("iw[at]").alias("word"), "at", "low", "high", "length",
        F.reverse(F.slice("iw", F.col("low") + 1, F.col("at") - F.col("low"))).alias("lefts"),
        F.slice("iw", F.col("at") + 2, F.col("high") + F.col("length") - 1 - F.col("at")).alias("rights"),
    )


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, text_hash, item_id, start, end (words from 0, end excluded) of runs of occurring windows.

    docs: doc_id, text. items: item_id, text.
    """
    index = materialize(anchors(docs, items, size), "anchors")
    index = _hinted(index, F.length("word") + F.length(F.concat_ws(" ", "lefts", "rights")))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_array(F.col("text")).alias("words"))
    placed = word_places(keyed, size - 1).withColumnRenamed("at", "here")
    met = placed.join(index, "word")
    ahead = F.least(F.col("here"), F.size("lefts"))
    left = _run(F.col("lefts"), F.reverse(F.slice("near", F.col("here") - ahead + 1, ahead)))
    right = _run(F.col("rights"), F.slice("near", F.col("here") + 2, F.size("rights")))
    first, last = F.greatest("low", F.col("at") - left), F.least(F.col("high"), F.col("at") + right - F.col("length") + 1)
    found = met.select("doc_id", "text_hash", "item_id", "pos", "at", "length", first.alias("first"), last.alias("last")).where("first <= last")
    return found.select("doc_id", "text_hash", "item_id", F.expr("pos - at + first").alias("start"), F.expr("pos - at + last + length").alias("end"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit. Null and empty texts have
    no words; items without words have no windows. An item with a null id hits
    words but is in no list. Repeated items count once. Rows with equal id and
    text get equal rows. Without documents the result is empty; without items
    nothing is hit.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    found = occurrences(docs, items, size).distinct()
    along = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(along), F.lit(0))))
    ids = F.collect_set(F.col("item_id").cast("string"))
    hit = found.withColumn("new", new).groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.sum("new").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.array_join(F.array_sort(ids), ",").alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    same = [F.col("doc_id").eqNullSafe(F.col("hit_id")), F.col("text_hash") == F.col("hit_hash")]
    n_hit = F.coalesce("n_hit", F.lit(0))
    return rows.join(hit.hint("merge"), same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs; rows with a null id are judged like others."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hit = occurrences(texts, items.select("item_id", "text"), size).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = [F.col("doc_id").eqNullSafe(F.col("__id")), F.xxhash64("text") == F.col("__hash")]
    return docs.join(hit.hint("merge"), same, "left_anti")


def oracle_sql(size: int = WINDOW_WORDS) -> str:
    """``contamination`` of documents and benchmark in SQL: every window against every run of words, without a prefix."""
    words = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
    return f"""
    with docs as (select row_number() over () as rid, doc_id, {words} as ws from documents),
    items as (select item_id, {words} as ws from benchmark),
    windows as (
      select distinct item_id, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') as gram
      from (select item_id, ws, least({size}, len(ws)) as n, unnest(range(1, greatest(len(ws) - {size}, 0) + 2)) as p from items where len(ws) > 0)),
    grams as (
      select rid, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') as gram
      from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as p from docs, (select distinct n from windows))),
    met as (select rid, item_id, p, n from grams join windows using (n, gram)),
    hit as (select rid, count(distinct q) as n_hit from (select rid, unnest(range(p, p + n)) as q from met) group by rid),
    named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from met where item_id is not null) group by rid)
    select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs left join hit using (rid) left join named using (rid)"""
