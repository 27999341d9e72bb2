"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed to 64-bit codes. Each code flips
one bit of a sketch of ``m`` blocks of 65,536 bits, so the Hamming distance of
two sketches is at most the symmetric difference of the sets, which in a linked
pair of sizes x and y is at most ``floor((x + y) * (1 - t) / (1 + t))``. A pair
meets in the size band of its larger set. There a set shows its first
``D + 1 + slack`` blocks, where D is the largest difference that it can have
from a set of that band: of the blocks that both sets of a linked pair show, at
least ``slack + 1`` agree (pigeonhole). Documents meet on (band, block, block's
bits). Blocks without a set bit are left out by every document that shows no
more than ``slack`` of them, which loses no pair: of ``slack + 1`` agreeing
blocks one then has bits.

Keys are shuffled once; the few that a large share of all documents have are
handled apart, without a shuffle by key. Members of a bucket are compared with
one centre each, then, where several components are left, with the member that
has most links. Only members that are still in different components afterwards
are paired, a large bucket in cells of two parts, and of those pairs only the
ones leave the join whose 1,024-bit sketches differ in no more bits than a link
allows. All other pairs are held against that bound before their texts are
fetched, too. Every link is verified on exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, materialize, mix64, slices

BITS = np.uint64(0xFFFF)
BAND_GROWTH = 1.5
#: Keys that are looked for among the most frequent ones, and counters of that search.
HOT_KEYS, HOT_COUNTERS = 1000, 10_000
#: Members of a part of a bucket: a larger bucket is paired in cells of two parts each.
PART = 256
#: Sets whose texts are fetched with a broadcast of their ids (two longs each); of more, texts are shuffled.
FETCH = 200_000
#: Edges (of two longs) that one task of a large-star or small-star step reads.
ROWS_A_TASK = 250_000
#: Longs of the sketch that pairs are filtered with.
WIDE = 16
SKETCH = [f"s{i}" for i in range(WIDE)]
#: Sets of more shingles than these have a second sketch of at least two bits a shingle, as WIDE longs are too few to tell them apart.
LONG_FROM = WIDE * 32


class _WordCodes(dict):
    """64-bit code of a word; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def shingle_codes(text: str | None, k: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct codes of the k-word shingles of a text; of the whole sequence if it is shorter."""
    # bytes.lower() and bytes.split() know ASCII only: A-Z, and the six ASCII white-space characters
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n, total = len(h) - k + 1, np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(mix64(total))


@lru_cache(maxsize=4096)
def _band_layout(band: int, num: int, den: int) -> tuple[int, int, int, int]:
    """Smallest and largest size of a band, its number of blocks and the slack."""
    lo = 1 if band == 0 else _band_layout(band - 1, num, den)[1] + 1
    hi = max(lo, int(lo * BAND_GROWTH))
    differ, slack = 2 * hi * (den - num) // (den + num), 0
    for _ in range(8):
        blocks = differ + 1 + slack
        empty = blocks * np.exp(-lo / blocks)
        slack = int(np.ceil(empty + 2 * np.sqrt(empty)))
    return lo, hi, differ + 1 + slack, slack


def _band_of(size: int, num: int, den: int) -> int:
    band = 0
    while _band_layout(band, num, den)[1] < size:
        band += 1
    return band


_band_of = lru_cache(maxsize=65536)(_band_of)


def bucket_keys(codes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys under which a set meets every other set of similarity num/den or more that differs from it."""
    size, keys = len(codes), []
    largest = size * den // num
    for band in range(_band_of(size, num, den), _band_of(largest, num, den) + 1):
        _, hi, blocks, slack = _band_layout(band, num, den)
        differ = (size + min(hi, largest)) * (den - num) // (den + num)
        if differ == 0:
            continue  # no difference is allowed: only equal sets link, and those share their id
        shown = min(blocks, differ + 1 + slack)
        block = ((codes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        bit = mix64((codes & BITS) + np.uint64(1))
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        sketch = np.zeros(blocks, np.uint64)
        sketch[block[starts].astype(np.int64)] = np.bitwise_xor.reduceat(bit, starts)
        sketch = sketch[:shown]
        which = np.flatnonzero(sketch)
        if shown - len(which) > slack:
            which = np.arange(shown)
        place = mix64(which.astype(np.uint64) + np.uint64(band << 32))
        keys.append(mix64(sketch[which] + place))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


def set_names(codes: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    mixed = mix64(codes + np.uint64(0x632BE59BD9B4E019))
    both = np.array([np.bitwise_xor.reduce(mixed), mixed.sum(dtype=np.uint64)], np.uint64)
    first, second = mix64(both), mix64(both ^ np.uint64(0xD6E8FEB86659FD93))
    return tuple(int((x * np.array([1, 3], np.uint64)).sum(dtype=np.uint64).view(np.int64)) for x in (first, second))


def long_sketch(codes: np.ndarray) -> np.ndarray | None:
    """The parity sketch of a large set, of a power of two bits; folding it in half gives the one of half as many."""
    if len(codes) <= LONG_FROM:
        return None
    bits = 1 << (2 * len(codes) - 1).bit_length()
    odd = np.bincount((codes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(codes: np.ndarray) -> np.ndarray:
    """The parity sketch of WIDE * 64 bits."""
    odd = np.bincount((codes % np.uint64(WIDE * 64)).astype(np.int64), minlength=WIDE * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    words, met = _WordCodes(), set()
    for batch in slices(batches):
        sizes, first, second, keys, offsets = [], [], [], [], [0]
        wide, long = np.zeros((WIDE, batch.num_rows), np.int64), []
        for i, text in enumerate(batch.column(1)):
            codes = shingle_codes(text.as_py(), k, words)
            wide[:, i] = wide_sketch(codes)
            long.append(long_sketch(codes))
            sizes.append(len(codes))
            names = set_names(codes) if len(codes) else (None, None)
            first.append(names[0])
            second.append(names[1])
            # of equal sets one shows its keys: the first that this task meets
            known = not len(codes) or names in met
            keys.append(np.empty(0, np.int64) if known else bucket_keys(codes, num, den))
            offsets.append(offsets[-1] + len(keys[-1]))
            if not known:
                if len(met) >= 100_000:  # forgetting costs a repetition, no row
                    met.clear()
                met.add(names)
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists, *map(pa.array, wide), pa.array(long, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "name", "name2", "keys", *SKETCH, "long_sketch"],
        )


def _named_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(expected set id, text) -> the same rows with the names of the text's set."""
    words = _WordCodes()
    for batch in slices(batches):
        names = []
        for text in batch.column(1):
            codes = shingle_codes(text.as_py(), k, words)
            names.append(set_names(codes) if len(codes) else (None, None))
        columns = [*batch.columns, *(pa.array([n[i] for n in names], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(columns, names=["wanted", "text", "name", "name2"])


def _verify_batches(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    words, kept = _WordCodes(), {}

    def codes_of(node: int, text: str) -> np.ndarray:
        if node not in kept:
            if len(kept) >= 64:
                kept.clear()
            kept[node] = shingle_codes(text, k, words)
        return kept[node]

    for batch in batches:
        linked = []
        for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            x, y = codes_of(a, ta.as_py()), codes_of(b, tb.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(den * both >= num * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) for every node of a link; root is the least node of its component.

    Alternates large-star and small-star steps until the edges no longer
    change; both are aggregates and joins, so no component is gathered
    anywhere. Edges are read by one task for every ROWS_A_TASK of them, so the
    last rounds over few edges don't pay for many empty partitions.
    """
    print_of = [F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")]
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    e = materialize(e, "links")
    before = e.agg(*print_of).first()
    while before["n"]:
        tasks = -(-before["n"] // ROWS_A_TASK)
        both = e.coalesce(tasks).selectExpr("inline(array(struct(node as u, root as v), struct(root as u, node as v)))")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        large = materialize(large, "large-star").coalesce(tasks)
        lowest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lowest.hint("merge"), "node").selectExpr("inline(array(struct(root as node, m as root), struct(node as node, m as root)))")
        e = materialize(small.where("node <> root").distinct(), "small-star")
        after = e.agg(*print_of).first()
        if after == before:
            break
        before = after
    return e.unionByName(e.select(F.col("root").alias("node"), "root").distinct())


def _named(clashes: list[int]) -> Column:
    """A set's id: its first name, or, where that stands for several sets, both names."""
    first = F.col("name")
    return F.when(first.isin(clashes), F.xxhash64("name", "name2")).otherwise(first) if clashes else first


def hot_share(rows: int) -> int:
    """Rows of a key beyond which it is hot, of so many rows: one task can well take less."""
    return max(10_000, rows // HOT_COUNTERS)


def bucket_members(sketched: DataFrame) -> DataFrame:
    """(key, center, set_id) of all keys that several sets show; center is the least of them.

    Keys go through one shuffle. Those that stand out among all rows, at most
    HOT_KEYS, are left out of it: their centres are a small aggregate.
    """
    rows = sketched.where("set_id is not null").select(F.explode("keys").alias("key"), "set_id")
    found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(key, {HOT_KEYS}, {HOT_COUNTERS})").alias("top")).first()
    hot = [t["item"] for t in found["top"] or () if t["count"] > hot_share(found["n"])]
    ends = [F.min("set_id").alias("center"), F.max("set_id").alias("other")]

    cold = (rows.where(~F.col("key").isin(hot)) if hot else rows).repartition("key")
    several = cold.groupBy("key").agg(*ends).where("center <> other").select("key", "center")
    members = cold.join(several.hint("merge"), "key")
    if hot:
        centers = rows.where(F.col("key").isin(hot)).groupBy("key").agg(*ends).where("center <> other").select("key", "center")
        members = members.unionByName(rows.where(F.col("key").isin(hot)).join(F.broadcast(centers), "key"))  # at most HOT_KEYS rows
    return materialize(members.select("key", "center", "set_id"), "members")


def _close(num: int, den: int) -> Column:
    """Whether the sketches of two sets x and y of n shingles allow a link."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH])
    allowed = (F.col("x.n") + F.col("y.n")) * (den - num)
    return (differ * (den + num) <= allowed) & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)


def _long_close(num: int, den: int) -> Column:
    """The same by the second sketches, where both sets have one; the longer of two is folded."""
    short = F.least(F.size("x.long_sketch"), F.size("y.long_sketch"))
    halves = [F.slice(f"{side}.long_sketch", start, short) for side in "xy" for start in (F.lit(1), short + 1)]
    folded = [F.zip_with(a, b, lambda p, q: p.bitwiseXOR(F.coalesce(q, F.lit(0)))) for a, b in (halves[:2], halves[2:])]
    differ = F.aggregate(F.zip_with(*folded, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)
    comparable = F.greatest(F.size("x.long_sketch"), F.size("y.long_sketch")) <= 2 * short
    known = F.col("x.long_sketch").isNotNull() & F.col("y.long_sketch").isNotNull()
    return ~known | ~comparable | (differ * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))


def close_pairs(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the rows (key, set_id, root, n and sketch) of a bucket that are in different components and near by their sketches.

    A bucket of many rows is dealt into parts; each pair of parts is a cell of its own.
    """
    parts = mixed.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = mixed.join(parts.hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")}).drop("with", "parts")
    x, y = cells.alias("x"), cells.alias("y")
    apart = (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.root") != F.col("y.root"))
    same = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "low", "high")])
    once = (F.col("x.low") == F.col("x.high")) | (F.col("x.part") != F.col("y.part"))
    return x.join(y.hint("merge"), same & once & apart & _close(num, den)).select(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b"))


def link_documents(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest id reachable over links (Jaccard similarity of
    the k-word shingle sets >= threshold, compared in whole hundredths), the
    document's own included. Texts without words (null, empty, blank) have 0
    shingles and link with nothing. Rows with a null id link like others and
    get their component's smallest id; without one, null. Repeated rows each
    get a row. Ids keep their type. An empty table gives an empty result.
    Columns other than the two named are ignored.
    """
    num, den = round(threshold * 100), 100
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = T.LongType()
    schema = extended(docs.select("doc_id").schema, n_shingles=long, name=long, name2=long, keys=T.ArrayType(long), **{c: long for c in SKETCH}, long_sketch=T.ArrayType(long))
    sketched = materialize(docs.mapInArrow(partial(_sketch_batches, k=k, num=num, den=den), schema), "sketches")
    # names of 64 bits that stand for several sets: about one among 10 billion sets
    clashes = [r["name"] for r in sketched.where("name is not null").groupBy("name").agg(F.min("name2").alias("lo"), F.max("name2").alias("hi")).where("lo <> hi").select("name").collect()]
    sketched = sketched.withColumn("set_id", _named(clashes))
    of_set = [F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), *[F.max(c).alias(c) for c in SKETCH], F.max("long_sketch").alias("long_sketch")]
    sets = materialize(sketched.where("set_id is not null").groupBy("set_id").agg(*of_set), "sets")
    members = bucket_members(sketched)

    def near(pairs: DataFrame) -> DataFrame:
        x, y = sets.alias("x").hint("merge"), sets.alias("y").hint("merge")
        both = pairs.join(x, F.col("a") == F.col("x.set_id")).join(y, F.col("b") == F.col("y.set_id"))
        return both.where(_close(num, den) & _long_close(num, den)).select("a", "b")

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
        by_doc = materialize(wanted.join(sets.hint("merge"), F.col("wanted") == F.col("set_id")).select("wanted", F.col("first_id").alias("doc_id")), "wanted")
        few = by_doc.count() <= FETCH
        fetched = docs.where("doc_id is not null").join(F.broadcast(by_doc) if few else by_doc.hint("merge"), "doc_id").select("wanted", "text")
        if not by_doc.where("doc_id is null").isEmpty():  # sets of rows without an id only
            fetched = fetched.unionByName(docs.where("doc_id is null").select(F.lit(None).cast("long").alias("wanted"), "text"))
        fetched = fetched.mapInArrow(partial(_named_batches, k=k), "wanted long, text string, name long, name2 long")
        fetched = fetched.withColumn("set_id", _named(clashes)).where("set_id = coalesce(wanted, set_id)").select("set_id", "text")
        return materialize(fetched.dropDuplicates(["set_id"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of the pairs that their sketches allow."""
        pairs = materialize(near(pairs), "near")
        texts = texts_of(pairs)
        ta, tb = (texts.select(F.col("set_id").alias(c), F.col("text").alias(f"t{c}")).hint("merge") for c in "ab")
        both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
        return materialize(both.mapInArrow(partial(_verify_batches, k=k, num=num, den=den), "a long, b long, linked boolean"), "tested")

    as_pair = [F.least("center", "set_id").alias("a"), F.greatest("center", "set_id").alias("b")]
    tested = verified(members.where("center <> set_id").select(*as_pair).distinct())
    links = tested.where("linked").select("a", "b")
    roots = connected_components(links)

    members = members.where("center <> set_id")  # a centre has been held against all of its bucket
    for last in (False, True):
        labelled = members.join(roots.select(F.col("node").alias("set_id"), "root").hint("merge"), "set_id", "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
        mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        mixed = materialize(labelled.join(mixed.hint("merge"), "key").distinct(), "mixed")
        if mixed.isEmpty():
            break
        if not last:
            # the member with most links so far is near the middle of its family
            links_of = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
            order = F.struct((-F.coalesce("links", F.lit(0))).alias("few"), F.col("set_id").alias("id"), F.col("root").alias("of"))
            centers = mixed.join(links_of.hint("merge"), "set_id", "left").groupBy("key").agg(F.min(order).alias("c")).select("key", "c.id", "c.of")
            centred = materialize(mixed.join(centers.hint("merge"), "key"), "centred")
            pairs = centred.where("root <> of").select(F.least("id", "set_id").alias("a"), F.greatest("id", "set_id").alias("b"))
            members = centred.where("set_id <> id").select("key", "set_id")  # a bucket of one component stays one
        else:
            pairs = close_pairs(materialize(mixed.join(sets.drop("first_id", "long_sketch").hint("merge"), "set_id"), "mixed-sketches"), num, den)
        new = verified(pairs.distinct().join(tested.select("a", "b").hint("merge"), ["a", "b"], "left_anti"))
        tested = tested.unionByName(new)
        new = new.where("linked").select("a", "b")
        if not new.isEmpty():
            links = links.unionByName(new)
            # the components so far are stars already
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))

    roots = sets.join(roots.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(least.hint("merge"), "root").select("set_id", "component_id")
    out = sketched.select("doc_id", "n_shingles", "set_id").join(named.hint("merge"), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents whose id is their component's smallest: one document of each group stays.

    Rows with a null id stay. An id that occurs several times goes only if it
    goes for each of its rows; else all of its rows stay.
    """
    found = link_documents(docs, k, threshold).where("doc_id is not null")
    drop = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("drop")).where("drop").select("doc_id")
    return docs.join(drop.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def oracle_sql(k: int = 5, threshold: float = 0.8) -> str:
    """``link_documents`` of documents with unique ids in SQL: all pairs that share a shingle, on sets of strings."""
    num = round(threshold * 100)
    words = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"""
    return f"""
    with recursive docs as (select doc_id, {words} as ws from documents),
    shingles as (
      select distinct doc_id, array_to_string(list_slice(ws, p, p + {k - 1}), ' ') as s
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {k}, 0) + 2)) as p from docs where len(ws) > 0)),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    -- of equal sets one stands for all
    prints as (select doc_id, md5(string_agg(s, chr(10) order by s)) as print from shingles group by doc_id),
    nodes as (select print, min(doc_id) as node from prints group by print),
    pairs as (
      select a.doc_id as x, b.doc_id as y, count(*) as both_have
      from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
      where a.doc_id in (select node from nodes) and b.doc_id in (select node from nodes)
      group by a.doc_id, b.doc_id),
    links as (
      select x, y from pairs join sizes a on a.doc_id = x join sizes b on b.doc_id = y
      where 100 * both_have >= {num} * (a.n + b.n - both_have)),
    reached as (
      select node as x, node as y from nodes
      union
      select r.x, l.y from reached r join links l on l.x = r.y),
    least as (select x, min(y) as root from reached group by x)
    select doc_id, coalesce(n, 0) as n_shingles, coalesce(root, doc_id) as component_id
    from docs left join sizes using (doc_id) left join prints using (doc_id) left join nodes using (print) left join least on least.x = node"""
