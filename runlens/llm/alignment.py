"""Alignment of two tokenizers' tokens by a monoid of fragments.

Tokens of A and B tile the same bytes. A byte offset where both have a token's
end cuts them into groups. A byte range of a text, holding the tokens that end
in it, is a fragment: an open prefix (up to its first cut), closed groups and
an open suffix (after its last cut); without a cut all of it is prefix.
Neighbouring fragments compose, and it does not matter in which order, so very
long texts are cut into ranges that tasks encode apart from each other, and a
tree of shuffles composes the fragments. Texts of at most ``CHUNK`` characters
are one fragment.

Each range is encoded together with the text up to a safe place on either
side: a space between two ASCII letters, where both tokenizers begin a token
whatever stands elsewhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import SLICE, materialize, slices

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a range.
CHUNK = 1 << 16
#: Fragments composed by one group of a step.
FAN = 8
#: Pairs at most whose counts every task gets; those of the rest are joined.
FREQUENT = 1 << 20
#: Distinct pairs that a counting task holds at once.
HELD = 1 << 21

_SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class Side:
    """A tokenizer's ids of a text that begins with a space, and the bytes of its ids."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.lengths = np.array([len(t) for t in table], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def _printable() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """Byte-level BPE from a tokenizer file whose ids are the ranks of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = _printable()
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    if any(model["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    table = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        table[i] = t
    bpe = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [np.asarray(bpe.encode_ordinary(t), np.int64) for t in texts], table)


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A piece model that puts a space before a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(model.id_to_piece(list(range(n))))]
    return Side(lambda texts: [np.asarray(ids, np.int64) for ids in model.encode([t[1:] for t in texts], num_threads=1)], table)


def cut_ranges(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, window start, window end) of the ranges of a text that begins with a space.

    A cut follows another only if a safe place lies between them; so a stretch
    without any is encoded for two ranges at most, however long it is.
    """
    safe = np.fromiter((m.start() for m in _SAFE.finditer(text)), np.int64)
    cuts, lows, highs = [0], [0], []
    for at in range(size, len(text), size):
        i = int(np.searchsorted(safe, at))  # safe[i - 1] lies before the cut, safe[i] not
        if i and safe[i - 1] >= cuts[-1] and safe[i - 1] > lows[-1]:
            cuts.append(at)
            lows.append(int(safe[i - 1]))
            highs.append(int(safe[i]) if i < len(safe) else len(text))
    return list(zip(cuts, [*cuts[1:], len(text)], lows, [*highs, len(text)]))


def both_ends(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ea: its place in eb (the first end not before it), and whether it stands there."""
    at = np.searchsorted(eb, ea)
    return at, (at < len(eb)) & (eb[np.minimum(at, max(len(eb) - 1, 0))] == ea) if len(eb) else np.zeros(len(ea), bool)


def align(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two tilings of the same bytes: tokens of A and of B at each link, and each token's group on either side."""
    at, common = both_ends(ea, eb)
    low = np.concatenate([[0], (at + common)[:-1]])
    n = at + 1 - low
    total = int(n.sum())
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    group_a = np.cumsum(common) - common
    ends = np.zeros(len(b), np.int64)
    ends[at[common]] = 1
    return left, right, group_a, np.cumsum(ends) - ends


def render(a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The strings of the tokens in order, group after group: A's tokens, ``|``, B's tokens, ``;``.

    names: at id * 3 + kind the id with a comma, bar or semicolon after it.
    """
    out = np.empty(len(a) + len(b), object)
    n = int(ga[-1]) + 1 if len(ga) else 0
    na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
    last_a = np.concatenate([ga[1:] != ga[:-1], [True]]) if len(a) else np.zeros(0, bool)
    last_b = np.concatenate([gb[1:] != gb[:-1], [True]]) if len(b) else np.zeros(0, bool)
    out[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = names[a * 3 + last_a]
    out[np.arange(len(b)) + np.cumsum(na)[gb]] = names[b * 3 + 2 * last_b]
    return out


@lru_cache(maxsize=2)
def token_names(n: int) -> np.ndarray:
    return np.array([f"{i}{c}" for i in range(n) for c in ",|;"], object)


def _fragments(texts: list[str], lows: np.ndarray, highs: np.ndarray, a_path: str, b_path: str) -> list[tuple]:
    """Fragments of windows that begin with a space: the tokens ending in bytes (low, high] of each.

    A fragment: valid, cut, tokens of A and of B, groups, text of the groups
    (with a last semicolon), codes of their links in any order, then ids of A
    and B in the prefix and in the suffix.
    """
    one, two = byte_level(a_path), pieces(b_path)
    names, width = token_names(max(len(one.table), len(two.table))), len(two.table)
    out = []
    for text, a, b, lo, hi in zip(texts, one.encode(texts), two.encode(texts), lows, highs):
        raw = text.encode()
        none = np.zeros(0, np.int64)
        if one.joined(a) != raw or two.joined(b) != raw:
            out.append((False, False, 0, 0, 0, "", none, none, none, none, none))
            continue
        ea, eb = np.cumsum(one.lengths[a]), np.cumsum(two.lengths[b])
        ka, kb = slice(*np.searchsorted(ea, [lo, hi], "right")), slice(*np.searchsorted(eb, [lo, hi], "right"))
        out.append(_fragment(a[ka], ea[ka], b[kb], eb[kb], names, width))
    return out


def _fragment(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, names: np.ndarray, width: int) -> tuple:
    at, common = both_ends(ea, eb)
    cuts = np.flatnonzero(common)
    if not len(cuts):
        return (True, False, len(a), len(b), 0, "", a[:0], a, b, a[:0], b[:0])
    fa, la, fb, lb = cuts[0] + 1, cuts[-1] + 1, at[cuts[0]] + 1, at[cuts[-1]] + 1
    groups, shown, codes = close(a[fa:la], ea[fa:la], b[fb:lb], eb[fb:lb], names, width)
    return (True, True, len(a), len(b), groups, shown, codes, a[:fa], b[:fb], a[la:], b[lb:])


def close(a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray, names: np.ndarray, width: int) -> tuple[int, str, np.ndarray]:
    """Number, text and link codes (id of A * width + id of B) of the groups of two tilings of the same bytes."""
    if not len(a):
        return 0, "", a
    left, right, ga, gb = align(a, ea, b, eb)
    return int(ga[-1]) + 1, "".join(render(a, ga, b, gb, names)), a[left] * width + b[right]


def compose(x: tuple, y: tuple, one: Side, two: Side) -> tuple:
    """The fragment of x followed by y."""
    names, width = token_names(max(len(one.table), len(two.table))), len(two.table)
    ok, n_a, n_b = x[0] and y[0], x[2] + y[2], x[3] + y[3]
    if not ok:
        none = np.zeros(0, np.int64)
        return (False, False, 0, 0, 0, "", none, none, none, none, none)
    cat = lambda p, q: np.concatenate([p, q])
    if not x[1]:
        return (True, y[1], n_a, n_b, *y[4:7], cat(x[7], y[7]), cat(x[8], y[8]), *y[9:])
    a, b = cat(x[9], y[7]), cat(x[10], y[8])
    if not y[1]:
        return (True, True, n_a, n_b, *x[4:9], a, b)
    groups, shown, codes = close(a, np.cumsum(one.lengths[a]), b, np.cumsum(two.lengths[b]), names, width)
    return (True, True, n_a, n_b, x[4] + groups + y[4], x[5] + shown + y[5], np.concatenate([x[6], codes, y[6]]), x[7], x[8], y[9], y[10])


def whole(x: tuple, one: Side, two: Side) -> tuple:
    """valid, n_a, n_b, n_groups, text of the groups, and link codes of a fragment that is a whole text: its prefix is closed."""
    if not x[0]:
        return False, 0, 0, 0, "", x[6]
    groups, shown, codes = close(x[7], np.cumsum(one.lengths[x[7]]), x[8], np.cumsum(two.lengths[x[8]]), token_names(max(len(one.table), len(two.table))), len(two.table))
    return True, x[2], x[3], groups + x[4], (shown + x[5])[:-1], np.concatenate([codes, x[6]])


_IDS = T.ArrayType(T.IntegerType())
_CODES = T.ArrayType(T.LongType())
_FRAGMENT = [("ok", T.BooleanType()), ("cut", T.BooleanType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("shown", T.StringType()), ("codes", _CODES), ("pa", _IDS), ("pb", _IDS), ("sa", _IDS), ("sb", _IDS)]


def _fragment_type(ident: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in [("key", T.LongType()), ("chunk", T.LongType()), ("doc_id", ident), *_FRAGMENT]])


def _aligned_type(ident: T.DataType) -> T.StructType:
    fields = [("doc_id", ident), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()), ("codes", _CODES), ("times", _IDS)]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), kind))


def _fragment_batch(head: list[pa.Array], found: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*found)] or [[] for _ in _FRAGMENT]
    kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [_lists(columns[6], pa.int64())] + [_lists(c, pa.int32()) for c in columns[7:]]
    return pa.RecordBatch.from_arrays([*head, *arrays], names=["key", "chunk", "doc_id", *(n for n, _ in _FRAGMENT)])


def _whole_batch(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    codes, times = [], []
    for x in found:
        c, n = np.unique(x[5], return_counts=True)
        codes.append(c)
        times.append(n)
    numbers = [[x[1] for x in found], [x[2] for x in found], [x[3] for x in found], [len(x[5]) for x in found]]
    arrays = [ids, *(pa.array(n, pa.int64()) for n in numbers), pa.array([x[4] for x in found], pa.string()), _lists(codes, pa.int64()), _lists(times, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes", "times"])


#: Texts aligned at once.
FEW = 64


def _short_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    one, two = byte_level(a_path), pieces(b_path)
    for batch in batches:
        for start in range(0, batch.num_rows, FEW):
            part = batch.slice(start, FEW)
            texts = part.column(1).to_pylist()
            full = [" " + t for t in texts if t]
            made = iter(_fragments(full, np.zeros(len(full), np.int64), np.array([len(t.encode()) for t in full], np.int64), a_path, b_path))
            none = (False, 0, 0, 0, "", np.zeros(0, np.int64))
            yield _whole_batch(part.column(0), [whole(next(made), one, two) if t else none for t in texts])


def _range_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) -> key, chunk, doc_id, low, high, window; a text's ranges in batches of their own."""
    for batch in batches:
        for row, key in enumerate(batch.column(0).to_pylist()):
            text = " " + batch.column(2)[row].as_py()
            cut = cut_ranges(text, size)
            windows = [text[q:r] for _, _, q, r in cut]
            lows = [len(text[q:s].encode()) for s, _, q, _ in cut]
            highs = [lo + len(text[s:e].encode()) for lo, (s, e, _, _) in zip(lows, cut)]
            for i in range(0, len(cut), FEW):
                n = len(windows[i : i + FEW])
                place = [pa.array([key] * n, pa.int64()), pa.array(range(i, i + n), pa.int64()), batch.column(1).take(pa.array([row] * n))]
                window = [pa.array(lows[i : i + FEW], pa.int64()), pa.array(highs[i : i + FEW], pa.int64()), pa.array(windows[i : i + FEW], pa.string())]
                yield pa.RecordBatch.from_arrays([*place, *window], names=["key", "chunk", "doc_id", "low", "high", "window"])


def _long_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, FEW):
            part = batch.slice(start, FEW)
            found = _fragments(part.column(5).to_pylist(), part.column(3).to_numpy(), part.column(4).to_numpy(), a_path, b_path)
            yield _fragment_batch(part.columns[:3], found)


def _read(batch: pa.RecordBatch, i: int) -> tuple:
    head = [batch.column(c)[i].as_py() for c in ("ok", "cut", "n_a", "n_b", "n_groups", "shown")]
    return (*head, *(np.asarray(batch.column(c)[i].values, np.int64) for c in ("codes", "pa", "pb", "sa", "sb")))


def _compose_group(group: pa.Table, a_path: str, b_path: str) -> pa.Table:
    """At most FAN fragments of a text -> one."""
    batch = group.combine_chunks().sort_by("chunk").to_batches()[0]
    one, two = byte_level(a_path), pieces(b_path)
    made = _read(batch, 0)
    for i in range(1, batch.num_rows):
        made = compose(made, _read(batch, i), one, two)
    head = [pa.array([batch.column("key")[0].as_py()], pa.int64()), pa.array([batch.column("chunk")[0].as_py() // FAN], pa.int64()), batch.column("doc_id").slice(0, 1)]
    return pa.Table.from_batches([_fragment_batch(head, [made])])


def _finish_batches(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    one, two = byte_level(a_path), pieces(b_path)
    for batch in batches:
        for i in range(batch.num_rows):
            yield _whole_batch(batch.column("doc_id").slice(i, 1), [whole(_read(batch, i), one, two)])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of distinct codes -> (code, n), summed as far as HELD codes allow."""

    def emit(held):
        codes, sums = held
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(sums, pa.int64())], names=["code", "n"])

    def merge(codes, counts):
        c, at = np.unique(np.concatenate(codes), return_inverse=True)
        return c, np.bincount(at, weights=np.concatenate(counts), minlength=len(c)).astype(np.int64)

    codes, counts, size = [], [], 0
    for batch in slices(batches):
        c, n = np.unique(np.asarray(batch.column(0).flatten(), np.int64), return_counts=True)
        codes, counts, size = [*codes, c], [*counts, n], size + len(c)
        if size > HELD:
            held = merge(codes, counts)
            if len(held[0]) > HELD // 2:
                yield emit(held)
                codes, counts, size = [], [], 0
            else:
                codes, counts, size = [held[0]], [held[1]], len(held[0])
    if size:
        yield emit(merge(codes, counts))


def _look_up_batches(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, codes, times) -> key, n_best and count_sum of the frequent pairs, and the codes and times of the rest."""
    known, counts, best = shared.value
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, SLICE):
            batch = whole_batch.slice(start, SLICE)
            codes, times = np.asarray(batch.column(1).flatten(), np.int64), np.asarray(batch.column(2).flatten(), np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(1))))
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            n, top = counts[at[hit]], best[at[hit]]
            sums, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], n * times[hit])
            np.add.at(tops, row[hit], times[hit] * top)
            rest = np.bincount(row[~hit], minlength=batch.num_rows)
            parts = np.cumsum(rest)[:-1]
            columns = [batch.column(0), pa.array(tops), pa.array(sums), _lists(np.split(codes[~hit], parts), pa.int64()), _lists(np.split(times[~hit], parts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_best", "count_sum", "codes", "times"])


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, and codes and times of the distinct links of every row.

    A link's code is its id of A times the number of B's ids, plus its id of B.
    """
    paths = _paths(a_path, b_path)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ident = given.schema["doc_id"].dataType
    schema, pieces_of = _aligned_type(ident), _fragment_type(ident)
    is_long = F.coalesce(F.length("text"), F.lit(0)) > CHUNK
    short = given.where(~is_long).mapInArrow(partial(_short_batches, **paths), schema)

    window = T.StructType([*pieces_of.fields[:3], T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("window", T.StringType())])
    ranges = given.where(is_long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(partial(_range_batches, size=CHUNK), window)
    # ranges of one text are dealt over the tasks
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = materialize(ranges.repartition(parts, "key", "chunk").mapInArrow(partial(_long_batches, **paths), pieces_of), "fragments")
    deepest = level.agg(F.max("chunk")).first()[0] or 0
    while deepest > 0:
        level = materialize(level.groupBy("key", F.floor(F.col("chunk") / FAN).alias("part")).applyInArrow(lambda group: _compose_group(group, **paths), pieces_of), "fragments")
        deepest //= FAN
    return short.unionByName(level.mapInArrow(partial(_finish_batches, **paths), schema))


def _paths(a_path: str | None, b_path: str | None) -> dict[str, str]:
    return {"a_path": str(a_path or public_tokenizers.path(A_FILE)), "b_path": str(b_path or public_tokenizers.path(B_FILE))}


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, n: how many rows hold each pair linked, as a table."""
    return materialize(aligned.select("codes").mapInArrow(_count_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs")


def least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` pairs have that count at least."""
    sizes = {r.size: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).count().collect()}  # at most 63 rows
    least = max(sizes, default=0) + 1
    held = 0
    while least > 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens do not stand for a space and
    the text, have zeros and an empty groups_sha256. Repeated rows each get a
    row and count as documents of their own. Ids keep their type and may be
    null. Very long texts are encoded by ranges. An empty table gives an empty
    result. Further columns are left out.
    """
    spark = docs.sparkSession
    paths = _paths(a_path, b_path)
    width = len(pieces(paths["b_path"]).table)
    narrow = width * len(byte_level(paths["a_path"]).table) < 1 << 31
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    columns = [F.monotonically_increasing_id().alias("key"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, F.col("codes").cast("array<int>" if narrow else "array<long>"), "times"]
    aligned = materialize(align_texts(docs, id_col, text_col, a_path, b_path).select(*columns), "aligned")
    counts = pair_counts(aligned)
    of_a: Column = F.expr(f"code div {width}")
    # one row for each id of A: bounded by its vocabulary
    best = materialize(counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most")), "best")
    judged = counts.join(F.broadcast(best), of_a == F.col("a")).select("code", "n", (F.col("n") == F.col("most")).cast("int").alias("top"))
    least = least_frequent(counts, FREQUENT)
    frequent = judged.where(F.col("n") >= least).toArrow().sort_by("code")  # at most FREQUENT rows
    known, n, top = (np.asarray(frequent.column(c)) for c in ("code", "n", "top"))
    shared = spark.sparkContext.broadcast((known, n, top.astype(np.int64)))
    seen = materialize(aligned.select("key", "codes", "times").mapInArrow(partial(_look_up_batches, shared=shared), "key long, n_best long, count_sum long, codes array<long>, times array<int>"), "looked-up")
    rare = seen.select("key", F.explode(F.arrays_zip("codes", "times")).alias("link")).select("key", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))
    rare = rare.hint("merge").join(judged.where(F.col("n") < least), "code").groupBy("key")
    rare = rare.agg(F.sum(F.col("times") * F.col("top")).alias("best_rest"), F.sum(F.col("times") * F.col("n")).alias("sum_rest"))
    summed = seen.select("key", "n_best", "count_sum").hint("merge").join(rare, "key", "left")
    out = aligned.drop("codes", "times").hint("merge").join(summed, "key")
    total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "best_rest"), total("count_sum", "sum_rest"), "groups_sha256")
