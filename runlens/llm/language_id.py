"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points; letters are lower-cased and everything else is one
space. Every run of 1 to 3 code points is hashed to one of ``BUCKETS`` columns.
The counts of all labelled training texts are summed by Spark. The matrix of
log probabilities is broadcast in blocks of languages, each of bounded size,
and batches of texts are scored against one block after another in numpy. A
language's share of the training texts is its prior.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, held_out, materialize, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of a block: its matrix has at most BLOCK_LANGS * BUCKETS * 4 bytes (16 MB).
BLOCK_LANGS = 128
#: Texts are handled in pieces of so many characters at most, whatever a batch or a text holds.
PIECE = 1 << 17
#: n-grams, beside those of a piece, that are looked up at once.
GATHER = 1 << 17
#: n-grams that count in full for the score; beyond, each counts less, so that the score does not saturate.
FULL_WEIGHT = 60
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _points(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, order, np.uint32)
    for i in range(order):
        h = (h ^ points[i : i + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h % np.uint32(BUCKETS)).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that share an n-gram's length less one, so that every n-gram is in one piece."""
    step = PIECE - max(ORDERS) + 1
    for at in range(0, max(1, len(text)), step):
        yield text[at : at + PIECE]


def text_counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for i, piece in enumerate(_pieces(text)):
        points = _points(piece)
        for order in ORDERS:
            h = _hashes(points, order)
            if i:
                h = h[max(ORDERS) - order :]  # those that lie in the piece before are counted there
            total += np.bincount(h, minlength=BUCKETS)
    return total


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, bucket, n), summed over many texts; bucket -1 counts the texts."""

    def partial_sums() -> Iterator[pa.RecordBatch]:
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at - 1), pa.array(counts[at])], names=["lang", "bucket", "n"])
        sums.clear()

    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in sums:
                if len(sums) >= BLOCK_LANGS:
                    yield from partial_sums()
                sums[lang] = np.zeros(BUCKETS + 1, np.int64)
            sums[lang][0] += 1
            t = text.as_py()
            if t:
                sums[lang][1:] += text_counts(t)
    yield from partial_sums()


#: Languages, their log priors and the matrix (buckets x languages) of log probabilities.
Block = tuple[list[str], np.ndarray, np.ndarray]


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Block]:
    """The model in blocks of languages in ascending order, from all rows with a language."""
    rows = train.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(rows.mapInArrow(_count_batches, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    texts = {r["lang"]: r["n"] for r in counts.where("bucket = -1").select("lang", "n").toLocalIterator()}  # a number for each language
    names, total, model = sorted(texts), sum(texts.values()), []
    for first in range(0, len(names), BLOCK_LANGS):
        langs = names[first : first + BLOCK_LANGS]
        found = counts.where(F.col("lang").between(langs[0], langs[-1]) & (F.col("bucket") >= 0)).toPandas()  # at most BLOCK_LANGS * BUCKETS rows
        matrix = np.full((BUCKETS, len(langs)), 0.5)
        np.add.at(matrix, (found["bucket"].to_numpy(np.int64), np.searchsorted(langs, found["lang"].to_numpy(str)) if len(found) else []), found["n"].to_numpy(np.float64))
        model.append((langs, np.log([texts[x] / total for x in langs]), np.log(matrix / matrix.sum(axis=0)).astype(np.float32)))
    return model


def ngram_hashes(text: str | None) -> tuple[Iterator[np.ndarray], bool]:
    """The buckets of a text's n-grams, piece by piece, and whether it has a letter."""

    def hashes() -> Iterator[np.ndarray]:
        for i, piece in enumerate(_pieces(text or "")):
            points = _points(piece)
            for order in ORDERS:
                h = _hashes(points, order)
                yield h[max(ORDERS) - order :] if i else h

    return hashes(), any(bool((_points(piece) != 32).any()) for piece in _pieces(text or ""))


def score_texts(texts: list[str | None], blocks: Iterable[Block]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its share of the (tempered) likelihood.

    Texts are gathered to some GATHER n-grams; their n-grams pick rows of each
    language's column, which are summed text by text.
    """
    lettered = np.zeros(len(texts), bool)
    grams, owners, held = [], [], 0
    n = np.zeros(len(texts))
    blocks = list(blocks)
    sums = [np.tile(prior, (len(texts), 1)) for _, prior, _ in blocks]

    def add_up() -> None:
        if grams:
            h, starts = np.concatenate(grams), np.r_[0, np.cumsum([len(g) for g in grams])[:-1]]
            for total, (_, _, matrix) in zip(sums, blocks):
                for j in range(matrix.shape[1]):
                    np.add.at(total[:, j], owners, np.add.reduceat(matrix[:, j][h], starts, dtype=np.float64))
            grams.clear()
            owners.clear()

    for i, text in enumerate(texts):
        parts, lettered[i] = ngram_hashes(text)
        for h in parts if lettered[i] else ():
            if len(h):
                grams.append(h)
                owners.append(i)
                n[i] += len(h)
                held += len(h)
            if held > GATHER:
                add_up()
                held = 0
    add_up()

    names, scores = [], []
    best = np.full(len(texts), -np.inf)
    name = [UNKNOWN] * len(texts)
    for (langs, _, _), total in zip(blocks, sums):
        for i in np.flatnonzero(total.max(axis=1) > best):  # a later block must be better, so ties go to the first name
            best[i], name[i] = total[i].max(), langs[int(total[i].argmax())]
    weight = np.minimum(1.0, FULL_WEIGHT / np.maximum(n, 1))
    likelihood = sum((np.exp((total - best[:, None]) * weight[:, None]).sum(axis=1) for total in sums), np.zeros(len(texts)))
    for i in range(len(texts)):
        known = bool(lettered[i]) and bool(blocks)
        names.append(name[i] if known else UNKNOWN)
        scores.append(float(1 / likelihood[i]) if known else 0.0)
    return names, scores


def _score_batches(batches: Iterator[pa.RecordBatch], model: list[Broadcast], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    blocks = [m.value for m in model]
    for batch in slices(batches):
        found, scores = [], []
        text = batch.column(batch.num_columns - 1)
        for at in range(0, len(text), 256):
            a, b = score_texts(text.slice(at, 256).to_pylist(), blocks)
            found += a
            scores += b
        columns = [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names])


def predict(docs: DataFrame, model: list[Block], keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of every row, then the language and the score, under ``names``."""
    cast = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = extended(docs.select(*keep).schema, **dict(zip(names, (T.StringType(), T.DoubleType()))))
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(block) for block in model]  # each of a bounded size, at most BLOCK_LANGS * BUCKETS numbers
    return cast.mapInArrow(partial(_score_batches, model=shared, names=names), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from all rows with a language whose crc32(id) mod 5 is not 0. A text
    that is null or has no letter is ``und`` with score 0, as is every text if
    nothing could be learned. Ties go to the language that sorts first.
    Repeated rows each get a row; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"])
