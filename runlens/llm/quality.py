"""Quality by naive Bayes support vectors.

A text's features are the indicators of its n-grams, hashed: words and pairs of
words, three characters, and up to four shapes of tokens in a row. A shape tells case, length class, digits, which punctuation, and whether
a word repeats the one before it; so what makes a text poor is seen in any
language.

Each indicator is scaled by its log-count ratio between the classes; a linear
model with squared hinge loss is fitted to them by dual coordinate descent and
averaged with the mean size of its weights. Margins of texts that a fold's
model has not seen turn margins into probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import extended, held_out, materialize, mix64

#: Labelled rows that the model is fitted on, those with the least hash of the id.
MAX_SAMPLE = 8_192
#: Buckets of the features.
BUCKETS = 1 << 18
#: Added to the counts of either class.
SMOOTHING = 1.0
#: A feature of fewer labelled texts is not used.
MIN_TEXTS = 3
#: Penalty of the loss, and the share of the fitted weights against their mean size.
COST, SHARE = 1.0, 0.75
EPOCHS, FOLDS = 12, 3
#: Score of a text where only one class or none is known.
UNKNOWN = 0.5
PREDICTED = 0.3
#: Texts scored at once.
FEW = 64

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]+|_+")
#: Tell n-grams of three characters, of words, pairs of words, and one to four shapes apart.
_KIND = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(7)]
_NEXT = np.uint64(0x100000001B3)


@lru_cache(maxsize=1 << 16)
def _facts(token: str) -> int:
    """The hash of a token, and in the upper half that of its shape."""
    if token[0].isalpha():
        case = "X" if token.isupper() and len(token) > 1 else "x" if token[0].islower() else "Xx"
        shape = f"{case}{min(len(token) // 4, 4)}"
    else:
        shape = "0" if token[0].isdigit() else token[:4]
    return zlib.crc32(token.lower().encode()) | zlib.crc32(shape.encode(), 7) << 32


_REPEATED = np.uint64(zlib.crc32(b"=", 7))


def features_of(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, sorted; a text without tokens has none."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32)
    distinct, at = _distinct(tokens)
    facts = np.fromiter(map(_facts, distinct), np.uint64, len(distinct))
    low = facts & np.uint64(0xFFFFFFFF)
    words, shapes = low[at], (facts >> np.uint64(32))[at]
    shapes[1:] = np.where(words[1:] == words[:-1], _REPEATED, shapes[1:])
    chars = np.frombuffer(f" {text} ".lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    parts = [((chars[:-2] << np.uint64(21) | chars[1:-1]) << np.uint64(21) | chars[2:]) ^ _KIND[0]]
    parts += [low ^ _KIND[1], (words[:-1] * _NEXT + words[1:]) ^ _KIND[2]]
    run = shapes
    for k in range(1, 5):
        parts.append(run ^ _KIND[2 + k])
        run = run[:-1] * _NEXT + shapes[k:]
    found = np.sort((mix64(np.concatenate(parts)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return found[np.append(True, found[1:] != found[:-1])]


def _distinct(tokens: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct tokens, and the place of each token among them."""
    place = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    return list(place), np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text last -> the other columns and the features."""
    for batch in batches:
        found = [features_of(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "features"])


def log_ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each bucket; counts: texts with it by class (0, 1). Rare buckets get 0."""
    share = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts))
    return np.where(counts.sum(1) >= MIN_TEXTS, np.log(share[:, 1] / share[:, 0]), 0.0) if texts.min() else np.zeros(len(counts))


def scaled(rows: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, buckets and values of the rows: log-count ratios, each row of length 1; unused buckets are left out."""
    rows = [r[ratio[r] != 0] for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    values = ratio.astype(np.float32)[at]
    norm = np.array([np.linalg.norm(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.float32)
    values /= np.repeat(np.maximum(norm, 1e-12), np.diff(offsets))
    return offsets, at, values


def fit_hinge(offsets: np.ndarray, at: np.ndarray, values: np.ndarray, target: np.ndarray, cost: np.ndarray, width: int, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights of the least |w|^2 / 2 + sum cost * max(0, 1 - y w x)^2, by dual coordinate descent; the last one is the bias.

    target: -1 or 1. cost: of each row.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(target))
    norms = (np.diff(offsets) > 0) + 1.0 + 1 / (2 * cost)  # a row has length 1, and the bias
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(target)):
            a, b = offsets[i], offsets[i + 1]
            place, x = at[a:b], values[a:b]
            slope = target[i] * (w[place] @ x + w[-1]) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - slope / norms[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * target[i]
                w[place] += step * x
                w[-1] += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w


def blend(w: np.ndarray) -> np.ndarray:
    """Between the weights and their mean size, which keeps the log-count ratios' own signs."""
    used = w[:-1] != 0
    mean = np.abs(w[:-1][used]).mean() if used.any() else 0.0
    return np.append(np.where(used, (1 - SHARE) * mean + SHARE * w[:-1], 0.0), w[-1])


def margins(rows: list[np.ndarray], ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    offsets, at, values = scaled(rows, ratio)
    return w[-1] + np.array([values[a:b] @ w[at[a:b]] for a, b in zip(offsets[:-1], offsets[1:])])


def fit_sigmoid(margin: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the probability of class 1 given a margin, by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    t = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta, x = np.array([1.0, np.log((n1 + 1) / (n0 + 1))]), np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta = theta - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def _counts(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.zeros((BUCKETS, 2))
    for r, g in zip(rows, good):
        counts[r, g] += 1
    return counts


def fit(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float] | None:
    """Log-count ratios, weights, slope and offset from features and classes of rows; None without rows of both classes."""
    if not len(good) or good.min() == good.max():
        return None

    def model(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, y = [rows[i] for i in which], good[which]
        ratio = log_ratios(_counts(own, y), np.bincount(y, minlength=2))
        share = np.bincount(y, minlength=2) / len(y)
        cost = COST * 0.5 / share[y]  # both classes weigh alike
        return ratio, blend(fit_hinge(*scaled(own, ratio), np.where(y == 1, 1.0, -1.0), cost, BUCKETS))

    unseen = np.zeros(len(good))
    for fold in range(FOLDS):
        apart = np.arange(len(good)) % FOLDS == fold
        if apart.any() and not apart.all() and good[~apart].min() != good[~apart].max():
            unseen[apart] = margins([rows[i] for i in np.flatnonzero(apart)], *model(np.flatnonzero(~apart)))
    ratio, w = model(np.arange(len(good)))
    return ratio, w, *fit_sigmoid(unseen, good)


def _score_batches(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """text last -> the other columns and the score."""
    ratio, w, slope, offset = model.value
    for batch in batches:
        z = np.zeros(batch.num_rows)
        for at in range(0, batch.num_rows, FEW):
            texts = batch.column(batch.num_columns - 1).slice(at, FEW)
            z[at : at + FEW] = margins([features_of(t.as_py() or "") for t in texts], ratio, w)
        score = 1 / (1 + np.exp(-np.clip(slope * z + offset, -700, 700)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns labels only from ids whose crc32 mod 5 is not 0. Labels that are
    null, other than 0 and 1 or contradictory for an id are left out. Null and
    empty texts are scored as texts without n-grams, by the model's bias alone;
    very long ones by all their n-grams. Without labels of both classes every
    score is UNKNOWN. Repeated rows each get a row; an empty table gives an
    empty result. Ids keep their type; further columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("good"), F.max(label_col).cast("int").alias("most")).where("good = most")
    # the sample is bounded, so its ids can be broadcast
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample).select("doc_id", "good"), "sample")
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("good").alias("good"), F.min("text").alias("text"))
    sample = materialize(texts.mapInArrow(_feature_batches, extended(texts.select("doc_id", "good").schema, features=T.ArrayType(T.IntegerType()))), "sample-features")
    seen = sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("good", "features").toArrow()  # at most max_sample rows
    rows = [np.asarray(f.values, np.int32) for f in seen.column("features")]
    model = fit(rows, np.asarray(seen.column("good"), np.int64))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        scored = out.select("doc_id", "held_out", F.lit(UNKNOWN).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # two numbers for each bucket
        ident = docs.schema["doc_id"].dataType.simpleString()
        scored = out.mapInArrow(partial(_score_batches, model=shared), f"doc_id {ident}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))
