"""Toxicity by weak supervision.

Voters. Lexicons are induced from a bounded sample of labelled training rows:
words, and beginnings that one or several words have, that stand in toxic texts
far more often than in others (signed likelihood ratio), dealt over ``LEXICONS`` voters by their hash,
beside a small seed list and three pattern voters. A voter votes toxic if one
of its terms or its pattern occurs.

Label model. The votes of all documents are counted by their pattern (at most
2 ** voters rows). EM over a two-class model estimates each voter's accuracy in
both classes, with the labelled rows' classes held fixed. Voters that agree
within a class more often than independent ones would are correlated; a
cluster of them shares one vote's weight.

Classifier. A logistic regression over the lexicon's terms and the patterns is
trained on the posteriors of the sampled rows and scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import held_out, materialize

# The seed lexicon.
SEEDS = ("asshole", "bastard", "bitch", "clown", "cunt", "disgusting", "dumb", "fool", "freak", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "pig", "scum", "stupid", "trash", "worthless")
LEXICONS = 8
VOTERS = LEXICONS + 4
#: Labelled rows that the lexicon and the classifier are fitted on, those with the least hash of the id.
MAX_SAMPLE = 20_000
#: Terms of the lexicon, those with the highest likelihood ratio.
MAX_TERMS = 4096
MIN_RATIO = 14.0
MIN_TOXIC = 3
PREFIXES = (4, 5, 6)
#: Distinct words of one beginning that are told apart.
MOST = 4
#: Share of the texts with a term that are toxic, at least.
MIN_PRECISION = 0.6
#: Share of toxic texts assumed where no label is known.
PRIOR = 0.1
CORRELATED = 0.3

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = (re.compile(r"!{3,}"), re.compile(r"\b[Yy]ou(?:'re| are) (?:an? |so |such )"), re.compile(r"(?:\b[A-Z]{3,}\b[\s!?.,]*){4,}"))


def _terms(words: set[str], starts: set[str] | None = None) -> set[str]:
    """The words, and their beginnings with a * for each distinct word that has it (at most MOST).

    starts: only these beginnings.
    """
    seen: dict[str, int] = {}
    for w in words:
        for k in PREFIXES:
            if len(w) > k and (starts is None or w[:k] in starts):
                seen[w[:k]] = seen.get(w[:k], 0) + 1
    return words | {p + "*" * m for p, n in seen.items() for m in range(1, min(n, MOST) + 1)}


def terms_of(text: str) -> set[str]:
    return _terms(set(_WORD.findall(text.lower())))


def _hits(text: str, index: dict[str, int], starts: set[str]) -> list[int]:
    """Features of a text: positions of the lexicon's terms, then of the seeds' and the patterns' voters."""
    low = set(_WORD.findall(text.lower()))
    found = {index[t] for t in _terms(low, starts) if t in index}
    n = len(index)
    if not low.isdisjoint(SEEDS):
        found.add(n)
    found |= {n + 1 + i for i, p in enumerate(_PATTERNS) if p.search(text)}
    return sorted(found)


def _votes(features: list[int], voter: np.ndarray) -> int:
    mask = 0
    for f in features:
        mask |= 1 << int(voter[f])
    return mask


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (term, toxic, n) summed over a batch."""
    for batch in batches:
        sums: dict[tuple[str, int], int] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for t in terms_of(text.as_py() or ""):
                sums[t, toxic] = sums.get((t, toxic), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())],
            names=["term", "toxic", "n"],
        )


def _feature_batches(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    """text last -> the other columns, the vote pattern and the features."""
    index, voter = model.value
    starts = {t.rstrip("*") for t in index if t.endswith("*")}
    for batch in batches:
        features = [_hits(t.as_py() or "", index, starts) for t in batch.column(batch.num_columns - 1)]
        votes = [_votes(f, voter) for f in features]
        columns = [*batch.columns[:-1], pa.array(votes, pa.int32()), pa.array(features, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "votes", "features"])


def induce_lexicon(sample: DataFrame) -> list[str]:
    """Terms of (toxic, text) rows that speak for toxic, the strongest first."""
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = n.get(1, 0), n.get(0, 0)
    if not a or not b:
        return []
    counts = sample.mapInArrow(_term_batches, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("y")
    )
    cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    both = F.col("x") + F.col("y")
    ratio = 2 * (cell(F.col("x"), both * (a / (a + b))) + cell(F.col("y"), both * (b / (a + b))))
    strong = counts.where((F.col("x") >= MIN_TOXIC) & (F.col("x") >= MIN_PRECISION * both)).withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO)
    return [r.term for r in strong.orderBy(F.desc("ratio"), "term").limit(MAX_TERMS).select("term").collect()]


def fit_label_model(counts: np.ndarray, known: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of toxic for each vote pattern.

    counts: unlabelled documents by pattern. known: labelled ones by pattern and
    class. Returns also the voters' accuracies and the correlated pairs.
    """
    patterns = np.arange(len(counts))
    votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
    labelled = known.sum()
    prior = np.clip(known[:, 1].sum() / labelled, 0.005, 0.95) if labelled else PRIOR
    # where nothing is known, more votes make toxic likelier
    post = np.where(known.sum(1) > 0, known[:, 1] / np.maximum(known.sum(1), 1), votes.any(1) * 0.9 if not labelled else prior * votes.any(1))
    weight, rates, pairs = np.ones(VOTERS), np.zeros((2, VOTERS)), np.zeros((VOTERS, VOTERS), bool)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - post) + known[:, 0], counts * post + known[:, 1]])  # class x pattern
        rates = (mass @ votes + np.array([[0.02], [0.5]])) / (mass.sum(1, keepdims=True) + 1.0)
        rates = np.clip(rates, 1e-4, 1 - 1e-4)
        # correlation of two voters within the classes
        cov = np.zeros((VOTERS, VOTERS))
        for c in (0, 1):
            d = votes - rates[c]
            cov += (d * mass[c][:, None]).T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        pairs = (np.abs(cov / np.outer(sd, sd)) > CORRELATED) & ~np.eye(VOTERS, dtype=bool)
        weight = 1.0 / (1 + pairs.sum(1))
        like = np.log(rates[1] / rates[0]) * votes + np.log((1 - rates[1]) / (1 - rates[0])) * (1 - votes)
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + like @ weight, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return post, {"specificity": 1 - rates[0], "sensitivity": rates[1], "correlated": pairs}


def fit_classifier(rows: list[list[int]], target: np.ndarray, n_features: int, rounds: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets, by accelerated gradient steps on sparse rows."""
    w, bias, m = np.zeros(n_features), float(np.log(PRIOR / (1 - PRIOR))), len(rows)
    if not m:
        return w, bias
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    at = np.fromiter((f for r in rows for f in r), np.int64, len(owner))
    step = 4.0 / (1 + max(len(r) for r in rows))
    # every feature gets a step of its own size: its gradient is as small as it is rare
    scale = m / np.maximum(np.bincount(at, minlength=n_features), 1.0)
    vw, vb = w.copy(), bias
    for i in range(rounds):
        z = vb + np.bincount(owner, weights=vw[at], minlength=m)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = np.bincount(at, weights=err[owner], minlength=n_features) / m * scale + ridge * vw
        nw, nb = vw - step * gw, vb - step * err.mean()
        k = i / (i + 3)
        vw, vb = nw + k * (nw - w), nb + k * (nb - bias)
        w, bias = nw, nb
    return w, bias


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, votes.

    Learns labels only from ids whose crc32 mod 5 is not 0. Null and empty
    texts are scored as texts without features. Labels that are null, other
    than 0 and 1 or contradictory for an id are left out. Without labels the
    lexicon is empty and the seeds and patterns alone decide. Repeated rows
    each get a row; an empty table gives an empty result. Ids keep their type;
    further columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("toxic"), F.max(label_col).cast("int").alias("most")).where("toxic = most")
    # the sample is bounded, so its ids can be broadcast
    chosen = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample).select("doc_id", "toxic"), "sample")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = materialize(texts, "sample-texts")
    terms = induce_lexicon(sample)
    index = {t: i for i, t in enumerate(terms)}
    voter = np.array([zlib.crc32(t.encode()) % LEXICONS for t in terms] + [LEXICONS + i for i in range(VOTERS - LEXICONS)], np.int64)
    shared = spark.sparkContext.broadcast((index, voter))  # at most MAX_TERMS terms

    featured = docs.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text")
    # the id keeps its own type
    ident = docs.schema["doc_id"].dataType.simpleString()
    featured = featured.mapInArrow(partial(_feature_batches, model=shared), f"doc_id {ident}, held_out boolean, votes int, features array<int>")
    featured = materialize(featured, "votes")
    counts = np.zeros(1 << VOTERS)
    for r in featured.groupBy("votes").count().collect():  # at most 2 ** VOTERS rows
        counts[r["votes"]] = r["count"]
    seen = sample.mapInArrow(partial(_feature_batches, model=shared), "toxic int, votes int, features array<int>").toPandas()  # at most max_sample rows of features
    by_class = np.zeros((1 << VOTERS, 2))
    np.add.at(by_class, (seen["votes"].to_numpy(np.int64), seen["toxic"].to_numpy(np.int64)), 1)
    counts = np.maximum(counts - by_class.sum(1), 0)  # the labelled ones count once, with their class
    posterior, _ = fit_label_model(counts, by_class)
    rows = [list(f) for f in seen["features"]]
    target = posterior[seen["votes"].to_numpy(np.int64)] if len(seen) else np.empty(0)
    if not rows or not terms:  # nothing to train on: the patterns that occur stand in for documents
        at = np.flatnonzero(counts)
        rows = [[len(index) + i for i in range(VOTERS - LEXICONS) if p >> (LEXICONS + i) & 1] for p in at]
        target = posterior[at]
    w, bias = fit_classifier(rows, target, len(voter))

    shared = spark.sparkContext.broadcast((w, bias))
    scored = featured.mapInArrow(partial(_score_batches, model=shared), f"doc_id {ident}, held_out boolean, votes int, z double")
    score = 1 / (1 + F.exp(-F.col("z")))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "votes")


def _score_batches(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    w, bias = model.value
    for batch in batches:
        z = [bias + float(w[f].sum()) if f else bias for f in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.float64())], names=["doc_id", "held_out", "votes", "z"])
