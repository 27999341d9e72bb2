"""Quality: planted texts, edge cases, and the fit against plain forms of its formulas."""

import random
import zlib

import numpy as np

from conftest import SF
from runlens.llm import quality

WORDS = "river stone walks slowly under bright evening light before small houses near old wooden bridges while children gather warm bread".split()


def planted(n, seed=0):
    """Texts of prose (1), and of rows of repeated words, decorated words or capitals (0)."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(15, 80))]
        kind = i % 6
        if kind == 0:
            text = " ".join(w for w in words[:8] for _ in range(9))
        elif kind == 3:
            text = " ".join(w + rnd.choice(["%%%", "###", "***"]) for w in words)
        else:
            text = " ".join(words).capitalize() + "."
        rows.append((i, text, int(kind not in (0, 3))))
    return rows


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


def test_planted_texts_are_told_apart(spark):
    rows = planted(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == 400 and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert all(got[i].predicted == good for i, _, good in rows if held(i))


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = planted(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    score = lambda f: {r.doc_id: r.score for r in quality.score_documents(docs, spark.createDataFrame([(i, f(i, g)) for i, _, g in rows], "doc_id long, quality int")).collect()}
    assert score(lambda i, g: g) == score(lambda i, g: 1 - g if held(i) else g)


def test_edges(spark):
    rows = planted(60)
    docs = [(i, t, "x", 5) for i, t, _ in rows] + [(1000, None, "x", 5), (1001, "", "x", 5), (1001, "", "x", 5), (None, "null id", "x", 5), (1002, "word " * 30_000, "x", 5), (1003, "日本 ünï 😀 _ 7", "x", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, features string, score int")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1, 0), (1, 1), (2, None), (3, 7), (None, 1)], "doc_id long, quality int").selectExpr("*", "'a' as text", "1 as good")
    got = quality.score_documents(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert quality.score_documents(df.limit(0), labels).collect() == []
    assert {(r.score, r.predicted) for r in quality.score_documents(df, labels.limit(0)).collect()} == {(quality.UNKNOWN, 1)}
    one = labels.where("quality = 1")
    assert {r.score for r in quality.score_documents(df, one).collect()} == {quality.UNKNOWN}


def test_bounded_sample(spark):
    rows = planted(300)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = quality.score_documents(docs, labels, max_sample=60).collect()
    assert len(got) == 300 and np.mean([r.predicted == rows[r.doc_id][2] for r in got]) > 0.95


def test_log_ratios_and_hinge_fit():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < (0.3 + 0.5 * (i % 2) * (np.arange(12) < 4))).astype(np.int32) for i in range(80)]
    good = np.arange(80) % 2
    counts = quality._counts(rows, good)
    assert all(counts[f, c] == sum(f in r for r, g in zip(rows, good) if g == c) for f in range(12) for c in (0, 1))
    ratio = quality.log_ratios(counts[:12], np.array([40, 40]))
    total = counts[:12].sum(0) + 12
    assert np.allclose(ratio, [np.log((counts[f, 1] + 1) / total[1]) - np.log((counts[f, 0] + 1) / total[0]) for f in range(12)])
    y, cost = np.where(good == 1, 1.0, -1.0), np.full(80, 0.7)
    w = quality.fit_hinge(*quality.scaled(rows, ratio), y, cost, 12, epochs=3000)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        v = np.where(np.isin(np.arange(12), r), ratio, 0)
        x[i] = np.append(v / max(np.linalg.norm(v), 1e-12), 1)
    # at the optimum the gradient of the primal vanishes
    slack = np.maximum(0, 1 - y * (x @ w))
    assert np.abs(w - 2 * x.T @ (cost * y * slack)).max() < 2e-3


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
