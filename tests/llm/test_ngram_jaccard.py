import random

import numpy as np
import pytest

from runlens.llm import ngram_jaccard
from runlens.llm.ngram_jaccard import keep_one, link_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs, k, num):
    """All pairs, on sets of strings."""
    sets = {}
    for i, text, *_ in docs:
        w = [x for x in (text or "").encode().lower().split()]
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and min(len(a), len(b)) * 100 >= num * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= num * (len(a) + len(b) - both):
                    p, q = find(ids[x]), find(ids[y])
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for _ in range(40):  # families: a chain of edits, each a little further away
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 40, 150, 400]))]
        for _ in range(rnd.randint(1, 9)):
            docs.append(" ".join(words))
            words = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
    docs += ["", " \t\n", None, "One", "one", "two words", "Two  WORDS", "É é", "é é"]
    return [(i * 3, t, "en", "s", 0) for i, t in enumerate(docs)]


@pytest.mark.parametrize("k,threshold", [(3, 0.9), (5, 0.8)])
def test_equals_all_pairs(spark, k, threshold):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(spark.createDataFrame(docs, SCHEMA), k, threshold).collect()}
    assert got == brute(docs, k, round(threshold * 100))


def test_a_family_that_one_centre_does_not_reach(spark):
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(30):  # each differs from the next by one word, from the first by ever more
        docs.append((i, " ".join([f"x{j}" for j in range(i)] + base[i:]), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(spark.createDataFrame(docs, SCHEMA), 3, 0.9).collect()}
    assert got == brute(docs, 3, 90)
    assert {c for _, c in got.values()} == {0}


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(None, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (4, "a b c d e", None, None, None), (7, None, None, None, None), (None, "z", None, None, None)]
    rows = link_documents(spark.createDataFrame(docs, SCHEMA), 3, 0.9).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 3, 4), (4, 3, 4), (4, 3, 4), (7, 0, 7), (None, 1, None)], key=str)
    assert link_documents(spark.createDataFrame([], SCHEMA), 3, 0.9).collect() == []


def test_keep_one(spark):
    docs = [(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "other words", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (5, "", "en", "s", 1)]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as key", "2 as set_id")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 5, None]


def test_a_null_id_is_part_of_a_chain(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(4, " ".join(base), None, None, None), (None, " ".join(["x0", *base[1:-2]]), None, None, None), (9, " ".join(["x0", "x1", *base[2:-4]]), None, None, None)]
    rows = link_documents(spark.createDataFrame(docs, SCHEMA), 3, 0.93).collect()
    assert {r.component_id for r in rows} == {4}


def test_hot_keys_and_small_parts(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(ngram_jaccard, "PART", 2)
    monkeypatch.setattr(ngram_jaccard, "hot_share", lambda n: 3)
    for k, threshold in ((3, 0.9), (5, 0.8)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(spark.createDataFrame(docs, SCHEMA), k, threshold).collect()}
        assert got == brute(docs, k, round(threshold * 100))


def test_families_just_too_far_apart_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PART", 3)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:170] + [f"x{i // 2}.{j}" for j in range(28)] + [f"y{i}"]), "en", "s", 0) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(spark.createDataFrame(docs, SCHEMA), 3, 0.9).collect()}
    assert got == brute(docs, 3, 90)
    assert len({c for _, c in got.values()}) == 20


def test_a_name_of_two_sets_is_told_apart(spark):
    rows = spark.createDataFrame([(5, 1), (5, 2), (6, 1)], "name long, name2 long")
    assert len({r[0] for r in rows.select(ngram_jaccard._named([5])).collect()}) == 3
    assert {r[0] for r in rows.select(ngram_jaccard._named([])).collect()} == {5, 6}


def test_ids_keep_their_type_and_long_texts_pass(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = {r.doc_id: r.component_id for r in link_documents(spark.createDataFrame([("b", long), ("a", long + " end"), ("c", "one")], "doc_id string, text string")).collect()}
    assert rows == {"a": "a", "b": "a", "c": "c"}


def test_long_sketches_fold_and_bound(spark):
    rnd = np.random.default_rng(3)
    both = rnd.integers(0, 2**63, 1800).astype(np.uint64)
    rows, want = [], []
    for i in range(60):
        a = np.unique(np.r_[both[: rnd.integers(600, 1800)], rnd.integers(0, 2**63, rnd.integers(1, 400)).astype(np.uint64)])
        b = np.unique(np.r_[both[: rnd.integers(600, 1800)], rnd.integers(0, 2**63, rnd.integers(1, 400)).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        want.append(common * 100 >= 80 * (len(a) + len(b) - common))
        rows.append((i, *(({"n": len(s), "long_sketch": ngram_jaccard.long_sketch(s).tolist()}) for s in (a, b))))
    side = "struct<n:long,long_sketch:array<long>>"
    got = {r.i for r in spark.createDataFrame(rows, f"i int, x {side}, y {side}").where(ngram_jaccard._long_close(80, 100)).collect()}
    assert {i for i, w in enumerate(want) if w} <= got and len(got) < 60
    long, longer = rows[0][1]["long_sketch"], ngram_jaccard.long_sketch(np.arange(5000, dtype=np.uint64))
    assert len(long) * 32 >= rows[0][1]["n"] and len(longer) == 256


@pytest.mark.parametrize("size", [800, 1100, 2300])
def test_families_of_long_texts(spark, size):
    rnd = random.Random(size)
    base = [f"w{i}" for i in range(size)]
    docs = []
    for i in range(12):
        words = list(base)
        for _ in range(i * size // 90):
            words[rnd.randrange(size)] = f"x{rnd.random()}"
        docs.append((i, " ".join(words[: size - 7 * i]), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_documents(spark.createDataFrame(docs, SCHEMA), 5, 0.8).collect()}
    assert got == brute(docs, 5, 80)
