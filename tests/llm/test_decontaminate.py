import hashlib
import re

from runlens.llm import decontaminate
from runlens.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
ITEMS = [(1, A), (2, "Short one"), (3, ""), (4, None), (5, "x x x x x x x x x x x"), (6, A), (1, A), (None, "no id here")]
DOCS = [
    (1, f"before, {A.upper()}! after"), (2, " ".join(A.split()[2:12])), (3, " ".join(A.split()[2:11])), (4, "short ONE short one"), (5, "x " * 25),
    (6, None), (7, ""), (7, "again short one"), (8, "short two"), (None, "SHORT ONE"), (9, "Ünï short one"), (1, f"before, {A.upper()}! after"), (10, "no id here"),
]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text):
    w, hit, items = words(text), set(), set()
    for i, t in ITEMS:
        iw = words(t)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if iw else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[s : s + n]:
                    hit |= set(range(p, p + n))
                    items.add(i)
    items.discard(None)
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as word", "2 as pos"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, items).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in DOCS)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t in DOCS if not brute(t)[4])


def test_shuffled_items_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(docs, items).collect())
    assert got == sorted((str(i), *brute(t)) for i, t in DOCS)
    long = f"{'y z ' * 150_000}{A} {'x ' * 20_000}"
    (r,) = contamination(spark.createDataFrame([(1, long)], "doc_id long, text string"), items).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (300_000 + 13 + 20_000, 13 + 20_000, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:2], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(docs.limit(0), items).collect() == []
    assert [r.n_hit for r in contamination(docs, items.limit(0)).collect()] == [0, 0]
