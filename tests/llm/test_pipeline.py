"""The pipeline on documents planted for each stage."""

import hashlib
import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_takes_effect(spark, tmp_path):
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice("bcdfghklmn") + rnd.choice("aeiou") for _ in range(3)) for _ in range(200)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, item = text(80), text(12)
    docs = [(i, text(60), "en", "s", 0) for i in range(20)]
    docs += [(100, base, "en", "s", 0), (101, base + " extra", "en", "s", 0), (102, base, None, "s", 0)]
    docs += [(200, f"{text(30)} {item} {text(5)}", "en", "s", 0), (201, "12 34 !!", "en", "s", 0), (202, None, "en", "s", 0), (203, f"{text(30)} 10.1.2.3 {text(5)}", None, "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == {*range(20), 100, 203}
    assert rows[203].lang == "en"
    assert rows[100].decoded_sha256 == hashlib.sha256(base.encode()).hexdigest()
    changed = next(t for i, t, *_ in docs if i == 203)
    assert rows[203].decoded_sha256 != hashlib.sha256(changed.encode()).hexdigest()
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows.values())


def test_clashing_columns_nulls_and_empty_tables(spark, tmp_path):
    extra = ["score", "lang_pred", "held_out", "key", "set_id", "n_replaced", "ids", "word", "pos", "component_id", "text_hash", "name"]
    rows = [(i, f"some words of text number {i} and more of them {'x' * i}", "en", "s", 9) for i in range(6)]
    rows += [(7, None, None, None, None), (8, "", "en", "s", 0), (None, "a row without an id stays here", "en", "s", 3), (0, rows[0][1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(extra)])
    spark.createDataFrame([(1, "words that are nowhere else at all in any of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        kept = out.count()
        assert kept == {"language_id": 8}.get(name, len(rows)), name
