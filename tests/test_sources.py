import hashlib
import json

from runlens.operators import workplace
from runlens.sources import jsonl
from runlens.streaming.ingest import ingest


def test_lines_and_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n[1]\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n')
    lines = jsonl.jsonl_lines(spark, f"{tmp_path}/*.jsonl")
    good, bad = jsonl.parse_records(lines)
    assert sorted((r.path[-7:], r.line, r.x) for r in good.selectExpr("path", "line", "variant_get(record, '$.x', 'int') as x").collect()) == [("a.jsonl", 1, 1), ("a.jsonl", 4, 2), ("b.jsonl", 1, 3)]
    assert sorted((r.line, r.error) for r in bad.collect()) == [(2, "not JSON"), (3, "not an object")]


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f"{i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        out = jsonl.jsonl_lines(spark, f"{tmp_path}/big.jsonl")
        assert out.where("line <> cast(value as long)").count() == 0 and out.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_artifacts_hashes_digest(spark, tmp_path):
    files = spark.createDataFrame([(1, "a/x.md"), (1, "z/capture/x.md"), (1, "b/y.md"), (1, "a/y.md")], "run int, path string")
    assert {(r.name, r.path) for r in jsonl.pick_artifact(files, ["run"]).collect()} == {("x.md", "z/capture/x.md"), ("y.md", "a/y.md")}
    for n in ("p", "q"):
        (tmp_path / n).write_text(n)
    want = [("p", hashlib.sha256(b"p").hexdigest()), ("q", "0"), ("r", "0")]
    manifest = spark.createDataFrame(want, "name string, sha256 string")
    assert {tuple(r) for r in jsonl.verify_hashes(spark, str(tmp_path), manifest).collect()} == {("q", "differs"), ("r", "missing")}
    one = jsonl.corpus_digest(manifest.selectExpr("1 as run", "*"), ["run"]).first()[0]
    assert one == jsonl.corpus_digest(manifest.selectExpr("1 as run", "*").orderBy("sha256").repartition(3), ["run"]).first()[0]


def test_write_and_ingest(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")
    jsonl.write_tables(df, f"{tmp_path}/c", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).first().b == "[1,2]"
    (tmp_path / "in").mkdir()
    for i in (1, 2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"x": i}))
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", "x int")
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


NOTE = """# Plan
intro line
more
## Open questions
- first `AB-1`
  goes on
- second
**Done**
| a | b |
|---|---|
| c | d |
# Next
text"""


def test_note_units(spark):
    units = workplace.note_units(spark.createDataFrame([(1, NOTE)], "run int, text string"), ["run"], "text").orderBy("unit").collect()
    assert [(u.start_line, u.kind, u.heads, u.unit_text) for u in units] == [
        (1, "head", "", "# Plan"), (2, "text", "Plan", "intro line\nmore"), (4, "head", "Plan", "## Open questions"),
        (5, "bullet", "Plan > Open questions", "- first `AB-1`\ngoes on"), (7, "bullet", "Plan > Open questions", "- second"),
        (8, "head", "Plan > Open questions", "**Done**"), (9, "row", "Plan > Open questions > Done", "| a | b |"),
        (11, "row", "Plan > Open questions > Done", "| c | d |"), (12, "head", "", "# Next"), (13, "text", "Next", "text"),
    ]


PATCH = """diff --git a/src/x.py b/src/x.py
--- a/src/x.py
+++ b/src/x.py
@@ -1 +1,2 @@
-old
+new
+newer
diff --git a/tests/test_y.py b/tests/test_y.py
deleted file mode 100644
--- a/tests/test_y.py
+++ /dev/null
-gone
"""


def test_patches(spark):
    df = workplace.patch_files(spark.createDataFrame([(1, PATCH)], "run int, patch string"), ["run"], "patch")
    got = df.withColumn("c", workplace.file_category(df["path"])).withColumn("l", workplace.file_language(df["path"])).orderBy("path").collect()
    assert [tuple(r) for r in got] == [(1, "src/x.py", "modified", 2, 1, "production", "Python"), (1, "tests/test_y.py", "deleted", 0, 1, "test", "Python")]


def test_languages_by_name_and_ending(spark):
    cases = {"a/Makefile": "Make", "Dockerfile.dev": None, "x/Dockerfile": "Dockerfile", "CMakeLists.txt": "CMake", "b/BUILD": "Bazel", "src/a.tar.ts": "TypeScript", "q.PY": "Python", "README": None, "a.unknown": None, ".py": None, "dockerfile-dev": "Dockerfile", "t.das": "Daslang", "x.h": "C", "a.r": "R"}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.l for r in df.withColumn("l", workplace.file_language(df["path"])).collect()} == cases


def test_words_of_claims(spark):
    open_words = ["my own choice", "no owner", "I chose this", "couldn't", "not defined", "no record", "not possible", "not exercised", "not replied", "not addressed", "nothing was changed", "not changed", "kept the existing", "needs owner", "needs confirmation", "partial fix", "未确认", "需 owner", "未知"]
    done_words = ["already the case", "now returns x", "new `f`", "✅", "已实现", "新增"]
    rows = [(t, "", "claimed_partial_or_open") for t in open_words] + [(t, "", "claimed_done") for t in done_words]
    rows += [("未知字段", "", "not_mentioned"), ("plain", "", "not_mentioned"), ("plain", "not guessed", "claimed_partial_or_open"), ("plain", "风险", "claimed_partial_or_open"), ("answered", "open items", "claimed_done"), ("plain", "代码改动", "claimed_done")]
    df = spark.createDataFrame(rows, "text string, heads string, want string")
    wrong = df.where(workplace.classify_claim(df["text"], df["heads"]) != df["want"]).collect()
    assert wrong == []
