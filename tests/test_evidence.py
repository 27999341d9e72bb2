"""Edge cases of the operators on open JSON, card ranges, resampling and cases."""

import hashlib
import math

from pyspark.sql import functions as F

from runlens.functions.jsontree import json_objects
from runlens.operators import cases, mentions, sidecars, verifier


def test_json_objects_edges(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    rows = [(1, None), (2, ""), (3, "no json"), (4, "7"), (5, "{}"), (6, '{"\\ud800": "\\udfff"}'), (7, deep), (8, '[[{"k": [{"x": null}]}]]')]
    found = json_objects(spark.createDataFrame(rows, "id int, j string"), "j")
    assert dict(found.groupBy("id").count().collect()) == {5: 1, 6: 1, 7: 300, 8: 2}
    inner = found.where("id = 8 and at = 'k'").first()
    assert (inner.direct, inner.above, inner.fields["x"].type) == (False, "", "null")
    assert json_objects(spark.createDataFrame([], "id int, j string"), "j").count() == 0


def test_strip_private_edges(spark):
    rows = [(1, None), (2, "{"), (3, '{"x_score_y": 1, "scores": [{"Authorization2": 1, "k": "é"}]}'), (4, '"score"')]
    got = dict(spark.createDataFrame(rows, "id int, j string").select("id", sidecars.strip_private(F.col("j"))).collect())
    assert got == {1: None, 2: None, 3: '{"scores":[{"k":"é"}]}', 4: '"score"'}


def test_scan_sidecar_edges(spark):
    rows = [("r", "a", 1, '{"event": "0"}'), ("r", "a", 2, None), ("r", "a", 3, "[1]"), ("r", "b", 1, '{"event": false, "kind": "x"}')]
    lines = spark.createDataFrame(rows, "run string, path string, line int, text string")
    got = [tuple(r) for r in sidecars.scan_sidecar(lines, ["run"]).orderBy("path", "line").select("parsed", "number", "kind").collect()]
    assert got == [(True, 1, "0"), (False, None, None), (True, 2, "unknown"), (True, 3, "x")]
    assert sidecars.scan_sidecar(lines.limit(0), ["run"]).count() == 0


def test_returned_entities_rules(spark):
    rows = [
        (1, "people", '[{"id": "p1", "expertise": []}, {"id": "p2"}]'),
        (2, "artifacts", '{"id": "a1", "body": "b"}'),
        (3, "board", '{"key": "k", "selected_version": {"body": "b", "version": null}}'),
        (4, "other", '{"id": "o", "body": "b"}'),
        (5, "chat", '{"conversation": {"id": ""}, "x": {"conversation": {"id": "no"}}}'),
    ]
    df = spark.createDataFrame(rows, "result int, family string, payload string").withColumn("run", F.col("result"))
    got = {tuple(r) for r in sidecars.returned_entities(df, ["run"], "result", "family", "payload").collect()}
    assert got == {(1, "id", "p1", None), (2, "id", "a1", None), (2, "body", "a1", None), (3, "id", "k", None), (3, "body", "k", None)}


def test_walk_verifier_order_and_hints(spark):
    file = '{"a": "pass", "suite_x": {"n1": {"ok": false, "class": "load_error", "message": "m"}}, "c": "blocked_by", "node_passed": ["q"], "n": 1, "list": [{"id": 7, "passed": true, "type": 3}]}'
    out = verifier.walk_verifier(spark.createDataFrame([(1, file), (2, None)], "f int, j string"), ["f"], "j").orderBy("no", "style").collect()
    assert [(r.ids, r.status, r.label, r.message, r.hint) for r in out] == [
        (["a"], "passed", "", "", ""),
        (["n1"], "failed", "load_error", "m", "suite_x"),
        (["c"], "failed", "blocked_by", "", ""),
        (["q"], "passed", "", "", ""),
        (["7"], "passed", "", "", "list"),
    ]


def test_supplemental_rules_edges(spark):
    files = spark.createDataFrame([("r", "a", '{"exit": 0, "phases": []}'), ("r", "b", "junk"), ("r", "c", "# fail 0\n"), ("r", "d", None)], "run string, path string, text string")
    table = spark.createDataFrame([("r", 1, "a", "phases"), ("r", 2, "b", "exit"), ("r", 3, "c", "tap"), ("r", 4, "d", "tap"), ("r", 5, "none", "tap")], "run string, node int, path string, rule string")
    got = {(r.node, r.status) for r in verifier.supplemental_rules(files, table, ["run"]).collect()}
    assert got == {(1, "failed"), (2, "failed"), (3, "failed"), (4, "failed")}


def test_card_ranges_grammar(spark):
    texts = ["A.B-201..203, 210/211.", "A.B-205 to A.B-207 and 150", "AxB-201", "| 201/202 |", "| 201 x |", "A.B-201–209", None, "A.B-250-230"]
    units = spark.createDataFrame([("r", i, t, "A.B") for i, t in enumerate(texts)], "run string, unit int, text string, prefix string")
    cards = spark.createDataFrame([("r", n) for n in range(150, 300)], "run string, number int")
    got = {}
    for r in mentions.card_ranges(units, cards, ["run"]).collect():
        got.setdefault(r.unit, []).append((r.number, r.blanket))
    flat = {u: sorted(n for n, _ in v) for u, v in got.items()}
    assert flat == {0: [201, 202, 203, 210], 1: [205, 206, 207, 207], 3: [201, 202], 5: list(range(201, 210)), 7: [250]}
    assert all(b for _, b in got[5]) and not any(b for _, b in got[0])
    assert mentions.card_ranges(units.limit(0), cards, ["run"]).count() == 0


def test_bootstrap_without_correlation(spark):
    rows = [("flat", i, 1.0, float(i)) for i in range(5)] + [("one", 0, 1.0, 1.0)] + [("up", i, float(i), float(i)) for i in range(9)]
    out = {r.g: r for r in cases.bootstrap_ci(spark.createDataFrame(rows, "g string, i int, x double, y double"), "x", "y", ["g"], "i", reps=40).collect()}
    assert (out["flat"].used, out["flat"].lo, out["flat"].significant) == (0, None, False)
    assert out["one"].n == 1 and out["one"].used == 0
    assert out["up"].significant and round(out["up"].lo, 6) == 1.0


def test_bootstrap_makes_its_draws_once(spark, monkeypatch):
    monkeypatch.setattr(cases, "BLOCK", 3)
    rows = [("g", i, float(i % 2), float(i * 7 % 5)) for i in range(10)]
    out = cases.bootstrap_ci(spark.createDataFrame(rows, "g string, i int, x double, y double"), "x", "y", ["g"], "i", reps=20)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    ranks = lambda v: [sum(w < a for w in v) + (sum(w == a for w in v) - len(v)) / 2 for a in v]
    found = []
    for rep in range(1, 21):
        drawn = [rows[int(hashlib.md5(f"7|{rep}|{place}".encode()).hexdigest()[:8], 16) % 10] for place in range(10)]
        a, b = ranks([r[2] for r in drawn]), ranks([r[3] for r in drawn])
        spread = math.sqrt(sum(i * i for i in a) * sum(i * i for i in b))
        if spread:
            found.append(sum(i * j for i, j in zip(a, b, strict=True)) / spread)
    found.sort()
    at = lambda p: found[int(p)] + (found[int(p) + 1] - found[int(p)]) * (p - int(p))
    (r,) = out.collect()
    assert (r.n, r.used) == (10, len(found))
    assert (round(r.lo, 9), round(r.hi, 9)) == (round(at(0.025 * (len(found) - 1)), 9), round(at(0.975 * (len(found) - 1)), 9))


def test_cases_fall_back_to_five(spark):
    losses = spark.createDataFrame([(r, "implement") for r in (1, 2, 3, 4, 5, 6, 6)], "run int, loss_stage string")
    reqs = spark.createDataFrame([(r, a) for r in range(1, 7) for a in ("obtained" if r < 6 else "no", "no")], "run int, acquisition string")
    none = spark.createDataFrame([], "run int")
    assert [tuple(r) for r in cases.select_cases(losses, reqs, none, "run").collect()] == [("implement_despite_all_obtained", 1)]
    all_got = reqs.withColumn("acquisition", F.when(F.col("run") == 4, "obtained").otherwise(F.col("acquisition")))
    assert [tuple(r) for r in cases.select_cases(losses, all_got, none, "run").collect()] == [("implement_despite_all_obtained", 4)]
    assert cases.select_cases(losses.limit(0), reqs.limit(0), none, "run").count() == 0
