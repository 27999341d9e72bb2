"""Operators on names, graders' texts, claims, ranks and citations against plain Python."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.functions.words import _parts, _spelled, says
from runlens.operators import checks, claims, grader, nodes, normalize, relational, reviews


@pytest.mark.parametrize("pattern", [rules.OPEN_WORDS, rules.DONE_WORDS])
def test_words_equal_the_pattern(spark, pattern):
    rnd = random.Random(3)
    spelled = [s for p in _parts(pattern[4:]) for s in _spelled(re.sub(r"^\\b|\\b$", "", p)) or []]
    assert len(spelled) > 40
    texts = [s.upper() for s in spelled] + [f"x{s}y" for s in spelled] + [f"a {s[:-1]} b" for s in spelled if s] + ["", None, "plain", "re-done", "undone", "İ"]
    texts += [" ".join(rnd.choice(["the", "of", *spelled[:9]])[: rnd.randint(1, 9)] for _ in range(6)) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    bad = df.where(~says(F.col("text"), pattern).eqNullSafe(F.col("text").rlike(pattern)))
    assert bad.collect() == []


def test_clauses(spark):
    def plain(text, pos):
        start, end = 0, len(text)
        for m in re.finditer(r"[。；;！!？?\n]|\.\s", text):
            if m.end() <= pos:
                start = m.end()
            elif m.start() >= pos:
                end = m.end()
                break
        return text[start:end].strip()

    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", " ", ". ", ".", "。", "；", "\n", "!", "卡"]) for _ in range(rnd.randint(1, 30)))
        places = [i for i, c in enumerate(text) if c in "abc卡"]
        if places:
            rows.append((text, rnd.choice(places)))
    got = spark.createDataFrame(rows, "text string, at int").select("text", "at", claims.clause_around(F.col("text"), F.col("at")).alias("said")).collect()
    assert all(r.said == plain(r.text, r["at"]) for r in got)


@pytest.mark.parametrize("by", [["g"], []])
def test_ranks_and_quantiles(spark, by):
    rnd = random.Random(7)
    rows = [("a", float(rnd.choice([1, 2, 2, 2, rnd.random() * 9]))) for _ in range(400)] + [("b", float(i % 3)) for i in range(20)] + [("c", 5.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g if by else None, []).append(x)
    for r in relational.ranked(df, by, "x", twice=F.count("*") * 2).collect():
        own = groups[r.g if by else None]
        assert (r.n, r.below, r.total, r.twice) == (own.count(r.x), sum(v < r.x for v in own), len(own), 2 * own.count(r.x))
    got = {r.g if by else None: r for r in relational.exact_quantiles(df, by, "x", {"q1": 0.1, "median": 0.5, "top": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g].n == len(own) and np.allclose([got[g].q1, got[g].median, got[g].top], np.quantile(own, [0.1, 0.5, 1.0]))


def test_rank_correlation(spark):
    rnd = random.Random(11)
    rows = [(g, float(rnd.randint(0, k)), float(rnd.randint(0, 5))) for g, k in (("a", 3), ("b", 50), ("c", 0)) for _ in range(60)] + [("d", 1.0, 2.0), ("a", None, 1.0)]
    mean_rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    for r in relational.spearman(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect():
        own = [t[1:] for t in rows if t[0] == r.g and t[1] is not None]
        x, y = mean_rank([t[0] for t in own]), mean_rank([t[1] for t in own])
        assert r.n == len(own) and (r.rho is None if r.g in "cd" else abs(r.rho - np.corrcoef(x, y)[0, 1]) < 1e-9)


def test_signed_rank(spark):
    rnd = random.Random(13)
    groups = {"small": [rnd.uniform(-1, 2) for _ in range(9)], "one": [0.5, 0.0], "zeros": [0.0, 0.0], "tied": [1.0, -1.0, 2.0, 2.0, -3.0], "large": [rnd.uniform(-1, 1.3) for _ in range(70)], "sided": [1.0, 2.0, 3.0, 4.0]}
    got = {r.g: r for r in relational.signed_rank(spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double"), ["g"], "v").collect()}
    assert set(got) == set(groups) - {"zeros"} and got["one"].p is None
    for g in ("small", "sided"):
        vs = groups[g]
        order = sorted(abs(v) for v in vs)
        w = sum(order.index(abs(v)) + 1 for v in vs if v > 0)
        n = len(vs)
        low = min(w, n * (n + 1) // 2 - w)
        ways = sum(sum(i + 1 for i, s in enumerate(signs) if s) <= low for signs in itertools.product((0, 1), repeat=n))
        assert got[g].w_plus == w and abs(got[g].p - min(1, 2 * ways / 2**n)) < 1e-12
    for g in ("tied", "large"):
        vs = [v for v in groups[g] if v]
        size = [abs(v) for v in vs]
        ranks = [sum(y < x for y in size) + (size.count(x) + 1) / 2 for x in size]
        w, n = sum(r for r, v in zip(ranks, vs) if v > 0), len(vs)
        ties = sum(size.count(x) ** 3 - size.count(x) for x in set(size))
        z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
        assert abs(got[g].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-9


def test_erfc(spark):
    xs = [0.0, 0.1, 0.9, 1.49, 1.5, 1.51, 3.0, 6.0, 12.0]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", relational.erfc(F.col("x")).alias("e")).collect():
        assert abs(r.e / math.erfc(r.x) - 1) < 1e-9


def test_names_of_nodes(spark):
    given = [(1, "PR-12", 0), (1, "case a", 1), (1, "Case_A", 2), (1, "node_x", 3), (1, "test_x", 4), (1, "t[0700]", 5), (1, "u 700 z", 6), (1, "v-81", 7), (2, "other 55", 0)]
    said = [("exact", ["zz", "PR-12"]), ("alias", ["nick"]), ("both", ["CASE A"]), ("pre", ["x"]), ("twice", ["700"]), ("no", ["081"]), ("seven", ["see 7"]), ("far", ["55"]), ("none", []), ("null", [None, "v-81"]), ("lead", ["[f2p] pr 12"])]
    records = spark.createDataFrame([(1, r, ids) for r, ids in said], "run int, record string, ids array<string>")
    aliases = spark.createDataFrame([(1, "nick", "v-81"), (2, "x", "other 55")], "run int, alias string, node string")
    got = {r.record: (r.tier, r.node) for r in nodes.match_nodes(records, spark.createDataFrame(given, "run int, node string, place int"), aliases, ["run"], "record", "ids", "node", "place").collect()}
    assert got == {"exact": ("exact", "PR-12"), "alias": ("alias", "v-81"), "pre": ("prefix", "node_x"), "no": ("number", "v-81"), "null": ("exact", "v-81"), "lead": ("canonical", "PR-12")}
    none = nodes.match_nodes(records, spark.createDataFrame(given, "run int, node string, place int"), aliases, ["run"], "record", "ids", "node", "place", numbers=F.lit(False))
    assert "no" not in {r.record for r in none.collect()}


def test_graders_texts(spark):
    own = "\n".join([f"FAILED t::a[7] at {i}" for i in range(30)] + ["xt::a[7]", "t::a[7]-b", "0t::a[7]", "17 or 77", "it is 7."])
    files = [(1, "v/run.log", own), (1, "v/b.log", "\n".join(f"unit 7: {i}" for i in range(15))), (1, "all.log", "no 77"), (1, "top.log", "::\n7"), (1, "v/out.json", '[{"id": 9, "detail": "7 no"}, {"k": "7", "stdout": " lost ", "n": 1}, {"7": {"a": null, "b": "q\\"", "c": [1]}}]'), (2, "v/run.log", "t::a[7]"), (1, "v/none.log", None)]
    given = [(1, "t::a[7]", "v/run.log"), (1, "t::b[7]", "v/out.json"), (1, "::", "top.log"), (2, "z", "gone.log")]
    got = {r.node: r.output for r in grader.grader_output(spark.createDataFrame(given, "run int, node string, path string"), spark.createDataFrame(files, "run int, path string, text string"), ["run"], "node", 0x7FFF).collect()}
    lines = [f"FAILED t::a[7] at {i}" for i in range(30)] + ["xt::a[7]", "t::a[7]-b", "0t::a[7]", "it is 7."]  # 7 is a name too
    assert got["t::a[7]"] == "\n".join([*lines[-20:], "[b.log]", *[f"unit 7: {i}" for i in range(3, 15)], "[top.log]", "7"])
    assert got["t::b[7]"].startswith('{"k": "7", "stdout": " lost ", "n": 1}\n{"a": null, "b": "q\\""}\n[b.log]\n') and "[run.log]" in got["t::b[7]"] and got["t::b[7]"].endswith("[top.log]\n7")
    assert got["::"] == "::" and got["z"] == ""
    clipped = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "t string").select(grader.clip(F.col("t"), 6).alias("c")).collect()
    assert [r.c for r in clipped] == ["abcd\n… [4 chars omitted] …\nij", "abc", None]


def test_citations(spark):
    files = spark.createDataFrame([(1, "a/b.md", "first line\r\nsecond\tline\n"), (1, "e.jsonl", '"plain"\n{"x": "{\\"y\\": [\\"in  side\\"]}"}\n'), (1, "empty", "")], "run int, path string, text string")
    cited = [
        ("ok", "a/./b.md", 1, 2, "line second  line", None), ("deep", "e.jsonl", 2, 2, "in side", ""), ("null", "a/b.md", 1, 1, None, None), ("blank", "a/b.md", 1, 1, " ", None), ("out", "../a/b.md", 1, 1, "x", None), ("root", "/a/b.md", 1, 1, "x", None),
        ("zero", "a/b.md", 0, 1, "x", None), ("long", "a/b.md", 1, 3, "x", None), ("event", "a/b.md", 1, 1, "first", "ev"), ("none", "empty", 1, 1, "x", None), ("two", "a/b.md", 2, 2, "zz", "ev"), ("nofile", None, 1, 1, "x", None), ("other", "a/x/../b.md", 2, 2, "second line", "second"),
    ]
    evidence = spark.createDataFrame([(1, *c) for c in cited], "run int, id string, path string, line_start int, line_end int, quote string, event_id string")
    got = sorted((r.id, r.error.split(":")[0]) for r in checks.check_citations(evidence, files, ["run"]).collect())
    path, lines, quote, event = "invalid evidence path", "invalid line range", "quote not found in cited lines", "event ID not found in cited lines"
    assert got == sorted([("null", quote), ("blank", quote), ("out", path), ("root", path), ("nofile", path), ("zero", lines), ("long", lines), ("none", lines), ("event", event), ("two", quote), ("two", event)])
    assert checks.check_citations(evidence.limit(0), files, ["run"]).collect() == []


def test_results_before_their_calls(spark):
    calls = spark.createDataFrame([("a", 5, 0, "A"), ("a", 9, 1, "B"), ("b", 1, 0, "C")], "id string, at int, block int, action string")
    results = spark.createDataFrame([("a", 1, 0, "r1"), ("a", 5, 0, "r2"), ("a", 7, 0, "r3"), ("b", 0, 9, "r4"), ("c", 1, 1, "r5"), ("c", 1, 1, "r5")], "id string, at int, block int, name string")
    got = sorted((r.name, r.matching_later_call) for r in normalize.later_calls(calls, results, ["id"], ["at", "block"], "action").collect())
    assert got == [("r1", "A"), ("r4", "C"), ("r5", None), ("r5", None)]


def test_nested_usage(spark):
    given = ['{"a": 1, "b": {"c": {"d": 2.5, "e": null}, "f": "3x"}, "g": true, "h": [1], "i": -3e2}', "{}", None, "no json", '{"a": {"b": {"c": {"d": {"e": {"f": {"g": 7}}}}}}}']
    got = [r.u for r in spark.createDataFrame([(g,) for g in given], "usage string").select(reviews.flat_usage(F.col("usage")).alias("u")).collect()]
    assert got == [{"a": 1.0, "b.c.d": 2.5, "i": -300.0}, {}, {}, {}, {"a.b.c.d.e.f.g": 7.0}]


def test_topics(spark):
    topic = spark.createDataFrame([("Semantics of the Renderer v2.1 和 权限校验",)], "t string").select(claims.topic_features(F.col("t")).alias("f")).first().f
    assert sorted(topic) == sorted(["render", "v2.1", "权限", "限校", "校验"])
    units = spark.createDataFrame([(1, 1, "the prerendering of V2.1"), (1, 2, "权限校验"), (1, 3, "render"), (1, 4, ""), (1, 5, None), (2, 6, "render v2.1")], "run int, unit int, text string")
    topics = spark.createDataFrame([(1, 9, topic), (1, 8, ["render"]), (1, 7, ["v2.1"])], "run int, number int, features array<string>")
    got = {(r.number, r.unit): round(r.score, 3) for r in claims.topic_scores(units, topics, ["run"], "unit", "number", "text").collect()}
    assert got == {(9, 1): 0.4, (9, 2): 0.6, (8, 1): 1.0, (8, 3): 1.0}


def test_lines_meet_names_without_their_text(spark, monkeypatch):
    monkeypatch.setattr(grader, "LARGEST_LOG", 40)
    given = [(1, "n1", "r/v/run.log"), (1, "n2", "r/v/a.json"), (1, "n3", "r/v/out.txt"), (1, "n4", "r/v/small.log")]
    files = [(1, "r/v/run.log", "n1 n2 n3 " * 9), (1, "r/v/small.log", "n1 n2\nn3 n4"), (1, "r/v/out.txt", "n3 n4"), (1, "r/all.log", "n4"), (1, "r/v/a.json", '{"id": "n2"}')]
    df = grader.log_lines(spark.createDataFrame(given, "run int, node string, path string"), spark.createDataFrame(files, "run int, path string, text string"), ["run"], "node")
    got = sorted((r.node, r.file, r.line, r.far) for r in df.collect())
    assert got == [("n1", "r/v/run.log", 0, 0), ("n1", "r/v/small.log", 0, 1), ("n2", "r/v/small.log", 0, 1), ("n3", "r/v/out.txt", 0, 0), ("n3", "r/v/small.log", 1, 1), ("n4", "r/all.log", 0, 2), ("n4", "r/v/small.log", 1, 0)]

    def semi_joins(plan):
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        own = [children[0].output().mkString(",")] if plan.nodeName() == "Join" and plan.joinType().toString() == "LeftSemi" else []
        return own + [x for c in children for x in semi_joins(c)]

    (moved,) = semi_joins(df._jdf.queryExecution().optimizedPlan())
    assert "text" not in moved and "file" not in moved
