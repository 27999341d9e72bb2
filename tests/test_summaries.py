"""Sums of claims against plain Python, documents of runs with nothing."""

import json
import statistics

import pytest

from runlens.operators import summaries


@pytest.mark.parametrize("values", [[], [0.5], [0.0, 1.0], [0.25, 0.25, 1.0], [i * 37 % 11 / 11 for i in range(40)], [0.5] * 9])
def test_exclusive_quartiles(spark, values):
    rows = summaries.exclusive_quartiles(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").collect()
    assert len(rows) == 1
    if len(values) < 2:
        assert tuple(rows[0]) == ((values[0],) * 2 if values else (None, None))
    else:
        p25, _, p75 = statistics.quantiles(values, n=4)
        assert (rows[0].p25, rows[0].p75) == pytest.approx((p25, p75))


def test_claims_of_runs(spark):
    rows = [(1, "claimed_done", False, True, "card_id"), (1, "not_mentioned", False, False, None), (1, "claimed_done", True, None, "topic"), (2, "claimed_done", None, True, "topic"), (3, None, False, False, "topic")]
    claims = spark.createDataFrame(rows, "run int, claim string, delivered boolean, listed_as_open boolean, match_method string")
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run int")
    per = summaries.claim_runs(claims, runs, ["run"])
    assert {r.run: (r.failed, r.silent, r.silent_share, r.claimed_done) for r in per.collect()} == {1: (2, 1, 0.5, 2), 2: (0, 0, None, 0), 3: (1, 0, 0.0, 0), 4: (0, 0, None, 0)}
    t = summaries.claim_totals(claims, per).first()
    assert (t.requirements, t.scored, t.failed, t.listed_as_open, t.runs, t.runs_with_failures, t.median) == (5, 4, 3, 2, 4, 2, 0.25)
    assert (t.silent_share, t.done_failed_share) == pytest.approx((1 / 3, 1 / 2))
    none = summaries.claim_totals(claims.limit(0), per.limit(0)).collect()
    assert len(none) == 1 and none[0].silent_share is None and none[0].median is None
    assert {(r.of, r.name): r.n for r in summaries.claim_counts(claims.where("run < 3")).collect()} == {
        ("claim", "claimed_done/failed"): 1, ("claim", "claimed_done/delivered"): 1, ("claim", "not_mentioned/failed"): 1, ("match_method", "card_id"): 1, ("match_method", ""): 1, ("match_method", "topic"): 2,
    }


def test_shares_of_no_events(spark):
    empty = spark.createDataFrame([(1, 0), (None, None)], "a int, b int")
    assert [tuple(r) for r in summaries.linked_shares(empty, {"x": ("a", "b"), "y": ("b", "a")}).collect()] == [("x", 1, 0, None), ("y", 0, 1, 0.0)]


def test_document_of_a_run_without_requirements(spark):
    make = spark.createDataFrame
    runs = make([(1, (0, 2)), (2, None)], "run int, outcome struct<f2p_passed:int,f2p_total:int>")
    reqs = make([(1, "b", "", None, "h", "obtained", None), (1, "a", "c", "t", "h", "obtained", 2)], "run int, req string, card string, topic string, holder string, acquisition string, questions int")
    nodes = make([(1, "a", "n2", "failed", "", "", "", "high", "x"), (1, "a", "n1", "passed", None, None, None, None, None)], "run int, req string, node string, status string, failure_class string, ask_detail string, loss_stage string, mapping_confidence string, grader_output string")
    claims = make([], "run int, req string, claim_class string, listed_as_open boolean, match_method string, excerpt string, line string")
    deferrals = make([(1, "c", "o2", True, False, 1.5, 2.0), (1, "c", "o1", False, False, 0.0, 0.5), (1, "", "o", True, True, 0.0, 0.0)], "run int, card string, owner string, followed boolean, disclosed boolean, budget_left_hours double, hours_until_run_end double")
    failed = make([], "run int, node string, failure_class string, grader_output string")
    found = summaries.diagnosis_documents(runs, reqs, nodes, claims, claims.select("run", "req", "claim_class"), deferrals, failed, ["run"])
    docs = {r.run: json.loads(r.document) for r in found.collect()}
    assert docs[2] == {"outcome": None, "requirements": [], "p2p_failed": []}
    a, b = docs[1]["requirements"]
    assert (a["req"], a["nodes_total"], a["nodes_passed"], a["pipeline_loss_stage"], [n["node"] for n in a["nodes"]], [d["owner"] for d in a["deferrals"]]) == ("a", 2, 1, None, ["n1", "n2"], ["o1", "o2"])
    assert (b["card"], b["topic"], b["questions"], b["nodes"], b["deferrals"], b["delivery_note"]["strict"]) == (None, "", 0, [], [], None)
    skipped = summaries.skipped_runs(runs, make([(1, True), (1, True), (2, None)], "run int, match boolean"), make([], "run int"), ["run"])
    assert {r.run: r.reason for r in skipped.collect()} == {1: "no requirement links", 2: "per-node outcomes not reconstructed"}


def test_strata_and_their_edges(spark):
    make = spark.createDataFrame
    runs = make([(1, 0.5, True, 0.2), (2, None, False, None), (3, 1.0, None, 0.4), (4, 0.1, True, 0.1)], "run int, rate double, strict boolean, obtained double")
    release = make([(1, 28, 1000, "Go", "Science"), (2, 27, 999, None, None), (3, 36, 5001, "Rust", "Games & Graphics"), (9, 1, 1, "Go", "x")], "run int, n_nodes int, added int, language string, domain string")
    found = {(r.axis, r.stratum): (r.n, r.rate_pct, r.strict, r.obtained_pct and round(r.obtained_pct, 6)) for r in summaries.release_strata(runs, release, ["run"]).collect()}
    assert found[("verifier_nodes", "28-35")] == (1, 50.0, 1, 20.0) and found[("verifier_nodes", "<28")] == (1, None, 0, None) and found[("verifier_nodes", ">35")][0] == 1
    assert {s for a, s in found if a == "edit_size"} == {"<1k", "1k-5k", ">5k"}
    assert found[("language", "Go / Rust")] == (2, 75.0, 1, 30.0) and found[("language", "Other")][0] == 1 and found[("domain", "Other")][0] == 2
    assert summaries.release_strata(runs.limit(0), release, ["run"]).count() == 0


def test_short_row_of_a_run(spark):
    columns = "run int, task string, f2p_passed int, f2p_total int, p2p_passed int, p2p_total int, end_reason string, hours double, messages int, obtained int, held int, abandoned int, threads int, done_failed int, done int, premature string"
    summary = spark.createDataFrame([(1, "t", 1, 2, 3, 3, "done", 7.96, 4, 1, 2, 0, 1, 2, 3, "no"), (2, None, *[None] * 14)], columns)
    losses = spark.createDataFrame([(1, "implement"), (1, "ask"), (1, "implement"), (1, "unmapped"), (1, None)], "run int, stage string")
    rows = {r.run: tuple(r)[1:] for r in summaries.short_index(summary, losses, ["run"]).collect()}
    assert rows[1] == ("t", "1/2", "3/3", "done", "8.0", 4, "1/2", "A1 I2", "0/1", "2/3", "no")
    assert rows[2] == (None, "0/0", "0/0", None, "0.0", None, "0/0", "", "0/0", "0/0", "–")


def test_rows_of_models(spark):
    figures = spark.createDataFrame([("a", "failed", 4.0), ("a", "listed_open_pct", 25.0), ("a", "first_fifth", 0.5), ("a", "else", 1.0), ("b", "failed", 0.0)], "model string, figure string, value double")
    rows = {r.model: r.asDict() for r in summaries.model_rows(figures, ["failed", "listed_open_pct", "claimed_done_pct", "first_fifth"]).collect()}
    assert rows["a"] == {"model": "a", "failed": 4.0, "listed_open_pct": 25.0, "claimed_done_pct": None, "first_fifth": 50.0, "silent_pct": 75.0}
    assert rows["b"]["silent_pct"] is None
