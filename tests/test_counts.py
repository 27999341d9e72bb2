"""Flags of calls without results, gaps with null columns, and models that occur twice."""

import pytest

from runlens.operators import comms, reviews, stats, telemetry


def test_call_flags_and_breakdown(spark):
    rows = [(1, "a", None), (2, "a", []), (3, "a", ["is_error"]), (3, "a", []), (4, "a", ["structured_error"]), (5, "b", ["is_error", "structured_error"]), (5, "b", ["is_error"])]
    calls = telemetry.call_flags(spark.createDataFrame(rows, "call long, tool string, flags array<string>"), ["tool", "call"])
    assert {(r.call, r.n_results, r.outcome, r.is_error, r.content_error) for r in calls.collect()} == {
        (1, 0, "missing", False, False), (2, 1, "success", False, False), (3, 2, "mixed", True, False), (4, 1, "error", False, True), (5, 2, "error", True, True),
    }
    found = telemetry.tool_breakdown(calls, ["tool"], {"said": "is_error", "shown": "content_error"})
    assert {tuple(r) for r in found.select("tool", "calls", "n_success", "n_error", "n_mixed", "n_missing", "said", "shown").collect()} == {("a", 4, 1, 1, 1, 1, 1, 1), ("b", 1, 0, 1, 0, 0, 1, 1)}


def test_retry_status_and_gaps(spark):
    retries = spark.createDataFrame([(1, 3), (2, 2)], "run long, raw long")
    runs = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, None)], "run long, reported long")
    found = telemetry.retry_status(retries, runs, ["run"], "reported")
    assert {(r.run, r.raw, r.matches) for r in found.collect()} == {(1, 3, True), (2, 2, False), (3, 0, True), (4, 0, False)}
    gaps = telemetry.gap_rows(runs, ["run"], {"none": "reported is null", "few": "reported < 2"})
    assert {tuple(r) for r in gaps.collect()} == {(2, "few"), (3, "few"), (4, "none")}


def test_availability_binds_single_questions_only(spark):
    events = spark.createDataFrame([("q1", "availability_opened"), ("q2", "availability_deferred"), ("q3", "availability_opened"), (None, "availability_opened"), ("q1", "question_answered")], "q string, kind string")
    questions = spark.createDataFrame([("q1", 10), ("q2", 11), ("q2", 12)], "q string, action long")
    found = comms.availability(events, "kind", questions, ["q"], "action")
    assert {(r.q, r.question_action) for r in found.collect()} == {("q1", 10), ("q2", None), ("q3", None), (None, None)}


def test_model_table(spark):
    rows = [("x", "n", 1.0), ("x", "m", None), ("y", "n", 3.0), ("y", "m", 5.0)]
    metrics = spark.createDataFrame(rows, "model string, metric string, value double")
    assert {tuple(r) for r in stats.model_table(metrics, ["n", "m"]).select("model", "n", "m").collect()} == {("x", 1.0, None), ("y", 3.0, 5.0), ("Mean", 2.0, 5.0)}
    with pytest.raises(Exception, match="more than one summary of model x"):
        stats.model_table(metrics.union(metrics.where("model = 'x'")), ["n", "m"]).collect()


def test_reviewer_usage_takes_the_last_snapshot_with_usage(spark):
    rows = [(1, "a", 1, 10, 1), (1, "a", 2, 20, None), (1, "a", 3, None, None), (1, "b", 1, 5, 5), (1, None, 9, 99, 99), (2, "c", 1, None, None)]
    found = reviews.reviewer_usage(spark.createDataFrame(rows, "run long, id string, seq long, i long, o long"), ["run"], "id", ["seq"], ["i", "o"])
    assert {tuple(r) for r in found.select("run", "requests", "responses", "with_usage", "i", "o").collect()} == {(1, 5, 2, 2, 25, 5), (2, 1, 1, 0, None, None)}


def test_rate_marks(spark):
    runs = spark.createDataFrame([(1.0, 2, 2), (0.9, 1, 2), (0.25, 0, 0), (0.2, 3, 3), (None, 1, 1)], "rate double, p2p_passed long, p2p_total long")
    assert tuple(stats.rate_marks(runs, "rate").first()) == (2, 1, 4, 0.575)
