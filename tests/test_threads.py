"""Deferred questions, timing and rules on small and empty inputs."""

from runlens.functions import rules
from runlens.operators import threads

H = threads.HOUR
ASKS = "run int, action int, at long, owner string, text string"
AVAIL = "run int, owner string, card string, event string, first_defer boolean, action int"


def inputs(spark, asks, availability):
    make = spark.createDataFrame
    spans = make([(1, 0, 10 * H)], "run int, first_at long, last_at long")
    links = make([(1, "C1", "q1")], "run int, card string, req string")
    nodes = make([(1, "q1", "passed"), (1, "q1", "failed"), (1, "q1", "unresolved"), (1, "q2", "passed")], "run int, req string, status string")
    return make(asks, ASKS), make(availability, AVAIL), spans, links, nodes, ["run"]


def test_threads_by_mention_by_count_and_abandoned(spark):
    asks = [(1, 1, 1 * H, "a", "C1 and C2"), (1, 2, 2 * H, "a", "C1?"), (1, 3, 3 * H, "b", "C2?"), (1, 4, 4 * H, "a", None), (1, 5, None, "a", "x")]
    defer = "availability_deferred"
    availability = [
        (1, "a", "C1", defer, True, 1), (1, "a", "C1", defer, True, 2), (1, "a", "C1", defer, True, 2), (1, "a", "C1", "availability_opened", None, None),
        (1, "a", "C2", defer, True, 1), (1, "b", "C3", defer, True, 3), (1, "b", "C3", "availability_followup_counted", False, 3),
        (1, "a", "C4", defer, False, 1), (1, "a", "C5", defer, True, 5), (1, "a", "C6", defer, True, 99), (1, "b", "C9", "availability_opened", None, 3),
    ]
    found = threads.owner_threads(*inputs(spark, asks, availability))
    got = {r.card: (r.followed, r.followup_by_mention, r.followup_counted, r.disclosed, r.budget_left_hours, r.hours_until_run_end, r.req, r.nodes, r.passed) for r in found.collect()}
    assert got == {"C1": (True, True, False, True, 7.0, 9.0, "q1", 2, 1), "C2": (False, False, False, False, 7.0, 9.0, None, 0, 0), "C3": (True, False, True, False, 5.0, 7.0, None, 0, 0)}
    figures = threads.thread_figures(found, ["run"]).first()
    assert (figures.threads, figures.abandoned, figures.followed_disclosed, figures.runs_with_abandoned, figures.abandoned_left_median) == (3, 1, 1, 1, 7.0)
    none = threads.thread_figures(found.limit(0), ["run"]).collect()
    assert len(none) == 1 and none[0].threads == 0 and none[0].abandoned_pct is None and none[0].abandoned_left_median is None


def test_edits_and_timing(spark):
    calls = [(1, 0, "terminal", "ls"), (1, 40, "terminal", '{"cmd": "sed -i s/a/b/ f"}'), (1, 60, "read", "sed -i"), (1, 100, "terminal", "cat > a.md"), (2, 5, "terminal", "apply_patch"), (3, 1, "read", "apply_patch"), (3, 9, "read", None)]
    spans = threads.edits(spark.createDataFrame(calls, "run int, at long, tool string, call string"), ["run"], "at", "tool", "call")
    assert {r.run: (r.edit_at, r.fraction) for r in spans.collect()} == {1: (40, 0.4), 2: (5, None), 3: (None, None)}
    asks = spark.createDataFrame([(1, 0), (1, 19), (1, 50), (1, 100), (2, 5)], "run int, at long")
    f = threads.timing_figures(asks, spans, ["run"], "at").first()
    assert [f[f"d{d}"] for d in range(10)] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert (f.total, f.first_fifth, f.last_fifth, f.after_first_edit, f.runs_with_edit, f.first_edit_median_fraction) == (5, 0.4, 0.2, 0.4, 1, 0.4)
    empty = threads.timing_figures(asks.limit(0), spans.limit(0), ["run"], "at").first()
    assert (empty.total, empty.first_fifth, empty.first_edit_median_fraction) == (0, 0.0, None)


def test_rules_on_tests_and_notes(spark):
    make = spark.createDataFrame
    says = make([(1, "README: existing tests must not be deleted"), (1, "SOLUTION.md"), (2, "README existing tests should not be changed; may update existing test files"), (3, "existing tests must not be changed"), (4, None)], "run int, text string")
    briefs = threads.brief(says, ["run"], "text")
    assert {r.run: (r.told_note, r.test_rule, r.migration_allowed) for r in briefs.collect()} == {1: (True, True, False), 2: (False, True, True)}
    files = make([(1, "t/a.py", "test", "modified", 3), (1, "t/b.py", "test", "deleted", 0), (1, "t/c.txt", "test", "deleted", 9), (1, "t/d.py", "test", "added", 4), (1, "e.py", "production", "modified", 5), (2, "t/f.go", "test", "modified", 0)], "run int, path string, category string, status string, removed long")
    tests = threads.edited_tests(files)
    assert [(r.path, r.removed) for r in tests.orderBy("path").collect()] == [("t/a.py", 3), ("t/b.py", 0)]
    runs = make([(1, "time_budget", 49), (2, None, 50), (5, "time_budget", None)], "run int, end_reason string, note_bytes int")
    basics = threads.run_basics(runs, briefs, files, tests, ["run"])
    assert {r.run: (r.patch_found, r.note_bytes, r.tests_edited, r.lines_removed, r.tests_deleted) for r in basics.collect()} == {1: (True, 49, 2, 3, 1), 2: (True, 50, 0, 0, 0), 5: (False, 0, 0, 0, 0)}
    assert {(r.run, r.rule) for r in threads.broken_rules(basics, ["run"]).collect()} == {(1, "edited_existing_tests"), (1, "no_delivery_note")}
    f = threads.rule_figures(basics).first()
    assert (f.rule_runs, f.edited_existing_tests, f.deleted_test_files, f.no_note, f.time_budget_runs, f.time_budget_no_note, f.lines_removed_median) == (1, 1, 1, 1, 2, 2, 3.0)
    assert threads.rule_figures(basics.limit(0)).first().deleted_test_files == 0
    assert rules.NOTE_FILE == "SOLUTION.md"


def test_losses_and_coverage_without_rows(spark):
    nodes = spark.createDataFrame([(1, "failed", None, None, None), (1, "passed", "ask", "x", None)], "run int, status string, stage string, ask_detail string, failure_class string")
    f = threads.loss_figures(nodes, ["run"]).first()
    assert (f.failed, f.attributed, f.pct_ask, f.runs_with_failures) == (1, 0, None, 0)
    assert threads.loss_details(nodes).collect() == []
    rec = spark.createDataFrame([(1, True, None), (2, None, "a;b")], "run int, match boolean, notes string")
    seen = spark.createDataFrame([(None,), (True,)], "visible boolean")
    notices = spark.createDataFrame([(1, "n"), (1, "n"), (2, "n")], "run int, notice string")
    assert tuple(threads.coverage_figures(rec.select("run"), rec, seen, notices, rec.where("run = 1"), ["run"]).first()) == (2, 1, 2, 1, 2, 1)
    assert [tuple(r) for r in threads.reconcile_methods(rec).collect()] == [("", 1)]
    assert [tuple(r) for r in threads.unreconciled(rec, ["run"]).collect()] == [(2, "a;b")]
