"""G and J: deferred questions with their owners, timing of questions, the brief's rules on tests and notes, and their figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.operators import workplace
from runlens.operators.relational import exact_quantiles

HOUR = 3_600_000_000  # microseconds
SHORT_NOTE = 50  # bytes; less is no note


def _beside(row: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of a second row, or nulls if it has none, beside the one row of the first."""
    return row.join(F.broadcast(other), F.lit(True), "left")


def _median(df: DataFrame, value: Column, name: str) -> DataFrame:
    return exact_quantiles(df.select(value.cast("double").alias("value")), [], "value", {name: 0.5}).select(name)


def owner_threads(asks: DataFrame, availability: DataFrame, spans: DataFrame, links: DataFrame, nodes: DataFrame, by: list[str], budget_hours: float = 8.0) -> DataFrame:
    """One row per run, owner and card whose answer was deferred first at a known time.

    asks: by, action, at (microseconds), owner, text. availability: by, owner,
    card, event, first_defer, action. spans: by, first_at, last_at. links: by,
    card, req, one row per card. nodes: by, req, status, one row per node and
    requirement. A thread is followed if a later ask to its owner names the card,
    or the environment counted a follow-up.
    """
    key = [*by, "owner", "card"]
    asked = availability.join(asks.select(*by, "action", "at"), [*by, "action"], "left")
    deferred = (F.col("event") == "availability_deferred") & F.col("first_defer")
    threads = asked.groupBy(*key).agg(
        F.min(F.when(deferred, F.col("at"))).alias("deferred_at"),
        F.coalesce(F.bool_or(F.col("event") == "availability_followup_counted"), F.lit(False)).alias("followup_counted"),
        F.coalesce(F.bool_or(F.col("event") == "availability_opened"), F.lit(False)).alias("disclosed"),
    ).where("deferred_at is not null")
    later, t = asks.alias("a"), threads.select(*key, "deferred_at").alias("t")
    same = [F.col(f"a.{c}") == F.col(f"t.{c}") for c in (*by, "owner")]
    named = t.join(later.hint("merge"), [*same, F.col("a.at") > F.col("t.deferred_at"), F.contains(F.col("a.text"), F.col("t.card"))], "left_semi").select(*key, F.lit(True).alias("__named"))
    graded = nodes.where("status in ('passed', 'failed')").groupBy(*by, "req").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "passed").alias("passed"))
    j = threads.join(named, key, "left").join(spans, by, "left").join(links.select(*by, "card", "req"), [*by, "card"], "left").join(graded, [*by, "req"], "left")
    mention = F.coalesce("__named", F.lit(False))
    hours = lambda c: F.round(c / HOUR, 3)
    return j.select(
        *key, "deferred_at", (mention | F.col("followup_counted")).alias("followed"), mention.alias("followup_by_mention"), "followup_counted", "disclosed",
        F.round(F.lit(budget_hours) - (F.col("deferred_at") - F.col("first_at")) / HOUR, 3).alias("budget_left_hours"), hours(F.col("last_at") - F.col("deferred_at")).alias("hours_until_run_end"),
        "req", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("passed", F.lit(0)).alias("passed"),
    )


def thread_figures(threads: DataFrame, by: list[str]) -> DataFrame:
    """One row of counts, shares in per cent and medians over the threads of G01."""
    followed, left, more = F.col("followed"), F.col("budget_left_hours"), F.col("hours_until_run_end")
    pct = lambda a, b: F.try_divide(100 * a, b)
    told = F.count_if(followed & F.col("disclosed"))
    row = threads.agg(
        F.count("*").alias("threads"), F.count_if(~followed).alias("abandoned"), F.count_if(followed).alias("followed"), pct(F.count_if(~followed), F.count("*")).alias("abandoned_pct"),
        told.alias("followed_disclosed"), pct(told, F.count_if(followed)).alias("followed_disclosed_pct"), F.count_if(~followed & F.col("disclosed")).alias("abandoned_disclosed"),
        F.count_if(~followed & (left > 2)).alias("abandoned_left_over_2h"), F.count_if(~followed & (more > 1)).alias("abandoned_continued_over_1h"),
    )
    runs = threads.groupBy(*by).agg(F.bool_or(~followed).alias("abandoned")).agg(F.count("*").alias("runs_with_threads"), F.count_if("abandoned").alias("runs_with_abandoned"))
    abandoned = threads.where(~followed)
    row = _beside(_beside(row, runs), _median(abandoned, left, "abandoned_left_median"))
    return _beside(row, _median(abandoned, more, "abandoned_continued_median"))


def edits(actions: DataFrame, by: list[str], at: str, tool: str, call: str) -> DataFrame:
    """Span of each run and its first terminal call that edits code, with its place in the run to 4 decimals.

    actions: by, at, tool (canonical name), call (input as JSON text).
    """
    edit = (F.col(tool) == "terminal") & F.col(call).rlike(rules.EDIT_CALL)
    spans = actions.groupBy(*by).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(F.when(edit, F.col(at))).alias("edit_at"))
    return spans.withColumn("fraction", F.round(F.try_divide(F.col("edit_at") - F.col("first_at"), F.col("last_at") - F.col("first_at")), 4))


def timing_figures(asks: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """Questions by tenth of their run, their number, shares of the first and last fifth and of those after the first
    edit, the median place of first edits and the runs that have one.

    spans: the rows of ``edits``. Questions of a run without duration are in no tenth.
    """
    j = asks.join(spans, by).select(workplace.tenth(F.col(at)).alias("tenth"), (F.col(at) > F.col("edit_at")).alias("after"))
    total = F.count("*")
    share = lambda w: F.try_divide(F.count_if(w), F.greatest(total, F.lit(1)))
    row = j.agg(
        *[F.count_if(F.col("tenth") == d).alias(f"d{d}") for d in range(10)], total.alias("total"), share(F.col("tenth") < 2).alias("first_fifth"),
        share(F.col("tenth") >= 8).alias("last_fifth"), share(F.col("after")).alias("after_first_edit"),
    )
    row = row.crossJoin(F.broadcast(spans.agg(F.count("fraction").alias("runs_with_edit"))))  # one row each
    return _beside(row, _median(spans, F.col("fraction"), "first_edit_median_fraction"))


def brief(results: DataFrame, by: list[str], text: str) -> DataFrame:
    """What the texts that show the brief say: to write a note, that tests stay as they are, that they may be migrated."""
    shown = results.where(F.col(text).rlike(rules.BRIEF_FILE) & F.col(text).rlike(rules.BRIEF_SIGN))
    says = {"told_note": F.contains(F.col(text), F.lit(rules.NOTE_FILE)), "test_rule": F.col(text).rlike(rules.TESTS_STAY), "migration_allowed": F.col(text).rlike(rules.TESTS_MAY_MOVE)}
    return shown.groupBy(*by).agg(*[F.bool_or(c).alias(n) for n, c in says.items()])


def _edited_test() -> Column:
    lost = (F.col("removed") > 0) | (F.col("status") == "deleted")
    return (F.col("category") == "test") & F.col("path").rlike(rules.CODE_FILE) & (F.col("status") != "added") & lost


def edited_tests(files: DataFrame) -> DataFrame:
    """The files of patches that are existing tests in code and lost lines or were deleted.

    files: path, category, status, removed and further columns.
    """
    return files.where(_edited_test())


def _counts(of: Column) -> list[Column]:
    return [F.count_if(of).alias("tests_edited"), F.sum(F.when(of, F.col("removed"))).alias("lines_removed"), F.count_if(of & (F.col("status") == "deleted")).alias("tests_deleted")]


def patch_counts(files: DataFrame, by: list[str]) -> DataFrame:
    """Per run with a patch, that it has one, and the figures of its edited tests, in one aggregate over all of its files."""
    return files.groupBy(*by).agg(F.bool_or(F.lit(True)).alias("patch_found"), *_counts(_edited_test()))


def run_basics(runs: DataFrame, briefs: DataFrame, patched: DataFrame, tests: DataFrame, by: list[str]) -> DataFrame:
    """Per run the brief's rules, the size of its note, whether it has a patch, and its edited tests.

    runs: by, end_reason, note_bytes. briefs: of ``brief``. patched: by, runs with a patch. tests: of ``edited_tests``.
    """
    per = tests.groupBy(*by).agg(*_counts(F.lit(True)))
    return basics(runs, briefs, patched.select(*by).distinct().withColumn("patch_found", F.lit(True)).join(per.hint("merge"), by, "full_outer"), by)


def basics(runs: DataFrame, briefs: DataFrame, patches: DataFrame, by: list[str]) -> DataFrame:
    """``run_basics`` where the figures of patches are given. patches: of ``patch_counts``."""
    j = runs.select(*by, "end_reason", "note_bytes").join(briefs, by, "left").join(patches.hint("merge"), by, "left")
    flags, counts = ("told_note", "test_rule", "migration_allowed", "patch_found"), ("note_bytes", "tests_edited", "lines_removed", "tests_deleted")
    return j.select(*by, "end_reason", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags], *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def broken_rules(basics: DataFrame, by: list[str]) -> DataFrame:
    """The runs that edited tests against the rule, and those that were told to write a note and have none."""
    against = F.col("test_rule") & ~F.col("migration_allowed") & (F.col("tests_edited") > 0)
    silent = F.col("told_note") & (F.col("note_bytes") < SHORT_NOTE)
    which = F.array_compact(F.array(F.when(against, "edited_existing_tests"), F.when(silent, "no_delivery_note")))
    return basics.select(*by, F.explode(which).alias("rule"))


def rule_figures(basics: DataFrame) -> DataFrame:
    """One row of counts over ``run_basics``; the median is over the runs that edited tests against the rule."""
    ruled = F.col("test_rule") & ~F.col("migration_allowed")
    against, timed = ruled & (F.col("tests_edited") > 0), F.coalesce(F.col("end_reason") == "time_budget", F.lit(False))
    none = F.col("note_bytes") < SHORT_NOTE
    row = basics.agg(
        F.count_if(ruled).alias("rule_runs"), F.count_if(against).alias("edited_existing_tests"), F.coalesce(F.sum(F.when(against, F.col("tests_deleted"))), F.lit(0)).alias("deleted_test_files"),
        F.count_if("told_note").alias("told_note"), F.count_if(F.col("told_note") & none).alias("no_note"), F.count_if(timed).alias("time_budget_runs"), F.count_if(timed & none).alias("time_budget_no_note"),
    )
    return _beside(row, _median(basics.where(against), F.col("lines_removed"), "lines_removed_median"))


def loss_figures(nodes: DataFrame, by: list[str]) -> DataFrame:
    """One row over failed nodes: attributed ones with counts and shares per stage, those that failed to build or load at
    the last stage, runs with attributed losses, excluded and unmapped ones.

    nodes: by, status, stage, failure_class.
    """
    failed = nodes.where("status = 'failed'")
    stage, attributed = F.col("stage"), F.coalesce(F.col("stage").isin(*rules.LOSS_STAGES), F.lit(False))
    build = F.col("failure_class").isin("solver_runtime_or_load_error", "solver_compile_error") & (stage == "implement")
    per_run = failed.where(attributed).select(*by).distinct().agg(F.count("*").alias("runs_with_failures"))
    counts = [F.count_if(stage == s).alias(f"n_{s}") for s in rules.LOSS_STAGES]
    shares = [F.try_divide(100 * F.count_if(stage == s), F.count_if(attributed)).alias(f"pct_{s}") for s in rules.LOSS_STAGES]
    row = failed.agg(
        F.count("*").alias("failed"), F.count_if(attributed).alias("attributed"), *counts, *shares, F.count_if(build).alias("build_or_load"),
        F.count_if(stage == "excluded_infrastructure").alias("excluded_infrastructure"), F.count_if(stage == "unmapped").alias("unmapped"),
    )
    return row.crossJoin(F.broadcast(per_run))  # one row each


def loss_details(nodes: DataFrame) -> DataFrame:
    """Of, name, n: details of losses at the ask, failure classes of those at the last stage; a null name is empty.

    nodes: status, stage, ask_detail, failure_class.
    """
    at_ask = F.col("stage") == "ask"
    kept = nodes.where("status = 'failed' and stage in ('ask', 'implement')")
    of, name = F.when(at_ask, "ask_detail").otherwise("implement_failure_class"), F.when(at_ask, F.col("ask_detail")).otherwise(F.col("failure_class"))
    return kept.groupBy(of.alias("of"), F.coalesce(name, F.lit("")).alias("name")).agg(F.count("*").alias("n"))


def coverage_figures(runs: DataFrame, reconciled: DataFrame, disclosures: DataFrame, notices: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """One row: runs, reconciled ones, disclosures and those not visible, visible notices, runs without links to requirements.

    reconciled: match. disclosures: visible. notices: by, notice, one row per place where one is seen. links: by.
    """
    parts = (
        reconciled.agg(F.count_if("match").alias("reconciled")), disclosures.agg(F.count("*").alias("disclosures"), F.count_if(~F.coalesce("visible", F.lit(False))).alias("disclosures_not_visible")),
        notices.select(*by, "notice").distinct().agg(F.count("*").alias("notifications_visible")), runs.join(links.select(*by).distinct(), by, "left_anti").agg(F.count("*").alias("runs_without_links")),
    )
    row = runs.agg(F.count("*").alias("runs"))
    for p in parts:
        row = row.crossJoin(F.broadcast(p))  # one row each
    return row


def reconcile_methods(reconciled: DataFrame) -> DataFrame:
    """Reconciled runs by method, the first part of their notes. reconciled: match, notes."""
    return reconciled.where("match").groupBy(F.element_at(F.split(F.coalesce("notes", F.lit("")), ";"), 1).alias("method")).agg(F.count("*").alias("n"))


def unreconciled(reconciled: DataFrame, by: list[str]) -> DataFrame:
    """The other runs with their notes; a null match is none."""
    return reconciled.where(~F.coalesce("match", F.lit(False))).select(*by, "notes")
