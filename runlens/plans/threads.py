"""Queries of the operators on deferred questions, timing, the brief's rules, losses and coverage, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators import threads, workplace
from runlens.plans.queries import query, r6

# --- G01, J17: threads. An ask tells its owner of a card that may be another one

_G01 = """with x as (select run, action, tool, start_us as said_at, concat('o', action % 2) as owner, concat('c', action % 3) as card, concat('about c', action // 6 % 3, '?') as text,
case when tool in ('purchase', 'view') then 'availability_deferred' when tool = 'error' and action % 4 = 0 then 'availability_followup_counted' when tool = 'signup' and action % 4 = 1 then 'availability_opened' else 'other' end as event, action % 5 <> 0 as first_defer from v_actions),
f as (select run, owner, card, min(said_at) as t from x where tool = 'purchase' and first_defer group by run, owner, card),
s as (select run, min(said_at) as a, max(said_at) as z from x group by run),
g as (select run, action % 3 as c, count(case when action % 4 <> 2 then 1 end) as nodes, count(case when action % 4 in (0, 3) then 1 end) as passed from x where tool = 'click' group by run, action % 3),
th as (select f.run, f.owner, f.card, f.t as deferred_at,
exists (select 1 from x where x.run = f.run and x.owner = f.owner and tool = 'purchase' and said_at > f.t and contains(text, f.card)) as followup_by_mention,
exists (select 1 from x where x.run = f.run and x.owner = f.owner and x.card = f.card and event = 'availability_followup_counted') as followup_counted,
exists (select 1 from x where x.run = f.run and x.owner = f.owner and x.card = f.card and event = 'availability_opened') as disclosed,
round(8 - (f.t - a) / 3600000000.0, 3) as budget_left_hours, round((z - f.t) / 3600000000.0, 3) as hours_until_run_end,
case when f.run % 3 <> 0 then f.run * 10 + cast(substr(f.card, 2) as bigint) end as req, case when f.run % 3 <> 0 then coalesce(nodes, 0) else 0 end as nodes, case when f.run % 3 <> 0 then coalesce(passed, 0) else 0 end as passed
from f join s using (run) left join g on g.run = f.run and concat('c', g.c) = f.card),
y as (select *, followup_by_mention or followup_counted as followed from th) """


def _threads(v) -> DataFrame:
    action = F.col("action")
    tag = lambda n, c: F.concat(F.lit(n), c)
    x = v.v_actions.select("run", "action", "tool", F.col("start_us").alias("at"), tag("o", action % 2).alias("owner"), tag("c", action % 3).alias("card"), F.concat(F.lit("about c"), F.floor(action / 6) % 3, F.lit("?")).alias("text"), (action % 5 != 0).alias("first_defer"))
    event = (
        F.when(F.col("tool").isin("purchase", "view"), "availability_deferred").when((F.col("tool") == "error") & (action % 4 == 0), "availability_followup_counted")
        .when((F.col("tool") == "signup") & (action % 4 == 1), "availability_opened").otherwise("other")
    )
    spans = x.groupBy("run").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    links = x.where("run % 3 <> 0").select("run", "card", (F.col("run") * 10 + action % 3).alias("req")).distinct()
    status = F.element_at(F.array(*map(F.lit, ("passed", "failed", "unresolved", "passed"))), (action % 4).cast("int") + 1)
    nodes = x.where("tool = 'click'").select("run", (F.col("run") * 10 + action % 3).alias("req"), status.alias("status"))
    return threads.owner_threads(x.where("tool = 'purchase'"), x.withColumn("event", event).drop("at"), spans, links, nodes, ["run"])


@query("g01_owner_threads", _G01 + "select * from y")
def g01_threads(v):
    return _threads(v)


@query("j17_thread_figures", _G01 + """select count(*) as threads, count(case when not followed then 1 end) as abandoned, count(case when followed then 1 end) as followed, round(100.0 * count(case when not followed then 1 end) / count(*), 6) as abandoned_pct,
count(case when followed and disclosed then 1 end) as followed_disclosed, round(100.0 * count(case when followed and disclosed then 1 end) / count(case when followed then 1 end), 6) as followed_disclosed_pct, count(case when not followed and disclosed then 1 end) as abandoned_disclosed,
count(case when not followed and budget_left_hours > 2 then 1 end) as abandoned_left_over_2h, count(case when not followed and hours_until_run_end > 1 then 1 end) as abandoned_continued_over_1h,
count(distinct run) as runs_with_threads, count(distinct case when not followed then run end) as runs_with_abandoned, round(median(case when not followed then budget_left_hours end), 6) as abandoned_left_median, round(median(case when not followed then hours_until_run_end end), 6) as abandoned_continued_median from y""")
def j17_figures(v):
    return r6(threads.thread_figures(_threads(v), ["run"]), "abandoned_pct", "followed_disclosed_pct", "abandoned_left_median", "abandoned_continued_median")


# --- G02, G03, J18: timing

_CALLS = ("sed -i s/a/b/ x", "cat > src/a.py", "cat > notes.txt", "echo x >  lib/b.go", "python3 - <<E", "ls -l")
_J18 = """with s as (select run, min(start_us) as first_at, max(start_us) as last_at, min(case when tool = 'view' and run % 4 <> 0 and action % 6 in (0, 1, 3, 4) then start_us end) as edit_at from v_actions group by run),
e as (select *, case when last_at > first_at then round((edit_at - first_at) / (last_at - first_at), 4) end as fraction from s) """


def _edits(v) -> DataFrame:
    call = F.when(F.col("run") % 4 == 0, F.lit("ls")).otherwise(F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("action") % 6).cast("int") + 1))
    tool = F.when(F.col("tool") == "view", "terminal").otherwise(F.col("tool"))
    return threads.edits(v.v_actions.withColumns({"tool": tool, "call": call}), ["run"], "start_us", "tool", "call")


@query("g03_edits", _J18 + "select * from e")
def g03_edits(v):
    return _edits(v)


@query("j18_timing_figures", _J18 + f""", j as (select case when last_at > first_at then least(9, cast(floor(10 * (start_us - first_at) / (last_at - first_at)) as int)) end as d, coalesce(start_us > edit_at, false) as after from v_actions join e using (run) where is_ask)
select {', '.join(f'count(case when d = {i} then 1 end) as d{i}' for i in range(10))}, count(*) as total, round(count(case when d < 2 then 1 end) / count(*), 6) as first_fifth, round(count(case when d >= 8 then 1 end) / count(*), 6) as last_fifth, round(count(case when after then 1 end) / count(*), 6) as after_first_edit,
(select count(fraction) from e) as runs_with_edit, (select round(median(fraction), 6) from e) as first_edit_median_fraction from j""")
def j18_figures(v):
    out = threads.timing_figures(v.v_actions.where("is_ask"), _edits(v), ["run"], "start_us")
    return r6(out, "first_fifth", "last_fifth", "after_first_edit", "first_edit_median_fraction")


# --- G04, G05, G08, J19: the brief's rules, patches and notes

_BRIEFS = (
    "README: existing tests must not be modified", "instruction.md 能确认的需求: 现有测试不能为了迁就实现而修改或删除", "see the readme on existing tests; you may update existing test files", "write SOLUTION.md",
    "existing tests must not be changed", "README only", "SOLUTION.md; Migrating public tests is fine", "task_instruction: existing tests should not be deleted",
)
_PATHS = ("tests/test_{}.py", "tests/x_{}.txt", "src/a{}.go", "spec/b{}.rb", "test/data_{}.json", "lib/c{}_test.go", "vendor/tests/d{}.py")
_PATH = "case node % 7 " + " ".join("when {} then concat('{}', node, '{}')".format(i, *p.split("{}")) for i, p in enumerate(_PATHS)) + " end"
_G08 = f"""with files as (select run, {_PATH} as path, case node % 5 when 0 then 'added' when 1 then 'deleted' else 'modified' end as status, node % 4 as removed from v_nodes where run % 6 <> 0),
tests as (select * from files where (path like 'tests/test%' or path like 'spec/%' or path like 'lib/%') and status <> 'added' and (removed > 0 or status = 'deleted')),
briefs as (select run, bool_or(req % 8 in (3, 6)) as told_note, bool_or(req % 8 in (0, 1, 7)) as test_rule, bool_or(req % 8 in (2, 6)) as migration_allowed from v_reqs where (req // 8) % 8 = run % 8 and req % 8 not in (4, 5) group by run),
basics as (select r.run, case when r.run % 4 = 0 then 'time_budget' when r.run % 4 = 1 then 'done' end as end_reason, coalesce(told_note, false) as told_note, coalesce(test_rule, false) as test_rule, coalesce(migration_allowed, false) as migration_allowed, p.run is not null as patch_found,
case when r.run % 11 = 0 then 0 else r.run % 9 * 10 end as note_bytes, coalesce(t.n, 0) as tests_edited, coalesce(t.l, 0) as lines_removed, coalesce(t.d, 0) as tests_deleted
from v_runs r left join briefs using (run) left join (select distinct run from files) p on p.run = r.run left join (select run, count(*) as n, cast(sum(removed) as bigint) as l, count(case when status = 'deleted' then 1 end) as d from tests group by run) t on t.run = r.run) """


def _chunk() -> Column:
    """A file of a diff for each node."""
    node = F.col("node")
    path = F.element_at(F.array(*[F.concat(F.lit(a), node, F.lit(b)) for a, b in (p.split("{}") for p in _PATHS)]), (node % 7).cast("int") + 1)
    mode = F.when(node % 5 == 0, "new file mode 100644\n").when(node % 5 == 1, "deleted file mode 100644\n").otherwise("")
    return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), mode, F.lit("--- a/x\n+++ b/x\n@@ -1 +1 @@\n"), F.repeat(F.lit("-old\n"), (node % 4).cast("int")), F.lit("+new\n same\n"))


def _files(v) -> DataFrame:
    patches = v.v_nodes.where("run % 6 <> 0").groupBy("run").agg(F.array_join(F.collect_list(_chunk()), "").alias("patch"))
    return workplace.patch_files(patches, ["run"], "patch").withColumn("category", workplace.file_category(F.col("path")))


def _basics(v) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _BRIEFS)), (F.col("req") % 8).cast("int") + 1)
    briefs = threads.brief(v.v_reqs.where("floor(req / 8) % 8 = run % 8").select("run", text.alias("text")), ["run"], "text")
    end = F.when(F.col("run") % 4 == 0, "time_budget").when(F.col("run") % 4 == 1, "done")
    runs = v.v_runs.select("run", end.alias("end_reason"), F.when(F.col("run") % 11 != 0, F.col("run") % 9 * 10).alias("note_bytes"))
    return threads.basics(runs, briefs, threads.patch_counts(_files(v), ["run"]), ["run"])


@query("g08_edited_tests", _G08 + "select run, path, status, removed from tests")
def g08_files(v):
    return threads.edited_tests(_files(v)).select("run", "path", "status", "removed")


@query("g05_patch_sizes", _G08 + "select run, path, status, cast(1 as bigint) as added, removed from files")
def g05_sizes(v):
    return _files(v).drop("category")


@query("g08_run_basics", _G08 + "select * from basics")
def g08_basics(v):
    return _basics(v)


@query("j19_broken_rules", _G08 + "select run, 'edited_existing_tests' as rule from basics where test_rule and not migration_allowed and tests_edited > 0 union all select run, 'no_delivery_note' from basics where told_note and note_bytes < 50")
def j19_broken(v):
    return threads.broken_rules(_basics(v), ["run"])


@query("j19_rule_figures", _G08 + """, b as (select *, test_rule and not migration_allowed as ruled, test_rule and not migration_allowed and tests_edited > 0 as against, end_reason = 'time_budget' as timed from basics)
select count(case when ruled then 1 end) as rule_runs, count(case when against then 1 end) as edited_existing_tests, cast(coalesce(sum(case when against then tests_deleted end), 0) as bigint) as deleted_test_files, count(case when told_note then 1 end) as told_note,
count(case when told_note and note_bytes < 50 then 1 end) as no_note, count(case when timed then 1 end) as time_budget_runs, count(case when timed and note_bytes < 50 then 1 end) as time_budget_no_note, round(median(case when against then lines_removed end), 6) as lines_removed_median from b""")
def j19_figures(v):
    return r6(threads.rule_figures(v.written(_basics(v), "basics")), "lines_removed_median")


# --- J10, J21: losses and coverage

_STAGES = ("discovery", "ask", "read", "implement")
_CLASSES = ("solver_runtime_or_load_error", "functional_failed", "solver_compile_error", "timeout", "unspecified")
_J10 = """with n as (select run, status, case when node % 17 = 0 then 'excluded_infrastructure' when node % 19 = 0 then 'unmapped' when disclosure = 'not_disclosed' then case when node % 2 = 0 then 'ask' else 'discovery' end when disclosure = 'obtained' then 'implement' else 'read' end as stage,
case node % 5 when 0 then 'solver_runtime_or_load_error' when 1 then 'functional_failed' when 2 then 'solver_compile_error' when 3 then 'timeout' end as failure_class, case node % 3 when 0 then 'not_asked' when 1 then 'asked_other' end as ask_detail from v_nodes join v_reqs using (run, req)),
f as (select *, coalesce(stage in ('discovery', 'ask', 'read', 'implement'), false) as att from n where status = 'failed') """


def _losses(v) -> DataFrame:
    node, d = F.col("node"), F.col("disclosure")
    stage = (
        F.when(node % 17 == 0, "excluded_infrastructure").when(node % 19 == 0, "unmapped").when(d == "not_disclosed", F.when(node % 2 == 0, "ask").otherwise("discovery"))
        .when(d == "obtained", "implement").otherwise("read")
    )
    kind = F.element_at(F.array(*map(F.lit, (*_CLASSES[:4], None))), (node % 5).cast("int") + 1)
    detail = F.when(node % 3 == 0, "not_asked").when(node % 3 == 1, "asked_other")
    return v.v_nodes.join(v.v_reqs, ["run", "req"]).select("run", "status", stage.alias("stage"), kind.alias("failure_class"), detail.alias("ask_detail"))


@query("j10_loss_figures", _J10 + f"""select count(*) as failed, count(case when att then 1 end) as attributed, {', '.join(f"count(case when stage = '{s}' then 1 end) as n_{s}, round(100.0 * count(case when stage = '{s}' then 1 end) / nullif(count(case when att then 1 end), 0), 6) as pct_{s}" for s in _STAGES)},
count(case when stage = 'implement' and failure_class in ('solver_runtime_or_load_error', 'solver_compile_error') then 1 end) as build_or_load, count(case when stage = 'excluded_infrastructure' then 1 end) as excluded_infrastructure, count(case when stage = 'unmapped' then 1 end) as unmapped, count(distinct case when att then run end) as runs_with_failures from f""")
def j10_figures(v):
    return r6(threads.loss_figures(_losses(v), ["run"]), *[f"pct_{s}" for s in _STAGES])


@query("j10_loss_details", _J10 + "select 'ask_detail' as of, coalesce(ask_detail, '') as name, count(*) as n from f where stage = 'ask' group by 2 union all select 'implement_failure_class', coalesce(failure_class, ''), count(*) from f where stage = 'implement' group by 2")
def j10_details(v):
    return threads.loss_details(_losses(v))


_J21 = "with rec as (select run, case when total % 9 <> 0 then total % 4 <> 0 end as match, case total % 3 when 0 then 'exact;p2p' when 1 then 'node_log' end as notes from v_counts) "


def _reconciled(v) -> DataFrame:
    total = F.col("total")
    return v.v_counts.select("run", F.when(total % 9 != 0, total % 4 != 0).alias("match"), F.when(total % 3 == 0, "exact;p2p").when(total % 3 == 1, "node_log").alias("notes"))


@query("j21_coverage_figures", _J21 + """select (select count(*) from v_runs) as runs, (select count(case when match then 1 end) from rec) as reconciled, (select count(*) from v_reqs) as disclosures, (select count(case when req % 10 = 0 or disclosure <> 'obtained' then 1 end) from v_reqs) as disclosures_not_visible,
(select count(*) from (select distinct run, turn % 3 from v_turns where role <> 'user') t) as notifications_visible, (select count(*) from v_runs where run not in (select run from v_reqs)) as runs_without_links""")
def j21_figures(v):
    disclosures = v.v_reqs.select(F.when(F.col("req") % 10 != 0, F.col("disclosure") == "obtained").alias("visible"))
    notices = v.v_turns.where("role <> 'user'").select("run", (F.col("turn") % 3).alias("notice"))
    return threads.coverage_figures(v.v_runs, _reconciled(v), disclosures, notices, v.v_reqs, ["run"])


@query("j21_reconcile_methods", _J21 + "select split_part(coalesce(notes, ''), ';', 1) as method, count(*) as n from rec where match group by 1")
def j21_methods(v):
    return threads.reconcile_methods(_reconciled(v))


@query("j21_unreconciled", _J21 + "select run, notes from rec where not coalesce(match, false)")
def j21_others(v):
    return threads.unreconciled(_reconciled(v), ["run"])
