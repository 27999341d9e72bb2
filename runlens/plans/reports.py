"""Queries of the operators on reviews' and diagnoses' reports, with the SQL that they are checked against.

The reports are nested from the given tables; the SQL reads these tables flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators import reports
from runlens.plans.queries import query, r6

_STRATEGY = ("click", "view", "purchase")
_LENSES = ("premise_scrutiny", "consequential_prioritization", "cross_source_joining", "evidence_to_decision")
_KINDS = (*_LENSES, "retry", "other")
_TOOLS = ("click", "view", "purchase", "signup", "error")


def _pick(c: Column, *names: str) -> Column:
    """One of the names by the remainder of ``c``."""
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names)).cast("int") + 1)


def _case(c: str, *names: str) -> str:
    return "case {} % {} {} end".format(c, len(names), " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)))


# --- H03: states. Some runs have no status, some reports differ from the accepted ones, some break rules

_H03 = """with c as (select run, total, p2p_total - p2p_passed as lost, case when total % 5 = 0 then null when total % 6 = 0 then 'running' else 'complete' end as state from v_counts),
s as (select r.run, case when c.state is null then case when r.run % 3 = 0 then 'queued_in_controller' else 'not_scheduled' end when c.state <> 'complete' then c.state when lost > 2 or total % 7 = 0 or total % 4 = 1 then 'invalidated' else 'complete' end as state,
case when c.state = 'complete' then concat_ws(',', case when total % 7 = 0 then 'accepted report digest mismatch' end, case when lost > 3 then 'many losses' end, case when total % 4 = 1 then 'partial action-index coverage' end, case when lost > 2 then 'some losses' end) else '' end as errors from v_runs r left join c using (run)) """
_CHECKS = {"accepted report digest mismatch": "digest = accepted", "partial action-index coverage": "examined"}


def _states(v) -> DataFrame:
    c = v.v_counts.where("total % 5 <> 0")
    digest = F.sha2(F.concat_ws(" ", "run", "total"), 256)
    status = c.select("run", F.when(F.col("total") % 6 == 0, "running").otherwise("complete").alias("state"), digest.alias("digest"), F.when(F.col("total") % 7 != 0, digest).otherwise("").alias("accepted"), (F.col("total") % 4 != 1).alias("examined"))
    lost = v.v_nodes.where("node_class = 'p2p' and status <> 'passed'").groupBy("run").agg(F.count("*").alias("lost"))
    rules = F.array(F.when(F.col("lost") > 2, "some losses"), F.when(F.col("lost") > 3, "many losses"))
    problems = lost.select("run", F.explode(F.array_compact(rules)).alias("rule"))
    absent = F.when(F.col("run") % 3 == 0, "queued_in_controller").otherwise("not_scheduled")
    return reports.review_states(v.v_runs, status, problems, ["run"], absent, _CHECKS)


@query("h03_review_states", _H03 + "select run, state, errors from s")
def h03_states(v):
    return _states(v).select("run", "state", F.array_join("errors", ",").alias("errors"))


@query("h03_state_counts", _H03 + "select state, count(*) as n from s group by state union all select 'input_not_ready', 1000000 - count(*) from s")
def h03_counts(v):
    return reports.state_counts(_states(v), 1_000_000)


# --- H04 to H07: reports of runs. A tool is a dimension, its actions are phases, episodes, flags and evidence

_SCORED = "n % 5 <> 0"
_H04 = f"""with t as (select run, tool, count(*) as n, min(action) as a, max(action) as z from v_actions group by run, tool),
dims as (select run, case when tool in {_STRATEGY} then 'strategy_dimensions' else 'collaboration_dimensions' end as "group", tool as dimension, case when {_SCORED} then cast(n % 4 as int) end as score, case when {_SCORED} then 'observed' else 'no_opportunity' end as observation_status, {_case('n', 'low', 'medium', 'high')} as confidence, concat(run, ' ', tool) as assessment, concat(a, ',', z) as evidence_ids, case when n % 2 = 0 then '' else cast(a as varchar) end as counterevidence_ids from t),
phases as (select run, concat('phase ', action % 4) as phase, concat('e', action) as start_event_id, concat('e', action + 1) as end_event_id, case when action % 3 = 0 then '' else concat(tool, ',', 'k', action % 5) end as tags, args as description, cast(action as varchar) as evidence_ids from v_actions where tool = 'view'),
episodes as (select run, concat('E', action) as id, {_case('action', *_KINDS)} as kind, args as summary, cast(action as varchar) as evidence_ids, case when action % 2 = 0 then '' else concat(action, ',', action + 1) end as counterevidence_ids, case when {_case('action', *_KINDS)} in {_LENSES} then {_case('action', *_KINDS)} else '' end as lens from v_actions where tool = 'click'),
n as (select run, count(*) as n, count(case when is_error then 1 end) as e, list(args order by action) filter (where is_error) as errors, list(distinct tool order by tool) as tools from v_actions group by run),
stops as (select run, {_case('n', 'finished', 'gave_up', 'time_budget')} as ending_type, {_case('e', 'no', 'yes', 'unclear')} as premature_stop, cast(to_json(coalesce(errors, [])) as varchar) as known_unresolved_items, concat('after ', n) as reason, concat(n, ',', e) as evidence_ids from n),
coverage as (select run, n % 2 = 0 as action_index_fully_examined, n as total_actions, n - e as examined_actions, e as detailed_events_examined, p.c as validated_citations, cast(to_json(tools) as varchar) as files_examined, '[]' as missing_evidence, cast(to_json([concat('"', run, '" is short')]) as varchar) as coverage_limitations, cast(to_json(['one', 'two']) as varchar) as report_limitations from n left join (select run, count(case when is_ask then 1 end) as c from v_actions group by run) p using (run)),
issues as (select run, {_case('action', 'scope', 'grading', 'data')} as category, {_case('action', 'minor', 'major')} as severity, 'open' as status, args as description, concat('x', action) as evidence_ids from v_actions where is_error),
evidence as (select run, concat('V', action) as id, concat(tool, '.jsonl') as path, action % 50 + 1 as line_start, action % 50 + 3 as line_end, args as quote, args as supports from v_actions where is_ask)
"""
_DIM = ", ".join(f"max(case when dimension = '{t}' then score end) as {t}_score, max(case when dimension = '{t}' then observation_status end) as {t}_status" for t in _TOOLS)


def _reports(v) -> DataFrame:
    a, s = v.v_actions, lambda c: F.col(c).cast("string")
    action = F.col("action")
    listed = lambda when, *fields: F.coalesce(F.array_sort(F.collect_list(F.when(when, F.struct("action", *fields)))), F.array())
    phase = (
        F.concat(F.lit("phase "), action % 4).alias("phase"), F.concat(F.lit("e"), "action").alias("start_event_id"), F.concat(F.lit("e"), action + 1).alias("end_event_id"),
        F.when(action % 3 != 0, F.array("tool", F.concat(F.lit("k"), action % 5))).otherwise(F.array()).alias("tags"), F.col("args").alias("description"), F.array(s("action")).alias("evidence_ids"),
    )
    episode = (
        F.concat(F.lit("E"), "action").alias("id"), _pick(action, *_KINDS).alias("kind"), F.col("args").alias("summary"), F.array(s("action")).alias("evidence_ids"),
        F.when(action % 2 != 0, F.array(s("action"), (action + 1).cast("string"))).otherwise(F.array()).alias("counterevidence_ids"),
    )
    issue = (
        _pick(action, "scope", "grading", "data").alias("category"), _pick(action, "minor", "major").alias("severity"), F.lit("open").alias("status"), F.col("args").alias("description"),
        F.array(F.concat(F.lit("x"), "action")).alias("evidence_ids"),
    )
    evidence = (
        F.concat(F.lit("V"), "action").alias("id"), F.concat("tool", F.lit(".jsonl")).alias("path"), (action % 50 + 1).alias("line_start"), (action % 50 + 3).alias("line_end"), F.col("args").alias("quote"), F.col("args").alias("supports"),
    )
    per = a.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if("is_error").alias("e"), F.array_sort(F.collect_set("tool")).alias("tools"),
        listed(F.col("tool") == "view", *phase).alias("strategy_phases"), listed(F.col("tool") == "click", *episode).alias("episodes"),
        listed(F.col("is_error"), *issue).alias("quality_flags"), listed(F.col("is_ask"), *evidence).alias("evidence"),
    )
    n = F.col("n")
    dim = F.struct(
        F.col("tool").alias("id"), F.when(n % 5 != 0, (n % 4).cast("int")).alias("score"), F.when(n % 5 != 0, "observed").otherwise("no_opportunity").alias("observation_status"),
        _pick(n, "low", "medium", "high").alias("confidence"), F.concat_ws(" ", "run", "tool").alias("assessment"), F.array(s("a"), s("z")).alias("evidence_ids"),
        F.when(n % 2 != 0, F.array(s("a"))).otherwise(F.array()).alias("counterevidence_ids"),
    )
    strategic = F.col("tool").isin(*_STRATEGY)
    dims = a.groupBy("run", "tool").agg(F.count("*").alias("n"), F.min("action").alias("a"), F.max("action").alias("z"))
    dims = dims.groupBy("run").agg(*[F.collect_list(F.when(w, dim)).alias(g) for w, g in zip((strategic, ~strategic), reports.DIMENSION_GROUPS)])
    stop = F.struct(
        _pick(n, "finished", "gave_up", "time_budget").alias("ending_type"), _pick(F.col("e"), "no", "yes", "unclear").alias("premature_stop"), F.transform("quality_flags", lambda q: q["description"]).alias("known_unresolved_items"),
        F.concat(F.lit("after "), "n").alias("reason"), F.array(s("n"), s("e")).alias("evidence_ids"),
    )
    coverage = F.struct(
        (n % 2 == 0).alias("action_index_fully_examined"), n.alias("total_actions"), (n - F.col("e")).alias("examined_actions"), F.col("e").alias("detailed_events_examined"), F.col("tools").alias("files_examined"),
        F.array().cast("array<string>").alias("missing_evidence"), F.array(F.concat(F.lit('"'), "run", F.lit('" is short'))).alias("limitations"),
    )
    profile = F.struct(F.concat(F.lit("profile "), n % 3).alias("strategy_profile"))
    return per.join(dims, "run").withColumns({"stop_assessment": stop, "coverage": coverage, "summary": profile, "limitations": F.array(F.lit("one"), F.lit("two"))})


def _tables(v) -> dict[str, DataFrame]:
    return reports.report_tables(_reports(v), ["run"], _TOOLS, _LENSES)


def _table(name: str) -> None:
    query(f"h04_{name}", f"{_H04} select * from {'dims' if name == 'dimensions' else name}")(lambda v: _tables(v)[name].drop("action"))


for _name in ("dimensions", "phases", "episodes", "stops", "coverage", "issues", "evidence"):
    _table(_name)


@query("h04_runs", f"""{_H04}, d as (select run, {_DIM} from dims group by run), q as (select run, string_agg(distinct category, ',' order by category) as quality_flag_categories, count(*) as c from issues group by run)
select d.*, concat('profile ', n % 3) as strategy_profile, ending_type, premature_stop, coalesce(quality_flag_categories, '') as quality_flag_categories, coalesce(c, 0) as quality_flag_count, validated_citations as evidence_count from d join n using (run) join stops using (run) join coverage using (run) left join q using (run)""")
def h04_runs(v):
    return _tables(v)["runs"].withColumns({c: F.col(c).cast("bigint") for c in ("quality_flag_count", "evidence_count")})


@query("h07_label_counts", f"""{_H04} select 'premature_stop' as of, premature_stop as name, count(*) as n from stops group by 2 union all select 'ending_type', ending_type, count(*) from stops group by 2
union all select 'lens', lens, count(*) from episodes where lens <> '' group by 2 union all select 'quality_category', category, count(distinct run) from issues group by 2""")
def h07_labels(v):
    t = _tables(v)
    return reports.review_counts(t["stops"], t["episodes"], t["issues"], ["run"])


@query("h06_dimension_summary", f"""{_H04}, rates as (select run, avg(case when is_error then 1.0 else 0.0 end) as rate from v_actions group by run),
j as (select dimension, score, rate, rank() over (partition by dimension order by score) + (count(*) over (partition by dimension, score) - 1) / 2.0 as a, rank() over (partition by dimension order by rate) + (count(*) over (partition by dimension, rate) - 1) / 2.0 as b from dims join rates using (run) where score is not null),
s as (select dimension, count(*) as association_n, case when count(*) >= 3 and count(distinct score) > 1 and count(distinct rate) > 1 then corr(a, b) end as rho from j group by dimension)
select d.dimension, count(score) as rated, {', '.join(f'count(case when score = {i} then 1 end) as n{i}' for i in range(4))}, count(case when observation_status = 'observed' then 1 end) as status_observed, count(case when observation_status = 'no_opportunity' then 1 end) as status_no_opportunity,
round(median(score), 6) as median, round(avg(score), 6) as mean, coalesce(any_value(association_n), 0) as association_n, round(any_value(rho), 6) as rho from dims d left join s on s.dimension = d.dimension group by d.dimension""")
def h06_summary(v):
    rates = v.v_actions.groupBy("run").agg(F.avg(F.col("is_error").cast("int")).alias("rate"))
    out = reports.dimension_summary(_tables(v)["dimensions"], rates, ["run"], "rate", ("observed", "no_opportunity"))
    return r6(out, "median", "mean", "rho")


@query("h05_response_models", """with s as (select run, args, arg_max(tool, action) as model from v_actions where not is_error and args is not null group by run, args)
select r.run, coalesce(string_agg(distinct model, ',' order by model), '') as models from (select distinct run from v_actions) r left join s using (run) group by r.run""")
def h05_models(v):
    return reports.response_models(v.v_actions.withColumn("model", F.when(~F.col("is_error"), F.col("tool"))), ["run"], "args", ["action"])


# --- H11, H12: diagnoses of the requirements that have failed nodes

_PIPELINE = "case disclosure when 'obtained' then 'implement' when 'returned_not_visible' then 'read' else 'ask' end"
_H11 = f"""with f as (select run, req, count(*) as nodes_total, count(case when status = 'failed' then 1 end) as nodes_failed, string_agg('[' || node_class || '] node ' || node, ' → ' order by node) as chain from v_nodes group by run, req),
diagnoses as (select run, req as req_id, concat('card-', req % 9) as card, holder, nodes_failed, nodes_total, {_PIPELINE} as pipeline_stage, case when req % 4 = 0 then 'discovery' else {_PIPELINE} end as stage, req % 4 <> 0 as stage_agrees, {_case('req', 'misread', 'never_asked', 'wrong_layer')} as mechanism, {_case('req', 'yes', 'partly')} as agent_responsible, {_case('nodes_total', 'honest', 'silent', 'absent')} as note_verdict, 'high' as confidence, holder as what_was_needed, disclosure as counterfactual_step, '' as mechanism_note, chain from f join v_reqs using (run, req) where nodes_failed > 0),
findings as (select run, concat('F', req_id) as id, {_case('req_id', 'new', 'known', 'reversed')} as novelty, holder as title, concat(req_id, ',', req_id + 1) as req_ids, card as description from diagnoses where nodes_failed > 1),
revisions as (select run, concat('d', req_id % 5) as dimension_or_field, stage as round1, pipeline_stage as revision, mechanism as reason from diagnoses where not stage_agrees),
runs as (select d.run, concat(f2p_passed, '/', f2p_total) as f2p, concat('run ', d.run) as headline, {_case('c.total', 'accurate', 'overstated')} as delivery_audit, min(mechanism) as dominant_mechanism, count(case when note_verdict = 'silent' then 1 end) as overstated, count(*) as diagnosed, count(case when not stage_agrees then 1 end) as disagreements, count(case when nodes_failed > 1 then 1 end) as findings, count(case when not stage_agrees then 1 end) as revisions, concat('of ', c.total) as case_paragraph from diagnoses d join v_counts c on c.run = d.run group by d.run, f2p_passed, f2p_total, c.total) """


def _diagnoses(v) -> dict[str, DataFrame]:
    v.keep("v_nodes")
    step = F.struct("node", F.col("node_class").alias("phase"), F.concat(F.lit("node "), "node").alias("description"))
    failed = v.v_nodes.groupBy("run", "req").agg(F.count("*").alias("nodes_total"), F.count_if(F.col("status") == "failed").alias("nodes_failed"), F.array_sort(F.collect_list(step)).alias("steps"))
    req = F.col("req")
    pipeline = F.when(F.col("disclosure") == "obtained", "implement").when(F.col("disclosure") == "returned_not_visible", "read").otherwise("ask")
    diagnosis = F.struct(
        req.alias("req_id"), F.concat(F.lit("card-"), req % 9).alias("card"), "holder", "nodes_failed", "nodes_total", pipeline.alias("pipeline_stage"),
        F.when(req % 4 == 0, "discovery").otherwise(pipeline).alias("stage"), (req % 4 != 0).alias("stage_agrees"), _pick(req, "misread", "never_asked", "wrong_layer").alias("mechanism"),
        _pick(req, "yes", "partly").alias("agent_responsible"), F.struct(_pick(F.col("nodes_total"), "honest", "silent", "absent").alias("verdict")).alias("delivery_note"), F.lit("high").alias("confidence"),
        F.col("holder").alias("what_was_needed"), F.col("disclosure").alias("counterfactual_step"), F.lit("").alias("mechanism_note"), F.col("steps").alias("what_happened"),
    )
    own = failed.where("nodes_failed > 0").join(v.v_reqs, ["run", "req"]).groupBy("run").agg(F.array_sort(F.collect_list(diagnosis)).alias("requirements"))
    finding = lambda r: F.struct(
        F.concat(F.lit("F"), r["req_id"]).alias("id"), _pick(r["req_id"], "new", "known", "reversed").alias("novelty"), r["holder"].alias("title"),
        F.array(r["req_id"].cast("string"), (r["req_id"] + 1).cast("string")).alias("req_ids"), r["card"].alias("description"),
    )
    revision = lambda r: F.struct(F.concat(F.lit("d"), r["req_id"] % 5).alias("dimension_or_field"), r["stage"].alias("round1"), r["pipeline_stage"].alias("revision"), r["mechanism"].alias("reason"))
    differ = F.filter("requirements", lambda r: ~r["stage_agrees"])
    built = own.join(v.v_counts, "run").withColumns({
        "delivery_audit": F.struct(_pick(F.col("total"), "accurate", "overstated").alias("verdict"), F.filter("requirements", lambda r: r["delivery_note"]["verdict"] == "silent").alias("overstated_items")),
        "stage_summary": F.struct(F.array_min(F.transform("requirements", lambda r: r["mechanism"])).alias("dominant_mechanism"), differ.alias("disagreements_with_pipeline")),
        "outcome": F.struct("f2p_passed", "f2p_total"),
        "workplace_findings": F.transform(F.filter("requirements", lambda r: r["nodes_failed"] > 1), finding),
        "blind_review_revisions": F.transform(differ, revision), "headline": F.concat(F.lit("run "), "run"), "case_paragraph": F.concat(F.lit("of "), "total"),
    })
    return reports.diagnosis_report_tables(built, ["run"])


def _diagnosis_table(name: str) -> None:
    @query(f"h11_{name}", f"{_H11} select * from {name}")
    def table(v):
        found = _diagnoses(v)[name]
        sizes = [c for c in ("overstated", "diagnosed", "disagreements", "findings", "revisions") if c in found.columns]
        return found.withColumns({c: F.col(c).cast("bigint") for c in sizes})


for _name in ("diagnoses", "runs", "findings", "revisions"):
    _diagnosis_table(_name)


@query("h12_diagnosis_counts", f"""{_H11} {' union all '.join(f"select '{c}' as of, {c} as name, count(*) as n from diagnoses group by 2" for c in ('stage', 'pipeline_stage', 'mechanism', 'agent_responsible', 'note_verdict'))}
union all select 'stage_matrix', concat(pipeline_stage, '->', stage), count(*) from diagnoses group by 2 union all select 'delivery_audit', delivery_audit, count(*) from runs group by 2 union all select 'novelty', novelty, count(*) from findings group by 2""")
def h12_counts(v):
    return reports.diagnosis_counts(_diagnoses(v))


@query("h12_diagnosis_totals", f"{_H11} select (select count(*) from runs) as runs, (select count(*) from revisions) as revisions, count(*) as requirements, round(avg(case when stage_agrees then 1 else 0 end), 6) as stage_agreement from diagnoses")
def h12_totals(v):
    return r6(reports.diagnosis_totals(_diagnoses(v)), "stage_agreement")
