"""Queries of counts by outcome, gaps, availability and models side by side, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import comms, reviews, stats, telemetry
from runlens.plans.queries import _L, _RATE, _models, _runs, query, r6

#: A call's results by its actions: one in five has none, some say that they failed, some show it.
_CALLS = """with r as (select run, tool, args, case when end_us % 5 <> 0 then is_error end as said, case when end_us % 5 <> 0 then end_us % 3 = 0 end as other from v_actions),
c as (select run, tool, args, count(said) as n_results, count(case when said or other then 1 end) as bad, count(case when said then 1 end) > 0 as ie, count(case when other then 1 end) > 0 as ce from r group by run, tool, args),
b as (select run, tool, count(*) as calls, count(case when n_results > 0 and bad = 0 then 1 end) as n_success, count(case when n_results > 0 and bad = n_results then 1 end) as n_error, count(case when bad > 0 and bad < n_results then 1 end) as n_mixed, count(case when n_results = 0 then 1 end) as n_missing, cast(sum(n_results) as bigint) as n_results, count(case when ie then 1 end) as is_error_calls, count(case when ce then 1 end) as content_error_calls, count(case when tool = 'view' then 1 end) as query_calls from c group by run, tool) """


def _breakdown(v):
    flags = F.array_compact(F.array(F.when(F.col("is_error"), F.lit("is_error")), F.when(F.col("end_us") % 3 == 0, F.lit("structured_error"))))
    results = v.v_actions.withColumn("flags", F.when(F.col("end_us") % 5 != 0, flags))
    calls = telemetry.call_flags(results, ["run", "tool", "args"]).withColumn("is_query", F.col("tool") == "view")
    return telemetry.tool_breakdown(calls, ["run", "tool"], {"is_error_calls": "is_error", "content_error_calls": "content_error", "query_calls": "is_query"})


@query("b04_tool_breakdown_flags", _CALLS + "select * from b")
def b04_flags(v):
    return _breakdown(v)


@query("b11_recipients_outcomes", "select run, count(*) as attempts, count(case when action % 5 <> 0 and end_us % 3 <> 0 then 1 end) as n_success, count(case when action % 5 <> 0 and end_us % 3 = 0 then 1 end) as n_error, count(case when action % 5 = 0 then 1 end) as n_missing, count(distinct case when action % 7 <> 0 then args end) as recipients, coalesce(string_agg(distinct case when action % 7 <> 0 then args end, ',' order by case when action % 7 <> 0 then args end), '') as names from v_actions where is_ask group by run")
def b11_outcomes(v):
    asks = v.v_actions.where("is_ask").withColumns({"failed": F.when(F.col("action") % 5 != 0, F.col("end_us") % 3 == 0), "to": F.when(F.col("action") % 7 != 0, F.col("args"))})
    return telemetry.recipients(telemetry.call_outcome(asks, ["run", "to", "action"], "failed"), ["run"], "to", "outcome")


@query("b13_retry_status", "select r.run, coalesce(e.n, 0) as raw, e.d as reported, coalesce(e.n = e.d, false) as matches from v_runs r left join (select run, count(*) as n, count(distinct args) as d from v_actions where is_error group by run) e using (run)")
def b13_status(v):
    errors = v.v_actions.where("is_error").withColumn("delay", F.col("end_us") - F.col("start_us"))
    reported = errors.groupBy("run").agg(F.count_distinct("args").alias("reported"))
    return telemetry.retry_status(telemetry.api_retries(errors, ["run"], "args", "delay", "action"), v.v_runs.join(reported, "run", "left"), ["run"], "reported")


_B19 = "with t as (select run, count(*) as calls, count(case when is_error then 1 end) as errors from v_actions group by run) "


@query("b19_gap_rows", _B19 + "select run, 'no errors' as gap from t where errors = 0 union all select run, 'many errors' from t where errors * 5 > calls union all select run, 'few calls' from t where calls < 60")
def b19_gaps(v):
    t = v.v_actions.groupBy("run").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    return telemetry.gap_rows(t, ["run"], {"no errors": "errors = 0", "many errors": "errors * 5 > calls", "few calls": "calls < 60"})


@query("c05_availability_events", "select a.run, a.args, a.action, case a.tool when 'click' then 'availability_deferred' when 'error' then 'availability_followup_counted' else 'availability_opened' end as event, a.start_us, q.question_action from v_actions a left join (select run, args, min(action) as question_action from v_actions where is_ask group by run, args having count(*) = 1) q using (run, args) where a.tool in ('click', 'error', 'signup')")
def c05_events(v):
    kind = F.when(F.col("tool") == "click", comms.AVAILABILITY[0]).when(F.col("tool") == "error", comms.AVAILABILITY[1]).when(F.col("tool") == "signup", comms.AVAILABILITY[2])
    found = comms.availability(v.v_actions.withColumn("event", kind), "event", v.v_actions.where("is_ask"), ["run", "args"], "action")
    return found.select("run", "args", "action", "event", "start_us", "question_action")


@query("c06_unbound_events", "select run, action, case tool when 'error' then 'colleague_model_failed_closed' else 'conversation_transaction_rolled_back' end as event, 'unbound' as binding_status from v_actions where tool in ('error', 'signup')")
def c06_events(v):
    kind = F.when(F.col("tool") == "error", comms.UNBOUND[0]).when(F.col("tool") == "signup", comms.UNBOUND[1]).otherwise("question_answered")
    return comms.unbound_failures(v.v_actions.withColumn("event", kind), "event").select("run", "action", "event", "binding_status")


@query("j23_tool_totals_breakdown", _CALLS + "select tool, cast(sum(calls) as bigint) as calls, cast(sum(n_error) as bigint) as errors, count(*) as runs from b group by tool")
def j23_breakdown(v):
    return stats.tool_totals(_breakdown(v))


@query("j23_end_reasons", "select case when tool <> 'view' then tool end as reason, count(*) as runs from (select *, row_number() over (partition by run order by start_us desc, action desc) as rn from v_actions) t where rn = 1 group by 1")
def j23_reasons(v):
    last = v.v_actions.groupBy("run").agg(F.max_by("tool", F.struct("start_us", "action")).alias("tool"))
    return stats.end_reasons(last.withColumn("reason", F.when(F.col("tool") != "view", F.col("tool"))), "reason")


@query("l02_model_table", _L + "select model, round(max(case when metric = 'chars' then value end), 6) as chars, round(max(case when metric = 'notes' then value end), 6) as notes from m group by model union all select 'Mean', round(avg(case when metric = 'chars' then value end), 6), round(avg(case when metric = 'notes' then value end), 6) from m")
def l02_table(v):
    return r6(stats.model_table(_models(v), ["chars", "notes"]), "chars", "notes")


@query("j02_flagged_rows", _RATE + "select run from rr where flagged")
def j02_flagged(v):
    return stats.flagged_rows(_runs(v), ["run"], "flagged")


@query("j03_rate_marks", _RATE + "select count(case when f2p_rate >= 0.9 then 1 end) as high, count(case when f2p_rate < 0.25 then 1 end) as low, count(case when p2p_passed = p2p_total then 1 end) as p2p_kept, round(median(f2p_rate), 6) as median from rr")
def j03_marks(v):
    return r6(stats.rate_marks(_runs(v), "f2p_rate"), "median")


@query("j09_confidence_counts", "select case node % 4 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence, count(*) as n, count(case when node % 5 <> 0 then 1 end) as graded, count(case when node % 5 = 0 then 1 end) as unresolved from v_nodes group by 1")
def j09_confidence(v):
    confidence = F.when(F.col("node") % 4 == 0, "low").when(F.col("node") % 4 == 1, "medium").otherwise("high")
    status = F.when(F.col("node") % 5 == 0, "unresolved").otherwise(F.col("status"))
    return stats.confidence_counts(v.v_nodes.withColumns({"confidence": confidence, "status": status}), "confidence")


_H05 = """with u as (select run, nullif(node, case when node % 11 = 0 then node end) as response, ord2, ord3, case when ord2 % 3 <> 0 then ord1 end as input, case when ord2 % 5 <> 0 then ord2 end as output from v_records),
l as (select *, row_number() over (partition by run, response order by ord2 desc, ord3 desc) as rn from u where response is not null and (input is not null or output is not null))
select s.run, s.requests, s.responses, coalesce(t.with_usage, 0) as with_usage, t.input, t.output from (select run, count(*) as requests, count(distinct response) as responses from u group by run) s
left join (select run, count(*) as with_usage, cast(sum(coalesce(input, 0)) as bigint) as input, cast(sum(coalesce(output, 0)) as bigint) as output from l where rn = 1 group by run) t using (run)"""


@query("h05_reviewer_usage_snapshots", _H05)
def h05_snapshots(v):
    records = v.v_records.select("run", "ord2", "ord3", F.when(F.col("node") % 11 != 0, F.col("node")).alias("response"), F.when(F.col("ord2") % 3 != 0, F.col("ord1")).alias("input"), F.when(F.col("ord2") % 5 != 0, F.col("ord2")).alias("output"))
    return reviews.reviewer_usage(records, ["run"], "response", ["ord2", "ord3"], ["input", "output"])
