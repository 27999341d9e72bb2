"""One query per operator on the bound views, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.operators import collab, comms, nodes, normalize, relational, reviews, stats, telemetry, workplace
from runlens.plans.bindings import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable:
    def register(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return register


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- A: normalisation


@query("a03_select_runs", "select run, count(*) as attempts, count(distinct holder) = 1 as consistent, any_value(domain) as domain from v_reqs join v_runs using (run) where disclosure = 'obtained' group by run")
def a03(v):
    index = v.v_reqs.withColumn("selected", F.col("disclosure") == "obtained")
    return normalize.select_runs(index, v.v_runs.select("run", "domain"), ["run"], ["holder"])


@query("a04_drop_heartbeats", "select run, count(case when tool = 'view' then 1 end) as heartbeats, count(case when tool <> 'view' then 1 end) as kept from v_actions group by run")
def a04(v):
    kept, beats = normalize.drop_heartbeats(v.v_actions, F.col("tool") == "view", ["run"])
    return kept.groupBy("run").agg(F.count("*").alias("kept")).join(beats, "run", "full_outer").select("run", F.coalesce("heartbeats", F.lit(0)).alias("heartbeats"), F.coalesce("kept", F.lit(0)).alias("kept"))


@query("a05_sequence_events", "select run, action, row_number() over w as sequence, cast(sum(case when tool = 'signup' then 1 else 0 end) over w as bigint) as init_segment from v_actions window w as (partition by run order by start_us, action rows unbounded preceding)")
def a05(v):
    out = normalize.sequence_events(v.v_actions, ["run"], ["start_us", "action"], F.col("tool") == "signup")
    return longs(out.select("run", "action", "sequence", "init_segment"), "sequence", "init_segment")


@query("a06_replay_flags", "select run, action, nullif(first_value(action) over (partition by run, tool, args order by start_us, action), action) as replay_of from v_actions")
def a06(v):
    return normalize.replay_flags(v.v_actions, ["run"], ["tool", "args"], ["start_us", "action"], "action").select("run", "action", "replay_of")


@query("a08_extract_calls", "select node, arg_min(status, (ord1, ord2, ord3)) as status, arg_min(node_class, (ord1, ord2, ord3)) as node_class, count(*) - 1 as replays, count(distinct status || node_class) > 1 as conflicting from v_records group by node")
def a08(v):
    return normalize.extract_calls(v.v_records, ["node"], ["ord1", "ord2", "ord3"], ["status", "node_class"])


_A09 = """with f as (select node, min(ord1) as call_at from v_records group by node),
p as (select r.node, r.ord1, r.ord2, r.ord3, case when not r.ord1 > f.call_at then 'orphan' when count(case when r.ord1 > f.call_at then 1 end) over (partition by r.node order by r.ord1 rows unbounded preceding) > 1 then 'repeat_result' else 'result' end as status from v_records r join f using (node))
select status, count(*) as n from p group by status"""


@query("a09_pair_results", _A09)
def a09(v):
    v.keep("v_records", "node", "ord1")
    calls = v.v_records.groupBy("node").agg(F.min("ord1").alias("ord1"))
    return normalize.pair_results(calls, v.v_records.select("node", "ord1"), ["node"], "ord1").groupBy("status").agg(F.count("*").alias("n"))


@query("a10_message_exposures", "select run, turn, text as message, row_number() over (partition by run, text order by turn) as exposure, first_value(turn) over (partition by run, text order by turn) as first_at from v_turns")
def a10(v):
    out = normalize.message_exposures(v.v_turns.withColumnRenamed("text", "message"), ["run"], "message", ["turn"])
    return longs(out.select("run", "turn", "message", "exposure", "first_at"), "exposure")


@query("a12_faults", "select run, action, 'event' as kind from v_actions where tool = 'view' and is_edit = false and args like '%1}' union all select run, action, 'result' from v_actions where is_error")
def a12(v):
    return normalize.faults(v.v_actions, v.v_actions, (F.col("tool") == "view") & F.col("args").endswith("1}"), F.col("is_error"), ["run", "action"])


@query("a13_input_counts", "select run, count(*) as calls, count(distinct tool) as tools, count(distinct args) as signatures, count(case when is_error then 1 end) as errors from v_actions group by run")
def a13(v):
    return v.v_actions.groupBy("run").agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"), F.count_distinct("args").alias("signatures"), F.count_if("is_error").alias("errors"))


@query("a16_audit_coverage", "select node, 'missing' as problem from v_nodes where node % 97 = 0")
def a16(v):
    raw = v.v_nodes.select("node", F.md5(F.concat_ws("|", "req", "status")).alias("digest"))
    return normalize.audit_coverage(raw, raw.where("node % 97 <> 0"), ["node"], "digest")


@query("a17_audit_pointers", "select node, req from v_nodes where node % 97 = 0")
def a17(v):
    return normalize.audit_pointers(v.v_nodes.select("node", "req"), v.v_nodes.where("node % 97 <> 0"), ["node"], "req")


@query("a19_prep_summary", "select count(*) as expected, count(n) as ready, count(*) - count(n) as missing, cast(sum(n) as bigint) as rows, cast(sum(s) as bigint) as size from v_runs left join (select run, count(*) as n, sum(req) as s from v_nodes group by run) g using (run)")
def a19(v):
    return normalize.prep_summary(v.v_runs, v.v_nodes, ["run"], "req")


@query("a20_observability", "select run, case when exists (select 1 from v_actions a where a.run = v_runs.run) then 'observed' else 'no events' end as state from v_runs")
def a20(v):
    return normalize.observability(v.v_runs, v.v_actions, ["run"], "no events")


# --- B: telemetry

_B03 = "with c as (select run, tool, args, count(is_error) as n_results, case when count(is_error) = 0 then 'missing' when count(case when not is_error then 1 end) = count(is_error) then 'success' when count(case when not is_error then 1 end) = 0 then 'error' else 'mixed' end as outcome from (select run, tool, args, end_us % 3 = 0 as is_error from v_actions) t group by run, tool, args) "


def _outcomes(v):
    return telemetry.call_outcome(v.v_actions.withColumn("is_error", F.col("end_us") % 3 == 0), ["run", "tool", "args"])


@query("b03_call_outcome", _B03 + "select * from c")
def b03(v):
    return _outcomes(v)


@query("b04_tool_breakdown", _B03 + "select run, tool, count(*) as calls, count(case when outcome = 'success' then 1 end) as n_success, count(case when outcome = 'error' then 1 end) as n_error, count(case when outcome = 'mixed' then 1 end) as n_mixed, count(case when outcome = 'missing' then 1 end) as n_missing, cast(sum(n_results) as bigint) as n_results from c group by run, tool")
def b04(v):
    return telemetry.tool_breakdown(_outcomes(v), ["run", "tool"])


@query("b05_identical_calls", "select run, tool, count(*) as signatures, cast(sum(n - 1) as bigint) as repeats from (select run, tool, args, count(*) as n from v_actions group by all) t group by run, tool")
def b05(v):
    return telemetry.identical_calls(v.v_actions, ["run", "tool"], ["args"])


@query("b06_repeat_queries", "select run, count(*) as signatures, cast(sum(n - 1) as bigint) as repeats from (select run, args, count(*) as n from v_actions where tool = 'view' group by all) t group by run")
def b06(v):
    return telemetry.identical_calls(v.v_actions.where("tool = 'view'"), ["run"], ["args"])


@query("b07_surfaces", "select run, count(distinct tool) as attempted, count(distinct case when not is_error then tool end) as returned, coalesce(string_agg(distinct tool, ',' order by tool), '') as attempted_names, coalesce(string_agg(distinct case when not is_error then tool end, ',' order by case when not is_error then tool end), '') as returned_names from v_actions group by run")
def b07(v):
    return telemetry.surfaces(v.v_actions.withColumn("clean", ~F.col("is_error")), ["run"], "tool", "clean")


_B09 = """with o as (select run, start_us, end_us, max(end_us) over (partition by run order by start_us, end_us rows between unbounded preceding and 1 preceding) as seen from v_actions where end_us >= start_us),
i as (select *, sum(case when seen is null or start_us > seen then 1 else 0 end) over (partition by run order by start_us, end_us rows unbounded preceding) as island from o)
select run, cast(sum(len) as bigint) as covered from (select run, island, max(end_us) - min(start_us) as len from i group by run, island) t group by run"""


@query("b09_interval_union", _B09)
def b09(v):
    return relational.interval_union(v.v_actions, "start_us", "end_us", ["run"])


@query("b10_interval_sum", "select run, cast(sum(end_us - start_us) as bigint) as summed from v_actions where end_us >= start_us group by run")
def b10(v):
    return relational.interval_sum(v.v_actions, "start_us", "end_us", ["run"])


@query("b11_recipients", "select run, count(*) as attempts, count(distinct args) as recipients, string_agg(distinct args, ',' order by args) as names from v_actions where is_ask group by run")
def b11(v):
    return telemetry.recipients(v.v_actions.where("is_ask"), ["run"], "args")


@query("b12_dynamic_messages", "select run, count(*) as occurrences, count(distinct text) as unique_ids, count(distinct case when role = 'system' then text end) as n_notification, count(distinct case when role = 'assistant' then text end) as n_answer, count(distinct case when role = 'user' then text end) as n_question, count(*) - count(distinct text) as repeats, count(distinct text) - count(distinct case when role = 'system' then text end) - count(distinct case when role = 'assistant' then text end) - count(distinct case when role = 'user' then text end) as n_other from v_turns group by run")
def b12(v):
    kind = F.when(F.col("role") == "system", "notification").when(F.col("role") == "assistant", "answer").otherwise("question")
    return telemetry.dynamic_messages(v.v_turns.withColumn("kind", kind), ["run"], "text", "kind")


@query("b13_api_retries", "select run, cast(sum(n) as bigint) as raw, count(*) as unique_events, cast(sum(case when delay >= 0 then delay end) as bigint) as delay, count(case when delay is null or delay < 0 then 1 end) as no_delay from (select run, args, count(*) as n, arg_min(end_us - start_us, action) as delay from v_actions where is_error group by run, args) t group by run")
def b13(v):
    return telemetry.api_retries(v.v_actions.where("is_error").withColumn("delay", F.col("end_us") - F.col("start_us")), ["run"], "args", "delay", "action")


@query("b14_message_usage", "select run, count(*) as messages, cast(sum(n - 1) as bigint) as duplicates, cast(sum(a) as bigint) as ord1, cast(sum(b) as bigint) as ord2 from (select run, node, count(*) as n, max(ord1) as a, max(ord2) as b from v_records group by run, node) t group by run")
def b14(v):
    return telemetry.message_usage(v.v_records, ["run"], "node", ["ord1", "ord2"])


@query("b16_usage_crosscheck", "select u.run, u.ord1, s.ord1 as saved, case when s.ord1 is not null then s.ord1 = u.ord1 end as agrees from (select run, cast(sum(ord1) as bigint) as ord1 from v_records group by run) u left join (select run, cast(sum(ord1) as bigint) as ord1 from v_records where node_class = 'f2p' group by run) s using (run)")
def b16(v):
    total = lambda d: d.groupBy("run").agg(F.sum("ord1").alias("ord1"))
    return telemetry.usage_crosscheck(total(v.v_records), total(v.v_records.where("node_class = 'f2p'")), ["run"], "ord1")


@query("b18_run_invariants", "select run, count(*) as total, count(case when node_class = 'f2p' then 1 end) as added from v_nodes group by run having count(*) <> count(case when node_class = 'f2p' then 1 end)")
def b18(v):
    t = v.v_nodes.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("node_class") == "f2p").alias("f2p"))
    return telemetry.run_invariants(t, ["run"], "n", ["f2p"])


@query("b19_telemetry_totals", "select count(*) as runs, cast(sum(calls) as bigint) as calls, cast(sum(errors) as bigint) as errors, count(case when errors = 0 then 1 end) as gap_runs from (select run, count(*) as calls, count(case when is_error then 1 end) as errors from v_actions group by run) t")
def b19(v):
    return telemetry.telemetry_totals(a13(v).withColumn("gap", F.col("errors") == 0), ["calls", "errors"], "gap")


# --- C: communication


def _turn_tables(v):
    user = v.v_turns.where("role = 'user'")
    asks = user.select("run", F.col("turn").alias("ask"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("question_id"), F.col("role").alias("recipient"), "text")
    return asks, user.select("run", F.col("turn").alias("question"), F.col("role").alias("recipient"), "text")


_C03 = """with a as (select run, turn as ask, case when turn % 2 = 0 then turn end as qid, text from v_turns where role = 'user'),
one as (select run, qid as question, count(*) as n, min(ask) as ask from a where qid is not null group by run, qid),
q as (select t.run, t.turn as question, t.text, o.n, o.ask from v_turns t left join one o on o.run = t.run and o.question = t.turn where t.role = 'user'),
ua as (select run, text, min(ask) as ask from a group by run, text having count(*) = 1),
uq as (select run, text, min(question) as question from q where n is null group by run, text having count(*) = 1)
select q.run, q.question, coalesce(case when q.n = 1 then q.ask end, m.ask) as ask, case when q.n = 1 then 'question_id' when m.ask is not null then 'recipient_text' else 'unbound' end as method
from q left join (select uq.run, uq.question, ua.ask from uq join ua using (run, text)) m on m.run = q.run and m.question = q.question and q.n is null"""


@query("c03_bind_questions", _C03)
def c03(v):
    return comms.bind_questions(*_turn_tables(v))


@query("c04_fact_disclosures", "select run, args, start_us, row_number() over w as ordinal, min(case when not is_error then start_us end) over (partition by run, args) as first_visible from v_actions window w as (partition by run, args order by start_us, action)")
def c04(v):
    out = comms.fact_disclosures(v.v_actions.withColumn("visible", ~F.col("is_error")), ["run", "args"], ["start_us", "action"], "visible")
    return longs(out.select("run", "args", "start_us", "ordinal", "first_visible"), "ordinal")


@query("c05_availability", "select a.action, a.run, a.args, b.n as opened from v_actions a left join (select run, args, count(*) as n from v_actions where is_edit group by run, args) b using (run, args) where a.is_ask")
def c05(v):
    opened = v.v_actions.where("is_edit").groupBy("run", "args").agg(F.count("*").alias("opened"))
    return v.v_actions.where("is_ask").select("action", "run", "args").join(opened, ["run", "args"], "left")


@query("c06_unbound_failures", "select run, action, args from v_actions where is_error")
def c06(v):
    return v.v_actions.where("is_error").select("run", "action", "args")


@query("c07_card_chains", "select run, args, action, row_number() over w as ordinal, lead(action) over w as next_item from v_actions where is_ask window w as (partition by run, args order by start_us, action)")
def c07(v):
    out = collab.chain_positions(v.v_actions.where("is_ask"), ["run", "args"], ["start_us", "action"], "action")
    return longs(out.select("run", "args", "action", "ordinal", "next_item"), "ordinal")


@query("c08_notification_chains", "select n.run, n.action as notice, n.args as token, n.start_us as at, count(case when a.start_us > n.start_us then 1 end) as later_actions, min(case when a.start_us > n.start_us then a.start_us end) as first_later from v_actions n left join v_actions a on a.run = n.run and a.args = n.args and a.is_edit where n.is_ask group by n.run, n.action, n.args, n.start_us")
def c08(v):
    of = v.v_actions.select("run", F.col("args").alias("token"), F.col("start_us").alias("at"), "action", "is_ask", "is_edit")
    return comms.notification_chains(of.where("is_ask").select("run", F.col("action").alias("notice"), "token", "at"), of.where("is_edit"), ["run"])


@query("c09_released_unseen", "select run, action, args from v_actions a where is_ask and not exists (select 1 from v_actions b where b.is_edit and b.run = a.run and b.args = a.args)")
def c09(v):
    return comms.never_seen(v.v_actions.where("is_ask").select("run", "action", "args"), v.v_actions.where("is_edit"), ["run", "args"])


@query("c10_ask_rollup", "select run, case when run % 7 <> 0 then count(*) end as replies, case when run % 7 <> 0 then count(distinct args) end as facts from v_actions where is_ask group by run")
def c10(v):
    t = v.v_actions.where("is_ask").groupBy("run").agg(F.count("*").alias("replies"), F.count_distinct("args").alias("facts")).withColumn("has", F.col("run") % 7 != 0)
    return comms.null_without(t, "has", ["replies", "facts"]).drop("has")


@query("c12_link_ratios", "select cast(sum(asks) as bigint) as asks, cast(sum(bound) as bigint) as bound from (select run, count(*) as asks, count(case when turn % 2 = 0 then 1 end) as bound from v_turns where role = 'user' group by run) t")
def c12(v):
    t = v.v_turns.where("role = 'user'").groupBy("run").agg(F.count("*").alias("asks"), F.count_if(F.col("turn") % 2 == 0).alias("bound"))
    return comms.link_ratio(t, [("bound", "asks")])


@query("c13_validate_refs", "select distinct node, req from v_records where node % 89 = 0")
def c13(v):
    v.keep("v_records")
    return comms.check_refs(v.v_records.select("node", "req"), v.v_nodes.where("node % 89 <> 0"), ["node"], "req")


# --- D: nodes


@query("d01_run_snapshot", "select run, f2p_total, f2p_passed, p2p_total, p2p_passed, round(f2p_passed / nullif(f2p_total, 0), 6) as f2p_rate, round(p2p_passed / nullif(p2p_total, 0), 6) as p2p_rate from v_counts")
def d01(v):
    return r6(nodes.run_snapshot(v.v_nodes, ["run"]), "f2p_rate", "p2p_rate")


_LABEL = "case node % 7 when 0 then 'Runner_Error' when 1 then 'timed_out' when 2 then 'compile failure' when 3 then 'import' when 4 then 'assertion' when 5 then null else 'odd' end"
_MESSAGE = "case node % 3 when 0 then 'expected 1' when 1 then 'request Timed Out' else 'none' end"


@query("d02_norm_status", "select raw, case when lower(trim(raw)) in ('green','ok','pass','passed','succeeded','success','true') then 'passed' when regexp_matches(lower(trim(raw)), '^(other|pending|red|false)$') or regexp_matches(lower(trim(raw)), '" + "|".join(rules.FAILED_PARTS) + "') then 'failed' end as status, count(*) as n from (select case node % 9 when 0 then ' Passed ' when 1 then 'FAIL' when 2 then 'ok' when 3 then '17' when 4 then 'infra_error' when 5 then 'red' when 6 then 'was skipped' when 7 then null else status end as raw from v_nodes) t group by raw")
def d02(v):
    raw = v.v_nodes.select(F.expr("case node % 9 when 0 then ' Passed ' when 1 then 'FAIL' when 2 then 'ok' when 3 then '17' when 4 then 'infra_error' when 5 then 'red' when 6 then 'was skipped' when 7 then null else status end").alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).select("raw", nodes.norm_status(F.col("raw")).alias("status"), "n")


@query("d06_match_nodes", "select run, record, case when record % 5 = 0 then 'prefixed' else 'exact' end as tier, node as matched from (select run, node as record, node from v_nodes) t")
def d06(v):
    v.keep("v_nodes")
    base = v.v_nodes.select("run", F.col("node").alias("record"), F.when(F.col("node") % 5 == 0, F.concat(F.lit("test_"), "node")).otherwise(F.col("node").cast("string")).alias("name"))
    named = v.v_nodes.select("node")
    keys = [("exact", F.col("name"), F.col("node").cast("string")), ("prefixed", F.regexp_replace("name", "^test_", ""), F.col("node").cast("string"))]
    return nodes.match_tiers(base, named, keys).drop("name")


@query("d07_merge_json_evidence", "select node, arg_min(status, (ord1, ord2, ord3)) as status, arg_min(l, (ord1, ord2, ord3)) filter (where l is not null) as label from (select *, case when status = 'failed' then node_class end as l from v_records) t group by node")
def d07(v):
    return nodes.merge_json_evidence(v.v_records.withColumn("label", F.col("node_class")), ["node"], ["ord1", "ord2", "ord3"])


@query("d08_merge_text_evidence", """with p as (select req, node, status, 'p' || (ord1 % 3) as pattern, ord1 * 10000000000000 + ord2 * 1000000000 + cast(round(ord3 * 100) as bigint) as place from v_records),
l as (select req, pattern, node, arg_max(status, place) as status from p group by req, pattern, node),
n as (select req, pattern, row_number() over (partition by req order by count(*) desc, pattern) as rn from l group by req, pattern)
select l.req, l.pattern, l.node, l.status from l join n on n.req = l.req and n.pattern = l.pattern and n.rn = 1""")
def d08(v):
    lines = v.v_records.select("req", "node", "status", F.concat(F.lit("p"), F.col("ord1") % 3).alias("pattern"), F.expr("cast(ord1 as decimal(20, 0)) * 10000000000000 + cast(ord2 as decimal(20, 0)) * 1000000000 + cast(round(ord3 * 100) as decimal(20, 0))").alias("at"))  # past 64 bits
    return nodes.merge_text_evidence(lines, ["req"], "node", "pattern", "at").select("req", "pattern", "node", "status")


_D09 = f"case {{l}} when 'Runner_Error' then 'infrastructure_or_blocked' when 'timed_out' then 'timeout' when 'compile failure' then 'solver_compile_error' when 'import' then 'solver_runtime_or_load_error' when 'assertion' then 'functional_failed' else case {_MESSAGE} when 'expected 1' then 'functional_failed' when 'none' then 'unspecified' else 'timeout' end end"


@query("d09_failure_class", f"select node, {_D09.format(l=_LABEL)} as failure_class from v_nodes where status = 'failed'")
def d09(v):
    return _failed(v).select("node", "failure_class")


def _failed(v):
    return v.v_nodes.where("status = 'failed'").withColumn("failure_class", nodes.failure_class(F.expr(_LABEL), F.expr(_MESSAGE)))


@query("d12_rank_candidates", "select page_id, case when regexp_matches(url, '\\.html$') then 6 when contains(url, 'private-runtime') then 5 else 6 end as priority from pages")
def d12(v):
    return v.pages.select("page_id", nodes.candidate_rank(F.col("url")).alias("priority"))


_D13 = """with c as (select run, node, node_class, status, 0 as candidate from v_nodes union all select run, node, node_class, status, 1 from v_nodes where node_class = 'f2p' union all select run, node, node_class, status, 2 from v_nodes where req % 2 = 0),
s as (select run, candidate, count(case when node_class = 'f2p' and status = 'passed' then 1 end) as f, count(case when node_class = 'p2p' and status = 'passed' then 1 end) as p, count(*) as n from c where candidate > 0 or run % 3 = 0 group by run, candidate),
b as (select s.run, candidate, n / total as coverage, row_number() over (partition by s.run order by n / total desc, candidate) as rn from s join v_counts t on t.run = s.run and f = f2p_passed and p = p2p_passed where n / total >= 0.5)
select t.run, b.candidate, round(b.coverage, 6) as coverage, b.candidate is not null as resolved from v_counts t left join b on b.run = t.run and rn = 1"""


@query("d13_reconcile", _D13)
def d13(v):
    of = lambda d, no: d.select("run", "node", "node_class", "status", F.lit(no).alias("candidate"), F.lit(no).alias("priority"))
    all_three = of(v.v_nodes.where("run % 3 = 0"), 0).unionByName(of(v.v_nodes.where("node_class = 'f2p'"), 1)).unionByName(of(v.v_nodes.where("req % 2 = 0"), 2))
    return r6(nodes.reconcile(all_three, v.v_counts.select("run", "f2p_passed", "p2p_passed", "total"), ["run"]), "coverage")


# --- E: requirements


@query("e01_held_requirements", "select * from v_reqs where holder <> 'public'")
def e01(v):
    return collab.held_requirements(v.v_reqs)


@query("e02_card_mentions", "select distinct run, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) as card from v_notes")
def e02(v):
    return collab.card_mentions(v.v_notes, ["run"], "text", "[A-Z][a-z]{5,}")


_E03 = """with named as (select run, req, count(*) as n, list(recipient) as asked from v_asks where req is not null group by run, req),
own as (select run, recipient, count(*) as n from v_asks group by run, recipient),
st as (select r.run, r.req, r.holder, coalesce(list_contains(d.asked, r.holder), false) as asked_owner, coalesce(d.n, 0) as n_named, coalesce(o.n, 0) as n_owner,
  case when disclosure in ('obtained', 'returned_not_visible') then disclosure when coalesce(list_contains(d.asked, r.holder), false) then 'asked_owner_about_card' when d.n > 0 then 'asked_wrong_person_about_card' when o.n > 0 then 'contacted_owner_not_card' else 'owner_never_contacted' end as state
  from v_reqs r left join named d on d.run = r.run and d.req = r.req left join own o on o.run = r.run and o.recipient = r.holder where r.holder <> 'public') """


def _states(v):
    return collab.acquisition_state(v.v_reqs, v.v_asks)


@query("e03_acquisition_state", _E03 + "select * from st")
def e03(v):
    return _states(v)


@query("e04_collab_run_metrics", _E03 + "select *, round(got / nullif(asked, 0), 6) as followthrough, round((got - visible) / nullif(got, 0), 6) as unread from (select run, count(*) as held, count(case when state in ('obtained','returned_not_visible') or asked_owner then 1 end) as asked, count(case when state in ('obtained','returned_not_visible') then 1 end) as got, count(case when state = 'obtained' then 1 end) as visible, round(count(case when state in ('obtained','returned_not_visible') or asked_owner then 1 end) / count(*), 6) as ask_rate, round(count(case when state in ('obtained','returned_not_visible') then 1 end) / count(*), 6) as obtained_rate, round(count(case when state = 'obtained' then 1 end) / nullif(count(case when state in ('obtained','returned_not_visible') then 1 end), 0), 6) as visible_rate, round(count(case when state in ('obtained','returned_not_visible') then 1 end) / nullif(sum(n_owner), 0), 6) as gain_per_q from st group by run) m")
def e04(v):
    return r6(collab.collab_run_metrics(_states(v)), "ask_rate", "obtained_rate", "visible_rate", "gain_per_q", "followthrough", "unread")


@query("e05_targeting", "select r.run, count(*) as named, count(case when f.recipient = r.holder then 1 end) as on_target, round(avg(case when f.recipient = r.holder then 1 else 0 end), 6) as targeting from v_reqs r join (select run, req, arg_min(recipient, ord) as recipient from v_asks where req is not null group by run, req) f on f.run = r.run and f.req = r.req where r.holder <> 'public' group by r.run")
def e05(v):
    return r6(collab.targeting(v.v_asks, v.v_reqs, ["ord"]), "targeting")


@query("e06_redundancy", "select run, count(*) as questions, count(case when red then 1 end) as redundant from (select q.run, q.action, bool_and(coalesce(f.t < q.start_us, false)) as red from v_actions q left join (select run, args, min(start_us) as t from v_actions where is_edit group by run, args) f using (run, args) where q.is_ask group by q.run, q.action) t group by run")
def e06(v):
    facts = v.v_actions.where("is_edit").groupBy("run", F.col("args").alias("card")).agg(F.min("start_us").alias("disclosed_at"))
    return collab.redundancy(v.v_actions.where("is_ask").select("run", F.col("action").alias("question"), F.col("start_us").alias("at"), F.col("args").alias("card")), facts)


@query("e07_cards_returned", "select q.quote_id as run, q.card, n.card is not null as seen from (select quote_id, unnest(list_distinct(regexp_extract_all(quote, '[A-Z][a-z]{3,}'))) as card from v_quotes) q left join (select distinct run, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as card from v_notes) n on n.run = q.quote_id and n.card = q.card")
def e07(v):
    cards = collab.card_mentions(v.v_quotes, ["quote_id"], "quote", "[A-Z][a-z]{3,}").withColumnRenamed("quote_id", "run")
    return collab.texts_with_card(cards, collab.card_mentions(v.v_notes, ["run"], "text", "[A-Z][a-z]{3,}"), ["run"])


_E09 = "with sg as (select run, req, holder, disclosure, case when holder = 'public' then case when req % 4 = 0 or req % 3 = 0 then 'implement' else 'discovery' end when disclosure = 'obtained' then 'implement' when disclosure = 'returned_not_visible' then 'read' when req % 4 = 0 then 'ask' else 'discovery' end as stage from v_reqs) "


def _stages(v):
    return v.v_reqs.withColumn("stage", collab.requirement_stage(F.col("holder"), F.col("req") % 4 == 0, F.col("req") % 3 == 0, F.col("disclosure")))


@query("e09_requirement_stage", _E09 + "select run, req, stage from sg")
def e09(v):
    return _stages(v).select("run", "req", "stage")


@query("e10_attribute_losses", _E09 + f", fl as (select run, req, node, {_D09.format(l=_LABEL)} as failure_class from v_nodes where status = 'failed') select fl.run, fl.node, failure_class, case when failure_class in ('infrastructure_or_blocked', 'timeout') then 'excluded_infrastructure' else coalesce(sg.stage, 'unmapped') end as stage from fl left join sg on sg.run = fl.run and sg.req = fl.req and fl.node % 11 <> 0")
def e10(v):
    links = v.v_nodes.where("node % 11 <> 0").select("run", "req", "node").join(_stages(v).select("run", "req", "stage"), ["run", "req"]).select("run", "node", "stage")
    return collab.attribute_losses(_failed(v), links)


@query("e11_requirements_table", _E03 + ", n as (select run, req, count(*) as n from v_nodes group by run, req) select r.run, r.req, case when r.holder = 'public' then 'public' else 'colleague' end as holder_class, coalesce(st.state, case when r.holder = 'public' then 'public' else 'unlinked' end) as acquisition, coalesce(st.n_named, 0) as questions, coalesce(n.n, 0) as n_nodes from v_reqs r left join st on st.run = r.run and st.req = r.req left join n on n.run = r.run and n.req = r.req")
def e11(v):
    counts = v.v_nodes.groupBy("run", "req").agg(F.count("*").alias("n_nodes"))
    return collab.requirements_table(v.v_reqs, _states(v), counts)


def _information(v):
    links = v.v_nodes.where("node_class = 'f2p'").select("run", "req", "node").join(v.v_reqs.select("run", "req", "holder"), ["run", "req"]).join(_states(v).select("run", "req", "state"), ["run", "req"], "left")
    return collab.information_state(links)


@query("e12_information_state", _E03 + "select n.run, n.node, case when r.holder = 'public' then 'public' when st.state = 'obtained' then 'colleague_obtained' else 'colleague_not_obtained' end as information_state, case when st.state in ('asked_owner_about_card', 'asked_wrong_person_about_card') then 'card_raised' else 'card_not_raised' end as ask_detail from v_nodes n join v_reqs r on r.run = n.run and r.req = n.req left join st on st.run = n.run and st.req = n.req where n.node_class = 'f2p'")
def e12(v):
    return _information(v)


# --- F, G: notes, timing, patches


@query("f04_topic_match", """with t as (select quote_id, unnest(list_distinct(regexp_extract_all(lower(quote), '[a-z]{6,}'))) as f from v_quotes),
u as (select run, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) as f from v_notes),
s as (select quote_id, count(*) as k from t group by quote_id)
select u.run as unit, t.quote_id as topic, count(*) as hits, any_value(s.k) as features, round(count(*) / any_value(s.k), 6) as score from t join u using (f) join s on s.quote_id = t.quote_id group by u.run, t.quote_id having count(*) >= 3""")
def f04(v):
    words = lambda d, k, c, n: d.select(F.lit(1).alias("all"), F.col(k).alias(n), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0)))).alias("feature"))
    out = workplace.topic_match(words(v.v_quotes, "quote_id", "quote", "topic"), words(v.v_notes, "run", "text", "unit"), ["all"], 3)
    return r6(out.select("unit", "topic", "hits", "features", "score"), "score")


# the SQL engine has no look-ahead: the word for unknown counts if it is still there once all of its harmless uses are gone
_quoted = lambda pattern: pattern.replace("'", "''")
_OPEN = f"(regexp_matches(text, '{_quoted(rules.OPEN_WORDS)}') or contains(regexp_replace(text, '(?i)未知{rules.UNKNOWN_KINDS}', '', 'g'), '未知'))"
_CLAIM = "case when {o} then 'claimed_partial_or_open' when regexp_matches(text, '{d}') then 'claimed_done' else 'not_mentioned' end"


@query("f05_classify_claim", "select run, " + _CLAIM.format(o=_OPEN, d=_quoted(rules.DONE_WORDS)) + " as claim from v_notes")
def f05(v):
    return v.v_notes.select("run", workplace.classify_claim(F.col("text"), F.lit("")).alias("claim"))


@query("f07_resolve_claims", "select req, arg_min(claim, (r, node)) as claim, arg_min(node, (r, node)) as evidence, count(*) as mentions from (select req, node, case status when 'failed' then 'claimed_partial_or_open' else case node_class when 'f2p' then 'claimed_done' else 'not_mentioned' end end as claim, case status when 'failed' then 0 else case node_class when 'f2p' then 1 else 2 end end as r from v_nodes) t group by req")
def f07(v):
    claim = F.when(F.col("status") == "failed", "claimed_partial_or_open").when(F.col("node_class") == "f2p", "claimed_done").otherwise("not_mentioned")
    return workplace.resolve_claims(v.v_nodes.select("req", "node", F.col("node").alias("evidence"), claim.alias("claim")), ["req"], ["node"])


@query("f09_delivered", "select run, req, case when bool_or(status = 'failed') then false when bool_and(status = 'passed') then true end as delivered, count(*) as n_nodes from v_nodes group by run, req")
def f09(v):
    return workplace.delivered(v.v_nodes, ["run", "req"])


@query("f10_claims_summary", "select disclosure as claim, count(case when ok then 1 end) as delivered, count(case when not ok then 1 end) as failed, count(case when ok is null then 1 end) as unknown from v_reqs left join (select run, req, bool_and(status = 'passed') as ok from v_nodes group by run, req) d using (run, req) group by disclosure")
def f10(v):
    j = v.v_reqs.join(workplace.delivered(v.v_nodes, ["run", "req"]), ["run", "req"], "left")
    d = F.col("delivered")
    return j.groupBy(F.col("disclosure").alias("claim")).agg(F.count_if(d).alias("delivered"), F.count_if(~d).alias("failed"), F.count_if(d.isNull()).alias("unknown"))


@query("g01_deferral_threads", "select t.run, t.args, t.d as deferred_at, count(case when a.start_us > t.d then 1 end) as followups, coalesce(bool_or(a.start_us > t.d), false) as followed from (select run, args, min(start_us) as d from v_actions where is_ask group by run, args) t left join v_actions a on a.run = t.run and a.args = t.args and a.is_ask group by t.run, t.args, t.d")
def g01(v):
    asks = v.v_actions.where("is_ask").select("run", "args", F.col("start_us").alias("at"))
    return workplace.deferral_threads(asks.groupBy("run", "args").agg(F.min("at").alias("deferred_at")), asks, ["run", "args"])


@query("g02_question_deciles", "select decile, count(*) as n from (select least(9, cast(floor(10 * (a.start_us - s.f) / nullif(s.l - s.f, 0)) as bigint)) as decile from v_actions a join (select run, min(start_us) as f, max(start_us) as l from v_actions group by run) s using (run) where is_ask and s.l > s.f) t group by decile")
def g02(v):
    spans = v.v_actions.groupBy("run").agg(F.min("start_us").alias("first_at"), F.max("start_us").alias("last_at"))
    out = workplace.question_deciles(v.v_actions.where("is_ask"), spans, ["run"], "start_us").where("decile is not null")
    return out.groupBy(F.col("decile").cast("bigint").alias("decile")).agg(F.count("*").alias("n"))


@query("g03_first_edit", "select s.run, s.e as edit_at, round((s.e - s.f) / nullif(s.l - s.f, 0), 6) as fraction, coalesce(q.asks, 0) as asks, coalesce(q.after, 0) as asks_after from (select run, min(start_us) as f, max(start_us) as l, min(case when is_edit then start_us end) as e from v_actions group by run) s left join (select a.run, count(*) as asks, count(case when a.start_us > e.e then 1 end) as after from v_actions a join (select run, min(case when is_edit then start_us end) as e from v_actions group by run) e using (run) where is_ask group by a.run) q using (run)")
def g03(v):
    return r6(workplace.first_edit(v.v_actions, ["run"], "start_us", "is_edit", "is_ask"), "fraction")


@query("g06_file_category", "select page_id, case when regexp_matches(url, '(?i)\\.(md|rst|txt)$') then 'doc' else 'production' end as category from pages")
def g06(v):
    return v.pages.select("page_id", workplace.file_category(F.col("url")).alias("category"))


# --- H: reviews


@query("h01_check_reviews", "select run, 'score out of range' as rule from v_ratings where score > 0 and effort < 500 union all select run, 'no effort' from v_ratings where effort < 100")
def h01(v):
    return stats.violations(v.v_ratings, ["run"], {"score out of range": "not (score > 0 and effort < 500)", "no effort": "effort >= 100"})


@query("h02_check_quotes", r"select q.quote_id as place, coalesce(contains(trim(regexp_replace(n.text, '\s+', ' ', 'g')), trim(regexp_replace(q.quote, '\s+', ' ', 'g'))), false) as found from v_quotes q left join v_notes n on n.run = q.quote_id")
def h02(v):
    return stats.check_quotes(v.v_quotes.withColumnRenamed("quote_id", "place"), v.v_notes.select(F.col("run").alias("place"), "text")).select("place", "found")


@query("h02_find_quotes", r"select q.quote_id as place, count(n.text) as texts from v_quotes q left join v_notes n on contains(trim(regexp_replace(n.text, '\s+', ' ', 'g')), trim(regexp_replace(q.quote, '\s+', ' ', 'g'))) group by q.quote_id")
def h02_find(v):
    return stats.find_quotes(v.v_quotes.withColumnRenamed("quote_id", "place"), v.v_notes.select("text")).select("place", "texts")


@query("h03_gate_reviews", "select case when effort < 500 then 'invalidated' else 'accepted' end as state, count(*) as n from v_ratings group by 1")
def h03(v):
    return stats.gate(v.v_ratings, stats.violations(v.v_ratings, ["run"], {"short": "effort >= 500"}), ["run"])


@query("h05_reviewer_usage", "select run, count(*) as responses, cast(sum(v) as bigint) as tokens from (select run, node, arg_max(ord1, (ord2, ord3)) as v from v_records group by run, node) t group by run")
def h05(v):
    last = v.v_records.groupBy("run", "node").agg(F.max_by("ord1", F.struct("ord2", "ord3")).alias("v"))
    return last.groupBy("run").agg(F.count("*").alias("responses"), F.sum("v").alias("tokens"))


@query("h06_dimension_stats", "select dimension, count(score) as n, count(case when score = 0 then 1 end) as n0, count(case when score = 1 then 1 end) as n1, count(case when score = 2 then 1 end) as n2, count(case when score = 3 then 1 end) as n3, round(avg(score), 6) as mean, round(median(score), 6) as median from v_ratings group by dimension")
def h06(v):
    return r6(stats.dimension_stats(v.v_ratings, ["dimension"], "score"), "mean", "median")


@query("h07_review_counts", "select dimension, flag, count(*) as n, count(distinct run) as runs from v_ratings group by dimension, flag")
def h07(v):
    return v.v_ratings.groupBy("dimension", "flag").agg(F.count("*").alias("n"), F.count_distinct("run").alias("runs"))


# --- J: statistics

_RATE = "with rr as (select c.*, f2p_passed / nullif(f2p_total, 0) as f2p_rate, f2p_passed = f2p_total and p2p_passed = p2p_total as strict, domain, nation, flagged from v_counts c join v_runs using (run)) "


def _runs(v):
    return nodes.run_snapshot(v.v_nodes, ["run"]).join(v.v_runs, "run").withColumn("strict", (F.col("f2p_passed") == F.col("f2p_total")) & (F.col("p2p_passed") == F.col("p2p_total")))


@query("j01_outcome_macro", _RATE + "select count(*) as n, round(avg(f2p_rate), 6) as macro, count(case when strict then 1 end) as strict from rr")
def j01(v):
    return r6(stats.outcome_macro(_runs(v)), "macro")


@query("j02_sensitivity_cohort", _RATE + "select count(*) as n, round(avg(f2p_rate), 6) as macro, count(case when strict then 1 end) as strict from rr where not flagged")
def j02(v):
    return r6(stats.outcome_macro(_runs(v).where("not flagged")), "macro")


@query("j03_rate_histogram", _RATE + "select b.bin, count(f2p_rate) as n from (select unnest(range(10)) as bin) b left join rr on cast(floor(least(f2p_rate * 100, 99.999) / 10) as bigint) = b.bin group by b.bin")
def j03(v):
    return stats.rate_histogram(_runs(v), "f2p_rate")


@query("j04_effort_quantiles", "select dimension, count(effort) as n, round(quantile_cont(effort, 0.25), 6) as p25, round(quantile_cont(effort, 0.5), 6) as median, round(quantile_cont(effort, 0.75), 6) as p75 from v_ratings group by dimension")
def j04(v):
    return r6(stats.effort_quantiles(v.v_ratings, ["dimension"], "effort"), "p25", "median", "p75")


@query("j05_spearman", """with r as (select dimension, score, effort, rank() over (partition by dimension order by score) + (count(*) over (partition by dimension, score) - 1) / 2 as x, rank() over (partition by dimension order by effort) + (count(*) over (partition by dimension, effort) - 1) / 2 as y from v_ratings)
select dimension, count(*) as n, case when count(*) >= 3 and min(score) <> max(score) and min(effort) <> max(effort) then round(corr(x, y), 6) + 0.0 end as rho from r group by dimension""")
def j05(v):
    return r6(relational.spearman(v.v_ratings, "score", "effort", ["dimension"]), "rho")


@query("j06_acquisition_shares", _E03 + "select state, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from st group by state")
def j06(v):
    return r6(stats.acquisition_shares(_states(v), ["state"]), "share")


@query("j07_pass_by_state", _E03 + "select case when r.holder = 'public' then 'public' when st.state = 'obtained' then 'colleague_obtained' else 'colleague_not_obtained' end as information_state, count(*) as n, round(avg(case when n.status = 'passed' then 1 else 0 end), 6) as rate from v_nodes n join v_reqs r on r.run = n.run and r.req = n.req left join st on st.run = n.run and st.req = n.req where n.node_class = 'f2p' group by 1")
def j07(v):
    v.keep("v_nodes")
    return r6(stats.pass_by_state(v.v_nodes.join(_information(v), ["run", "node"]), "information_state"), "rate")


#: Of rows g(grp, gap): n, w_plus and the p value, the distribution counted out up to 50 different sizes, else by Simpson's rule.
_SIGNED_RANK = """rk as (select grp, gap, count(*) over w as k, rank() over (partition by grp order by abs(round(gap, 9))) + (count(*) over w - 1) / 2 as rank from g where gap <> 0 window w as (partition by grp, abs(round(gap, 9)))),
sr as (select grp, count(*) as n, sum(case when gap > 0 then rank else 0 end) as w_plus, sum(k * k - 1) as ties from rk group by grp),
ways(n, s, c) as (select 0, 0, 1::double union all (with dp as (select * from ways where n < 50) select n + 1, s, sum(c) from (select n, s, c from dp union all select n, s + n + 1, c from dp) t group by n, s)),
z as (select *, least(w_plus, n * (n + 1) / 2 - w_plus) as w, (n * (n + 1) / 4 - least(w_plus, n * (n + 1) / 2 - w_plus)) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) / sqrt(2) as x from sr),
tails as (select grp, 2 / sqrt(pi()) * sum(exp(-power(x + i * 0.001, 2)) * case when i in (0, 10000) then 1 when i % 2 = 1 then 4 else 2 end) * 0.001 / 3 as tail from z, range(10001) r(i) group by grp),
told as (select grp, n, w_plus, case when n < 2 then null when n <= 50 and ties = 0 then least(1, 2 * (select sum(c) from ways where ways.n = z.n and ways.s <= z.w) / power(2, n)) else tail end as p from z join tails using (grp))"""
_J08 = """with recursive gr as (select n.run, avg(case when r.disclosure = 'obtained' then case when status = 'passed' then 1 else 0 end end) - avg(case when r.disclosure <> 'obtained' then case when status = 'passed' then 1 else 0 end end) as gap from v_nodes n join v_reqs r on r.run = n.run and r.req = n.req group by n.run),
ok as (select * from gr where gap is not null), g as (select 0 as grp, gap from ok),
""" + _SIGNED_RANK + """
select (select count(*) from ok) as n, (select round(avg(gap), 6) from ok) as mean, (select round(median(gap), 6) from ok) as median, (select count(*) from ok where gap > 0) as positive, (select count(*) from ok where gap < 0) as negative, (select round(w_plus, 6) from told) as w_plus, (select round(p, 6) from told) as p"""


@query("j08_paired_gap", _J08)
def j08(v):
    j = v.v_nodes.join(v.v_reqs.select("run", "req", (F.col("disclosure") == "obtained").alias("got")), ["run", "req"])
    return r6(stats.paired_gap(j, ["run"], "got"), "mean", "median", "w_plus", "p")


_J08_GROUPS = """with recursive m as (select run, avg(case when node_class = 'f2p' then ord3 end) - avg(case when node_class = 'p2p' then ord3 end) as price, avg(case when node_class = 'f2p' then ord2 end) - avg(case when node_class = 'p2p' then ord2 end) as place from v_records group by run),
g as (select 'nation ' || nation as grp, price as gap from m join v_runs using (run) where price is not null union all select domain, price from m join v_runs using (run) where price is not null union all select 'tied ' || domain, round(place / 10) from m join v_runs using (run) where place is not null),
""" + _SIGNED_RANK + """
select grp, n, round(w_plus, 6) as w_plus, round(p, 6) as p from told"""


@query("j08_signed_rank", _J08_GROUPS)
def j08_groups(v):
    gap = lambda c: F.avg(F.when(F.col("node_class") == "f2p", F.col(c))) - F.avg(F.when(F.col("node_class") == "p2p", F.col(c)))
    m = v.v_records.groupBy("run").agg(gap("ord3").alias("price"), gap("ord2").alias("place")).join(v.v_runs, "run")
    price = m.where("price is not null")
    tied = m.where("place is not null").select(F.concat(F.lit("tied "), "domain").alias("grp"), F.round(F.col("place") / 10).alias("gap"))
    g = price.select(F.concat(F.lit("nation "), "nation").alias("grp"), F.col("price").alias("gap")).unionByName(price.select(F.col("domain").alias("grp"), F.col("price").alias("gap"))).unionByName(tied)
    return r6(relational.signed_rank(g, ["grp"], "gap"), "w_plus", "p")


@query("j10_loss_shares", _E09 + ", l as (select n.node, sg.stage from v_nodes n join sg on sg.run = n.run and sg.req = n.req where n.status = 'failed') select stage, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from l group by stage")
def j10(v):
    failed = v.v_nodes.where("status = 'failed'").join(_stages(v).select("run", "req", "stage"), ["run", "req"])
    return r6(relational.share_of_total(failed, ["stage"], []), "share")


_STRATA = {"domain": "domain", "nation": "nation", "nodes": "case when f2p_total + p2p_total < 28 then '<28' when f2p_total + p2p_total <= 35 then '28-35' else '>35' end"}


@query("j20_strata", _RATE + " select axis, stratum, count(*) as n, round(avg(f2p_rate), 6) as macro, count(case when strict then 1 end) as strict from (" + " union all ".join(f"select '{a}' as axis, cast({e} as varchar) as stratum, f2p_rate, strict from rr" for a, e in _STRATA.items()) + ") t group by axis, stratum")
def j20(v):
    return r6(stats.strata(_runs(v), _STRATA, "f2p_rate"), "macro")


@query("j22_five_number", "select metric, count(value) as n, round(sum(value), 6) as total, round(min(value), 6) as least, round(max(value), 6) as most, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as p75 from (select 'effort' as metric, cast(effort as double) as value from v_ratings union all select 'score', cast(score as double) from v_ratings) t where value is not null group by metric")
def j22(v):
    d = v.v_ratings.select(F.col("effort").cast("double").alias("effort"), F.col("score").cast("double").alias("score"))
    return r6(relational.five_number(d, ["effort", "score"]), "total", "least", "most", "p25", "median", "p75")


@query("j23_tool_totals", "select tool, count(*) as calls, count(case when is_error then 1 end) as errors, count(distinct run) as runs from v_actions group by tool")
def j23(v):
    return v.v_actions.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.count_distinct("run").alias("runs"))


@query("j24_failure_class_counts", f"select failure_class, count(case when node_class = 'f2p' then 1 end) as f2p, count(case when node_class = 'p2p' then 1 end) as p2p from (select node_class, {_D09.format(l=_LABEL)} as failure_class from v_nodes where status = 'failed') t group by failure_class")
def j24(v):
    return stats.failure_class_counts(_failed(v))


@query("j26_case_selection", _RATE + "select domain, run, f2p_total - f2p_passed as failed from (select *, row_number() over (partition by domain order by f2p_total - f2p_passed desc, run) as rn from rr) t where rn = 1")
def j26(v):
    t = _runs(v).withColumn("failed", F.col("f2p_total") - F.col("f2p_passed"))
    return stats.pick_first(t, ["domain"], F.desc("failed"), F.col("run")).select("domain", "run", "failed")


# --- K, L: wide tables, models


@query("k01_timeline", "select run, turn, case when length(text) <= 60 then text else substr(text, 1, 40) || ' ... ' || right(text, 20) end as shown from v_turns")
def k01(v):
    return stats.timeline(v.v_turns.withColumn("at", F.col("turn") * 1_000_000), ["run"], "at", 60).select("run", "turn", "shown")


@query("k01_timeline_whole", "select run, turn, role, format('{:d}:{:02d}:{:02d}', s // 3600, s % 3600 // 60, s % 60) as \"offset\", text as shown from (select *, cast(turn - min(turn) over (partition by run) as bigint) as s from v_turns) t")
def k01_whole(v):
    return stats.timeline(v.v_turns.withColumn("at", F.col("turn") * 1_000_000), ["run"], "at").select("run", "turn", "role", "offset", "shown")


@query("k04_requirement_rows", "select r.run, r.req, r.holder, count(n.node) as n_nodes, count(case when n.status = 'passed' then 1 end) as passed from v_reqs r left join v_nodes n on n.run = r.run and n.req = r.req group by r.run, r.req, r.holder")
def k04(v):
    n = v.v_nodes.groupBy("run", "req").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("status") == "passed").alias("passed"))
    return stats.run_summary(v.v_reqs.select("run", "req", "holder"), [n], ["run", "req"], ["n_nodes", "passed"])


@query("k06_run_summary", "select r.run, r.domain, coalesce(c.total, 0) as total, coalesce(c.f2p_passed, 0) as f2p_passed, coalesce(a.calls, 0) as calls, coalesce(q.reqs, 0) as reqs from v_runs r left join v_counts c using (run) left join (select run, count(*) as calls from v_actions group by run) a using (run) left join (select run, count(*) as reqs from v_reqs group by run) q using (run)")
def k06(v):
    count = lambda d, n: d.groupBy("run").agg(F.count("*").alias(n))
    tables = [v.v_counts.select("run", "total", "f2p_passed"), count(v.v_actions, "calls"), count(v.v_reqs, "reqs")]
    return stats.run_summary(v.v_runs.select("run", "domain"), tables, ["run"], ["total", "f2p_passed", "calls", "reqs"])


@query("k09_trace_window", "select run, substr(text, 101, 200) as part, length(text) > 300 as more from v_notes where run between 10 and 400")
def k09(v):
    return stats.trace_window(v.v_notes, "run between 10 and 400", 100, 200).select("run", "part", "more")


@query("k09_trace_window_turns", "select run, turn, substr(text, 101, 200) as part, length(text) > 300 as more from v_turns where turn between 1 and 4")
def k09_turns(v):
    return stats.trace_window(v.v_turns, "turn between 1 and 4", 100, 200).select("run", "turn", "part", "more")


_L = "with m as (select model, 'chars' as metric, avg(length(text)) as value from v_notes group by model union all select model, 'notes', cast(count(*) as double) from v_notes group by model) "


@query("l01_model_summary", _L + "select model, metric, round(value, 6) as value from m")
def l01(v):
    return r6(_models(v), "value")


def _models(v):
    t = v.v_notes.groupBy("model").agg(F.avg(F.length("text")).alias("chars"), F.count("*").cast("double").alias("notes"))
    return t.unpivot(["model"], ["chars", "notes"], "metric", "value")


@query("l02_model_compare", _L + "select metric, count(value) as models, round(avg(value), 6) as mean, round(min(value), 6) as least, round(max(value), 6) as most from m group by metric")
def l02(v):
    return r6(stats.model_compare(_models(v)), "mean", "least", "most")


@query("l03_stacked_shares", "select model, lang, count(*) as n, round(count(*) / sum(count(*)) over (partition by model), 6) as share from v_notes group by model, lang")
def l03(v):
    return r6(relational.share_of_total(v.v_notes, ["lang"], ["model"]), "share")


@query("l04_regression_check", "select count(*) as shared, count(case when run % 10 <> 3 then 1 end) as agree from v_counts")
def l04(v):
    got = v.v_counts.select(F.col("run").cast("string").alias("name"), F.format_number("total", 0).alias("value"), "run", "total")
    expected = got.select("name", (F.col("total") + F.when(F.col("run") % 10 == 3, 1).otherwise(0)).cast("string").alias("value"))
    return stats.regression_check(got.select("name", "value"), expected)


# --- further operators of several groups


@query("c02_asks", "select a.run, a.turn, count(b.turn) as returns, case when count(b.turn) = 0 then 'missing' when bool_or(length(b.text) % 5 = 0) then 'explicit_is_error' else 'no_is_error_flag' end as return_status from v_turns a left join v_turns b on b.run = a.run and b.turn = a.turn + 1 and b.role = 'assistant' where a.role = 'user' group by a.run, a.turn")
def c02(v):
    back = v.v_turns.where("role = 'assistant'").select("run", (F.col("turn") - 1).alias("turn"), (F.length("text") % 5 == 0).alias("is_error"))
    return comms.asks(v.v_turns.where("role = 'user'").select("run", "turn"), back, ["run", "turn"], "is_error")


@query("c11_comm_coverage", "select run, count(case when role = 'user' then 1 end) as asks, case when run % 7 <> 0 then count(case when role = 'assistant' then 1 end) end as replies, case when run % 7 <> 0 then count(case when role = 'system' then 1 end) end as notices from v_turns group by run")
def c11(v):
    n = lambda role, name: F.count_if(F.col("role") == role).alias(name)
    t = v.v_turns.groupBy("run").agg(n("user", "asks"), n("assistant", "replies"), n("system", "notices")).withColumn("has", F.col("run") % 7 != 0)
    return comms.null_without(t, "has", ["replies", "notices"]).drop("has")


@query("d05_node_aliases", "select alias, arg_min(node, priority) as node, min(priority) as priority from (select priority, alias, min(node) as node from (select 0 as priority, ord1 as alias, node from v_records where node % 17 = 0 union all select 1, ord2, node from v_records where node % 101 = 0) t group by priority, alias having count(distinct node) = 1) u group by alias")
def d05(v):
    of = lambda no, c, where: v.v_records.where(where).select(F.lit(no).alias("priority"), F.col(c).alias("alias"), "node")
    return nodes.node_aliases(of(0, "ord1", "node % 17 = 0").unionByName(of(1, "ord2", "node % 101 = 0")), "priority", "alias", "node")


@query("d05_node_aliases_all", "select alias, arg_min(node, priority) as node, min(priority) as priority from (select priority, alias, min(node) as node from (select 0 as priority, cast(round(ord3 * 100) as bigint) as alias, node from v_records union all select 1, ord1, node from v_records union all select 2, ord2, node from v_records union all select 3, node, node from v_records) t group by priority, alias having count(distinct node) = 1) u group by alias")
def d05_all(v):
    keys = [F.round(F.col("ord3") * 100), F.col("ord1"), F.col("ord2"), F.col("node")]
    each = F.inline(F.array(*[F.struct(F.lit(no).alias("priority"), c.cast("bigint").alias("alias")) for no, c in enumerate(keys)]))
    return nodes.node_aliases(v.v_records.select("node", each), "priority", "alias", "node")


_D14 = """with b as (select run, count(case when node_class = 'f2p' and status = 'passed' then 1 end) as f, count(case when node_class = 'p2p' and status = 'passed' then 1 end) as p from v_nodes where req % 5 <> 0 group by run),
rep as (select c.run, case when b.run is null then 'none' else 'rebuilt' end as method, case when b.run is null then 'no evidence' else concat_ws(';', case when c.f2p_passed <> f then 'f2p_passed' end, case when c.p2p_passed <> p then 'p2p_passed' end) end as notes from v_counts c left join b on b.run = c.run) """


def _report(v):
    return nodes.reconcile_report(v.v_counts, nodes.run_snapshot(v.v_nodes.where("req % 5 <> 0"), ["run"]), ["run"], ["f2p_passed", "p2p_passed"])


@query("d14_reconcile_report", _D14 + "select run, method, notes = '' as matches, notes from rep")
def d14(v):
    return _report(v)


@query("j21_coverage_stats", _D14 + "select method, notes = '' as matches, count(*) as n from rep group by 1, 2")
def j21(v):
    return _report(v).groupBy("method", "matches").agg(F.count("*").alias("n"))


@query("e08_docs_fetched", "select distinct run, card from (select run, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) as card from v_notes) n where card in (select unnest(regexp_extract_all(quote, '[A-Z][a-z]{3,}')) from v_quotes)")
def e08(v):
    public = collab.card_mentions(v.v_quotes, ["quote_id"], "quote", "[A-Z][a-z]{3,}")
    return collab.docs_fetched(collab.card_mentions(v.v_notes, ["run"], "text", "[A-Z][a-z]{3,}"), public)


@query("f11_note_source", "select r.run, min(f.priority) as priority, case when min(f.priority) is null then 'missing' when trim(arg_min(f.text, f.priority)) = '' then 'empty' else 'present' end as state from v_notes r left join (select run, 0 as priority, case when run % 5 = 0 then ' ' else text end as text from v_notes where run % 3 <> 0 union all select run, 1, text from v_notes where run % 2 = 0) f on f.run = r.run and f.text is not null group by r.run")
def f11(v):
    own = v.v_notes.where("run % 3 <> 0").select("run", F.lit(0).alias("priority"), F.when(F.col("run") % 5 == 0, " ").otherwise(F.col("text")).alias("text"))
    return workplace.note_source(v.v_notes, own.unionByName(v.v_notes.where("run % 2 = 0").select("run", F.lit(1).alias("priority"), "text")), ["run"])


_BRIEF = {"asks_note": "(?i)write|note", "keeps_tests": "(?i)test|check", "migration": "(?i)migrat|move"}


@query("g04_brief_rules", "select run, " + ", ".join(f"coalesce(bool_or(regexp_matches(text, '{p}')), false) as {n}" for n, p in _BRIEF.items()) + " from v_turns group by run")
def g04(v):
    return workplace.brief_rules(v.v_turns, ["run"], "text", _BRIEF)


_G08 = """with fs as (select run, case when node_class = 'f2p' then 'test' else 'production' end as category, case when node % 13 = 0 then 'deleted' when node % 3 = 0 then 'added' else 'modified' end as status, node % 5 as removed from v_nodes),
hit as (select run, count(*) as files, cast(sum(removed) as bigint) as lines_removed, count(case when status = 'deleted' then 1 end) as deleted from fs where category = 'test' and (status = 'deleted' or (status = 'modified' and removed > 0)) group by run),
cp as (select r.run, r.run % 2 = 0 and not r.flagged as under_rule, r.run % 90 >= 50 as has_note, coalesce(files, 0) as files, coalesce(lines_removed, 0) as lines_removed, coalesce(deleted, 0) as deleted from v_runs r left join hit on hit.run = r.run) """


def _compliance(v):
    files = v.v_nodes.select("run", F.when(F.col("node_class") == "f2p", "test").otherwise("production").alias("category"), F.expr("case when node % 13 = 0 then 'deleted' when node % 3 = 0 then 'added' else 'modified' end").alias("status"), (F.col("node") % 5).alias("removed"))
    runs = v.v_runs.select("run", (F.col("run") % 2 == 0).alias("has_rule"), F.col("flagged").alias("migration"), (F.col("run") % 90).alias("note_bytes"))
    return workplace.test_rule_compliance(runs, files, ["run"])


@query("g08_test_rule_compliance", _G08 + "select * from cp")
def g08(v):
    return _compliance(v)


@query("j19_rule_stats", _G08 + "select count(case when under_rule then 1 end) as rule_runs, count(case when under_rule and files > 0 then 1 end) as violating, round(median(case when under_rule and files > 0 then lines_removed end), 6) as median_removed, cast(sum(case when under_rule and files > 0 then deleted end) as bigint) as deleted, count(case when has_note then 1 end) as notes from cp")
def j19(v):
    return r6(workplace.rule_stats(_compliance(v)), "median_removed")


@query("h12_stage_matrix", _E09 + "select stage, disclosure, count(*) as n, stage = disclosure as agrees from sg group by stage, disclosure")
def h12(v):
    return stats.stage_matrix(_stages(v), "stage", "disclosure")


@query("j09_pass_high_conf", _E03 + "select case when r.holder = 'public' then 'public' when st.state = 'obtained' then 'colleague_obtained' else 'colleague_not_obtained' end as information_state, count(*) as n, round(avg(case when n.status = 'passed' then 1 else 0 end), 6) as rate from v_nodes n join v_reqs r on r.run = n.run and r.req = n.req left join st on st.run = n.run and st.req = n.req where n.node_class = 'f2p' and n.node % 4 <> 0 group by 1")
def j09(v):
    return r6(stats.pass_by_state(v.v_nodes.where("node % 4 <> 0").join(_information(v), ["run", "node"]), "information_state"), "rate")


@query("j11_collab_summary", """with l as (select 'effort' as metric, cast(effort as double) as value, flag from v_ratings union all select 'score', cast(score as double), flag from v_ratings),
r as (select *, rank() over (partition by metric order by value) + (count(*) over (partition by metric, value) - 1) / 2 as x, rank() over (partition by metric order by flag) + (count(*) over (partition by metric, flag) - 1) / 2 as y from l where value is not null)
select metric, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, case when count(*) >= 3 and min(value) <> max(value) and min(flag) <> max(flag) then round(corr(x, y), 6) + 0.0 end as rho from r group by metric""")
def j11(v):
    d = v.v_ratings.select(F.col("effort").cast("double").alias("effort"), F.col("score").cast("double").alias("score"), "flag")
    return r6(stats.collab_summary(d, ["effort", "score"], "flag"), "mean", "median", "rho")


@query("j16_blind_check", "select dimension, flag as verdict, count(*) as n from v_ratings group by dimension, flag")
def j16(v):
    return v.v_ratings.groupBy("dimension", F.col("flag").alias("verdict")).agg(F.count("*").alias("n"))


@query("j17_deferral_stats", "select count(case when n > 0 then 1 end) as followed, count(case when n = 0 then 1 end) as abandoned, round(median(n), 6) as median_followups from (select t.run, t.args, count(case when a.start_us > t.d then 1 end) as n from (select run, args, min(start_us) as d from v_actions where is_ask group by run, args) t left join v_actions a on a.run = t.run and a.args = t.args and a.is_ask group by t.run, t.args) u")
def j17(v):
    return r6(workplace.deferral_stats(g01(v)), "median_followups")


@query("j18_timing_stats", "select count(*) as n, round(avg(case when decile < 2 then 1 else 0 end), 6) as first_fifth, round(avg(case when decile >= 8 then 1 else 0 end), 6) as last_fifth from (select least(9, cast(floor(10 * (a.start_us - s.f) / nullif(s.l - s.f, 0)) as bigint)) as decile from v_actions a join (select run, min(start_us) as f, max(start_us) as l from v_actions group by run) s using (run) where is_ask and s.l > s.f) t")
def j18(v):
    spans = v.v_actions.groupBy("run").agg(F.min("start_us").alias("first_at"), F.max("start_us").alias("last_at"))
    return r6(workplace.timing_stats(workplace.question_deciles(v.v_actions.where("is_ask"), spans, ["run"], "start_us")), "first_fifth", "last_fifth")


@query("k02_conversation", "select run, turn as item, kind, row_number() over (partition by run order by turn, kind) as place from (select run, turn, case when role = 'user' then 'send' else 'shown' end as kind from v_turns) t")
def k02(v):
    of = lambda where: v.v_turns.where(where).select("run", F.col("turn").alias("item"), F.col("turn").alias("at"))
    return longs(comms.conversation(of("role = 'user'"), of("role <> 'user'"), ["run"], "at").drop("at"), "place")


@query("k05_node_rows", _E09 + f", fl as (select run, req, node, {_D09.format(l=_LABEL)} as failure_class from v_nodes where status = 'failed'), ls as (select fl.run, fl.node, case when failure_class in ('infrastructure_or_blocked', 'timeout') then 'excluded_infrastructure' else coalesce(sg.stage, 'unmapped') end as stage from fl left join sg on sg.run = fl.run and sg.req = fl.req and fl.node % 11 <> 0) select n.run, n.req, n.node, n.node_class, n.status, case when n.node_class = 'f2p' then case when r.holder = 'public' then 'public' when r.disclosure = 'obtained' then 'colleague_obtained' else 'colleague_not_obtained' end end as information_state, ls.stage from v_nodes n join v_reqs r on r.run = n.run and r.req = n.req left join ls on ls.run = n.run and ls.node = n.node")
def k05(v):
    v.keep("v_nodes")
    return collab.node_rows(v.v_nodes, _information(v).select("run", "node", "information_state"), e10(v))


@query("c14_committed_unseen", "select run, action, args, (select count(*) from v_actions l where l.run = a.run and l.args = a.args and l.tool <> 'purchase') as lines from v_actions a where is_ask and not exists (select 1 from v_actions b where b.is_edit and b.run = a.run and b.args = a.args)")
def c14(v):
    asks = v.v_actions.where("is_ask").select("run", "action", "args")
    return comms.committed_unseen(asks, v.v_actions.where("is_edit"), v.v_actions.where("tool <> 'purchase'"), ["run", "args"])


# --- result flags, usage reports, evidence labels, review and diagnosis tables


@query("b02_error_flags", "select action, concat_ws(',', case when is_error then 'is_error' end, case when tool = 'signup' and action % 2 = 1 then 'structured_error' end, case when tool = 'error' then 'structured_failed_status' end, case when action % 7 = 0 then 'structured_false_success' end, case when action % 5 = 0 then 'structured_is_error' end, case when tool = 'click' and action % 3 <> 0 then 'terminal_nonzero_exit' end, case when action % 11 = 0 then 'transport_exception_prefix' end) as flags from v_actions")
def b02(v):
    payload = """array(concat('{"success": ', action % 7 <> 0, ', "exit_code": ', action % 3, ', "status": "', tool, '"}'), concat('{"isError": ', action % 5 = 0, ', "error": ', if(tool = 'signup' and action % 2 = 1, '{"code": 1}', '{}'), '}'))"""
    results = v.v_actions.withColumn("payloads", F.expr(payload)).withColumn("text", F.expr("if(action % 11 = 0, '  RuntimeError: gone', args)"))
    return reviews.error_flags(results, "payloads", "text", "is_error", F.col("tool") == "click").select("action", F.array_join("flags", ",").alias("flags"))


@query("b15_result_usage", "select req, count(*) as models, req % 5 <> 0 as matches from v_records group by req")
def b15(v):
    reports = v.v_records.groupBy("req").agg(F.sum("ord1").alias("ord1"), (F.sum("ord2") + F.when(F.col("req") % 5 == 0, 1).otherwise(0)).alias("ord2"), F.collect_list(F.struct("ord1", "ord2")).alias("models"))
    twice = reports.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))
    return reviews.result_usage(twice, ["req"], ["line"], ["ord1", "ord2"], "models").select("req", F.size("models").cast("bigint").alias("models"), "matches")


@query("b17_phase_usage", "select run, 'calls' as usage_key, count(case when not is_error then 1 end) as reporting, cast(sum(case when not is_error then 1 end) as bigint) as total from v_actions group by run union all select run, 'us', count(case when tool = 'view' then 1 end), cast(sum(case when tool = 'view' then end_us - start_us end) as bigint) from v_actions group by run")
def b17(v):
    usage = F.create_map(F.lit("calls"), F.when(~F.col("is_error"), F.lit(1).cast("bigint")), F.lit("us"), F.when(F.col("tool") == "view", F.col("end_us") - F.col("start_us")))
    return reviews.phase_usage(v.v_actions.unionByName(v.v_actions).withColumn("usage", usage), ["run"], ["action"], "usage")


@query("c15_compact_index", "select run, turn, role as body_role, text as body_text, row_number() over (partition by run order by turn) as line from v_turns")
def c15(v):
    rows = v.v_turns.select("run", "turn", F.struct("role", "text").alias("body"))
    return longs(reviews.compact_index(rows, ["run"], ["turn"], "body"), "line")


@query("d03_failure_label", "select node, case when node % 4 = 0 then 'nested-kind' when node % 4 = 1 then 'class_of_' || status when node % 4 = 2 then 'reason-text' else '' end as label, case when node % 2 = 0 then 'said ' || status else '' end as message from v_nodes")
def d03(v):
    record = """concat('{"status": "', status, '", "category": "', if(node % 4 = 1, concat('class_of_', status), node_class), '", "error_kind": "', if(node % 4 = 2, 'reason-text', 'two words'), '", "detail": ', if(node % 2 = 0, concat('"said ', status, '"'), '7'), ', "extra": {"class": "', if(node % 4 = 0, 'nested-kind', 'error'), '"}}')"""
    n = v.v_nodes.withColumn("record", F.expr(record))
    return n.select("node", reviews.failure_label(F.col("record"), F.col("status")).alias("label"), reviews.failure_message(F.col("record")).alias("message"))


@query("d10_evidence_source", "select r.run, case when flagged and count(case when req % 10 = 1 then 1 end) > 0 then 'recovery' when count(case when req % 10 = 0 then 1 end) > 0 then 'original' else 'raw' end as source from v_runs r left join v_reqs q on q.run = r.run group by r.run, flagged")
def d10(v):
    runs = v.v_runs.select("run", F.col("flagged").alias("accepted"), F.lit("1").alias("recovery"), F.lit("0").alias("original"))
    return reviews.evidence_source(runs, v.v_reqs.select("run", (F.col("req") % 10).cast("string").alias("dir")), ["run"])


@query("f06_last_goal_summary", "select run, i - 1 as place, s[i] as sentence from (select run, s, unnest(range(1, len(s) + 1)) as i from (select run, regexp_split_to_array(arg_max(text, turn), '[.!?\n]+[ \t\n\r\f]*') as s from v_turns where role = 'assistant' group by run) a) b where trim(s[i]) <> ''")
def f06(v):
    return longs(reviews.last_goal_summary(v.v_turns, ["run"], ["turn"], F.col("role") == "assistant", "text"), "place")


@query("h04_review_tables", "select req, node as episode, node_class as kind, case when node_class = 'f2p' then status end as lens, concat_ws(',', cast(ord1 as varchar), cast(ord2 as varchar)) as evidence, 2 as n_evidence from v_records")
def h04(v):
    episode = F.struct(F.col("node").alias("episode"), F.col("node_class").alias("kind"), F.col("status").alias("lens"), F.array(F.col("ord1").cast("string"), F.col("ord2").cast("string")).alias("evidence"))
    reports = v.v_records.groupBy("req").agg(F.collect_list(episode).alias("episodes"))
    return reviews.review_tables(reports, ["req"], "episodes", ("f2p",))


_H08 = "with st as (select r.run, domain as ending, case r.run % 3 when 0 then 'supported' when 1 then 'uncertain' else 'not_supported' end as premature, count(n.node) as unresolved from v_runs r left join v_nodes n on n.run = r.run and n.status = 'failed' group by all) "


def _stops(v):
    left = v.v_nodes.where("status = 'failed'").groupBy("run").agg(F.collect_list("node").alias("items"))
    label = F.expr("case run % 3 when 0 then 'supported' when 1 then 'uncertain' else 'not_supported' end").alias("premature")
    return longs(reviews.stopping_table(v.v_runs.join(left, "run", "left").select("run", F.col("domain").alias("ending"), label, "items"), ["run"]), "unresolved")


@query("h08_stopping_table", _H08 + "select * from st")
def h08(v):
    return _stops(v)


@query("j14_stopping_stats", _H08 + ", l as (select run, count(*) as lost, count(case when req % 3 = 0 then 1 end) as at_ask from v_nodes where status = 'failed' group by run), q as (select run, f2p_passed / nullif(f2p_total, 0) as rate, (total % 9) / 2 as hours_left from v_counts) select ending, premature, count(*) as n, round(median(hours_left), 6) as hours_left, cast(sum(unresolved) as bigint) as unresolved, round(median(unresolved), 6) as median_unresolved, round(avg(rate), 6) as rate, round(sum(at_ask) / sum(lost), 6) as ask_share from st left join q using (run) left join l using (run) group by ending, premature")
def j14(v):
    runs = v.v_counts.select("run", F.try_divide("f2p_passed", "f2p_total").alias("rate"), ((F.col("total") % 9) / 2).alias("hours_left"))
    losses = v.v_nodes.where("status = 'failed'").select("run", F.when(F.col("req") % 3 == 0, "ask").otherwise("use").alias("stage"))
    return r6(reviews.stopping_stats(_stops(v), runs, losses, ["run"]), "hours_left", "median_unresolved", "rate", "ask_share")


@query("h09_diagnosis_context", "select run, count(*) as requirements, cast(to_json(list({'req': req, 'holder': holder, 'nodes': ns} order by req)) as varchar) as document from (select r.run, r.req, any_value(holder) as holder, coalesce(list({'node': node, 'status': status} order by node) filter (node is not null), []) as ns from v_reqs r left join v_nodes n on n.run = r.run and n.req = r.req group by r.run, r.req) t group by run")
def h09(v):
    return reviews.diagnosis_context(v.v_reqs.select("run", "req", "holder"), v.v_nodes, ["run"], "req")


@query("h11_diagnosis_tables", "select run, req, string_agg('[' || node_class || '] ' || status, ' → ' order by node) as chain from v_nodes group by run, req")
def h11(v):
    step = F.array_sort(F.collect_list(F.struct("node", F.col("node_class").alias("phase"), F.col("status").alias("description"))))
    reports = v.v_nodes.groupBy("run", "req").agg(step.alias("steps")).groupBy("run").agg(F.collect_list(F.struct("req", "steps")).alias("diagnoses"))
    return reviews.diagnosis_tables(reports, ["run"], "diagnoses")


@query("j13_dimension_ranking", """with d as (select dimension, count(case when score = 0 then 1 end) as n0, count(case when score = 1 then 1 end) as n1, count(case when flag = 0 then 1 end) as n2, count(case when flag = 1 then 1 end) as n3, round(avg(effort), 6) as rho from v_ratings group by dimension),
m as (select *, (n1 + 2 * n2 + 3 * n3) / (n0 + n1 + n2 + n3) as mean, case greatest(n0, n1, n2, n3) when n0 then 0 when n1 then 1 when n2 then 2 else 3 end as modal from d)
select 'significant' as list, row_number() over (order by rho desc, dimension) as place, dimension, rho as value, null as modal from d where n0 > 0
union all select * from (select 'most_3', row_number() over (order by n3 desc, dimension) as p, dimension, n3, null from d) t where p <= 3
union all select * from (select 'lowest_mean', row_number() over (order by mean, dimension) as p, dimension, round(mean, 6), modal from m) t where p = 1""")
def j13(v):
    count = lambda c: F.count_if(F.expr(c))
    dims = v.v_ratings.groupBy("dimension").agg(count("score = 0").alias("n0"), count("score = 1").alias("n1"), count("flag = 0").alias("n2"), count("flag = 1").alias("n3"), F.round(F.avg("effort"), 6).alias("rho"))
    return r6(longs(reviews.dimension_ranking(dims.withColumn("significant", F.col("n0") > 0)), "place"), "value")


@query("j25_review_detail", "select 'episode' as of, tool as name, '' as severity, count(*) as n, count(distinct run) as runs from v_actions group by tool union all select 'phase', name, '', count(*), count(distinct run) from (select run, unnest([node_class, status]) as name from v_nodes) t group by name union all select 'issue', holder, disclosure, count(*), count(distinct run) from v_reqs group by holder, disclosure")
def j25(v):
    phases = v.v_nodes.select("run", F.concat_ws(",", "node_class", F.lit(""), "status").alias("tags"))
    issues = v.v_reqs.select("run", F.col("holder").alias("category"), F.col("disclosure").alias("severity"))
    return reviews.review_detail(v.v_actions.select("run", F.col("tool").alias("kind")), phases, issues, ["run"])


@query("k07_run_index", "select run, total, f2p_passed || '/' || f2p_total as f2p from v_counts")
def k07(v):
    return reviews.run_index(v.v_counts, ["run"], ["total"])


@query("k08_sidecar_log", "select run, row_number() over (partition by run order by start_us, action) as place, '{\"action\":' || action || case when is_error then '' else ',\"tool\":\"' || tool || '\"' end || '}' as event from v_actions")
def k08(v):
    events = v.v_actions.withColumn("tool", F.when(~F.col("is_error"), F.col("tool")))
    return longs(reviews.sidecar_log(events, ["run"], ["start_us", "action"], ["action", "tool"]), "place")


_F08 = "case when regexp_matches(h, '{o}') and not (regexp_matches(text, '{a}') and not {w}) or {w} then 'claimed_partial_or_open' when regexp_matches(text, '{d}') or regexp_matches(h, '{i}') then 'claimed_done' else 'not_mentioned' end"
_HEADS = "case run % 4 when 0 then 'Implementation' when 1 then 'Open items' when 2 then 'What changed' else 'Summary' end"
_f08 = lambda i: _F08.format(o=rules.OPEN_HEAD, a=rules.ANSWERED, w=_OPEN, d=rules.DONE_WORDS, i=i)


@query("f08_claims_strict_broad", f"select run, mode, case mode when 'strict' then {_f08(rules.IMPLEMENT_HEAD)} else {_f08(rules.IMPLEMENT_HEAD_BROAD)} end as claim from (select run, text, {_HEADS} as h, unnest(['strict', 'broad']) as mode from v_notes) t")
def f08(v):
    return workplace.claims_strict_broad(v.v_notes.withColumn("heads", F.expr(_HEADS)), ["run"], "text", "heads")


@query("b01_envelopes", "select action, 0 as place, args as payload from v_actions where action % 4 < 3")
def b01(v):
    quoted = """concat('"', replace(args, '"', '\\\\"'), '"')"""
    content = f"""case action % 4 when 0 then args when 1 then {quoted} when 2 then concat('[{{"type": "image"}}, {{"type": "text", "text": ', {quoted}, '}}, {{"type": "text", "text": "see {{}}"}}]') else '"no object"' end"""
    return reviews.envelopes(v.v_actions.withColumn("content", F.expr(content)), ["action"], "content")


@query("c01_visible_messages", "select run, action, args as message, action as line, '' as pointer, case when not is_error then tool end as tool, case when action % 2 = 0 then start_us end as observed, row_number() over w as exposure, row_number() over w = 1 as first from v_actions window w as (partition by run, args order by action)")
def c01(v):
    exposures = v.v_actions.select("run", "action", F.col("args").alias("message"), F.col("action").alias("line"), F.lit("").alias("pointer"))
    events = v.v_actions.where("action % 2 = 0").select("run", F.col("action").alias("line"), F.col("start_us").alias("observed"))
    return longs(reviews.visible_messages(exposures, v.v_actions.where("not is_error"), events, ["run"]), "exposure")


_J15 = """with n as (select *, case node % 3 when 0 then 'functional_failed' when 1 then 'solver_compile_error' else 'timeout' end as fc from v_nodes),
g as (select run, req, count(case when status = 'failed' then 1 end) > 0 as bad, count(case when status = 'failed' and fc = 'functional_failed' then 1 end) as nf, count(case when status = 'failed' and fc = 'timeout' then 1 end) as nt, case req % 3 when 0 then 'claimed_done' when 1 then 'claimed_partial_or_open' else 'not_mentioned' end as claim from n group by run, req),
r as (select run, count(*) as scored, count(case when claim = 'claimed_done' then 1 end) as claimed_done, count(case when bad then 1 end) as failed, count(case when bad and claim = 'claimed_done' then 1 end) as silent, count(case when bad and claim = 'claimed_partial_or_open' then 1 end) as listed_open, count(case when bad and claim = 'claimed_done' and nf > 0 then 1 end) as functional, count(case when bad and claim = 'claimed_done' and nf = 0 and nt = 0 then 1 end) as build_or_load, count(case when bad and claim = 'claimed_done' and nf = 0 and nt > 0 then 1 end) as other from g group by run)
select cast(sum(scored) as bigint) as scored, cast(sum(claimed_done) as bigint) as claimed_done, cast(sum(failed) as bigint) as failed, cast(sum(silent) as bigint) as silent, cast(sum(listed_open) as bigint) as listed_open, cast(sum(functional) as bigint) as functional, cast(sum(build_or_load) as bigint) as build_or_load, cast(sum(other) as bigint) as other, count(case when failed > 0 then 1 end) as runs_with_failures, round(median(case when failed > 0 then silent / failed end), 6) as median_silent_share, count(case when silent > 0 then 1 end) as runs_silent, count(case when failed > 0 and silent / failed >= 0.5 then 1 end) as runs_half_silent from r"""


@query("j15_claim_stats", _J15)
def j15(v):
    of = F.expr("case node % 3 when 0 then 'functional_failed' when 1 then 'solver_compile_error' else 'timeout' end")
    claim = F.expr("case req % 3 when 0 then 'claimed_done' when 1 then 'claimed_partial_or_open' else 'not_mentioned' end")
    claims = workplace.delivered(v.v_nodes, ["run", "req"]).withColumn("claim", claim)
    return r6(reviews.claim_stats(claims, v.v_nodes.withColumn("failure_class", of), ["run"], "req"), "median_silent_share")
