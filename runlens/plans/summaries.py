"""Queries of the operators on sums of claims, linked shares and documents for diagnoses, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.operators import relational, reviews, summaries, workplace
from runlens.plans.queries import query, r6

_F10 = """with d as (select run, req, case when bool_or(status = 'failed') then false when bool_and(status = 'passed') then true end as delivered from v_nodes group by run, req),
c as (select r.run, r.req, case req % 3 when 0 then 'claimed_done' when 1 then 'claimed_partial_or_open' else 'not_mentioned' end as claim, delivered, req % 7 = 1 as listed_as_open, case req % 5 when 0 then 'card_id' when 1 then 'topic' when 2 then 'blanket' end as match_method from v_reqs r left join d using (run, req)),
p as (select r.run, count(case when not delivered then 1 end) as failed, count(case when not delivered and claim = 'claimed_done' then 1 end) as silent, count(case when delivered is not null and claim = 'claimed_done' then 1 end) as claimed_done from v_runs r left join c using (run) group by r.run),
q as (select *, silent / nullif(failed, 0) as silent_share from p) """


def _claims(v) -> DataFrame:
    req = F.col("req")
    claim = F.when(req % 3 == 0, "claimed_done").when(req % 3 == 1, "claimed_partial_or_open").otherwise("not_mentioned")
    method = F.when(req % 5 == 0, "card_id").when(req % 5 == 1, "topic").when(req % 5 == 2, "blanket")
    j = v.v_reqs.join(workplace.delivered(v.v_nodes, ["run", "req"]).hint("merge"), ["run", "req"], "left")
    return j.select("run", "req", claim.alias("claim"), "delivered", (req % 7 == 1).alias("listed_as_open"), method.alias("match_method"))


@query("f10_claim_runs", _F10 + "select run, failed, silent, claimed_done, round(silent_share, 6) as silent_share from q")
def f10_runs(v):
    return r6(summaries.claim_runs(_claims(v), v.v_runs, ["run"]), "silent_share")


@query("f10_claim_totals", _F10 + """, s as (select silent_share as x, row_number() over (order by silent_share) as k, count(*) over () as n from q where silent_share is not null),
w as (select i, any_value(n) as n, any_value(least(greatest(i * (n + 1) // 4, 1), n - 1)) as j from s, (values (1), (3)) t(i) group by i),
b as (select i, (select x from s where k = j) + ((select x from s where k = j + 1) - (select x from s where k = j)) * (i * (n + 1) - 4 * j) / 4.0 as x from w)
select count(*) as requirements, count(delivered) as scored, count(case when not delivered then 1 end) as failed, round(count(case when not delivered and claim = 'claimed_done' then 1 end) / count(case when not delivered then 1 end), 6) as silent_share,
round(count(case when not delivered and claim = 'claimed_done' then 1 end) / count(case when delivered is not null and claim = 'claimed_done' then 1 end), 6) as done_failed_share, count(case when listed_as_open then 1 end) as listed_as_open,
(select count(*) from q) as runs, (select count(silent_share) from q) as runs_with_failures, (select round(median(silent_share), 6) from q) as median, (select round(x, 6) from b where i = 1) as p25, (select round(x, 6) from b where i = 3) as p75 from c""")
def f10_totals(v):
    claims = _claims(v)
    return r6(summaries.claim_totals(claims, summaries.claim_runs(claims, v.v_runs, ["run"])), "silent_share", "done_failed_share", "median", "p25", "p75")


@query("f10_claim_counts", _F10 + "select 'claim' as of, claim || '/' || case when delivered then 'delivered' else 'failed' end as name, count(*) as n from c where delivered is not null group by 2 union all select 'match_method', coalesce(match_method, ''), count(*) from c group by 2")
def f10_counts(v):
    return summaries.claim_counts(_claims(v))


@query("c12_linked_shares", """with u as (select count(case when turn % 3 <> 0 then 1 end) as a, count(*) as q, count(case when turn % 2 = 0 then 1 end) as vis from v_turns where role = 'user'), s as (select count(case when turn % 4 = 0 then 1 end) as linked, count(*) as n from v_turns where role = 'system')
select ratio, numerator, denominator, round(numerator / nullif(denominator, 0), 6) as share from (select 'question_to_ask' as ratio, a as numerator, q as denominator from u union all select 'question_reply_visible', vis, q from u union all select 'fact_declaration_reply_visible', 0, 0 union all select 'notification_release_link', linked, n from s) t""")
def c12_shares(v):
    user, system, turn = F.col("role") == "user", F.col("role") == "system", F.col("turn")
    none = F.lit(None).cast("bigint")
    coverage = v.v_turns.groupBy("run").agg(
        F.count_if(user & (turn % 3 != 0)).alias("question_events_linked_to_ask"), F.count_if(user).alias("sidecar_question_events"), F.count_if(user & (turn % 2 == 0)).alias("question_replies_model_visible"),
        F.count_if(system & (turn % 4 == 0)).alias("visible_notifications_with_release_link"), F.count_if(system).alias("unique_visible_notifications"),
    ).withColumns({"fact_events_with_visible_reply_id": none, "declared_fact_events": none})
    return r6(summaries.linked_shares(coverage), "share")


# --- H09

_H09_SKIP = """with sk as (select r.run, case when not coalesce(c.total % 4 <> 0, false) then 'per-node outcomes not reconstructed' when r.run % 5 = 0 then 'no requirement links' end as reason from v_runs r left join v_counts c using (run)) """
_NODE = "node, status, case when status = 'failed' and node % 2 = 0 then 'functional_failed' end as failure_class"
_H09 = """with n as (select run, req, count(*) as nodes_total, count(case when status = 'passed' then 1 end) as nodes_passed, list_sort(list(distinct case when status = 'failed' then case when node % 3 = 0 then 'ask' else 'implement' end end) filter (where status = 'failed')) as pipeline_loss_stage,
list({'node': node, 'status': status, 'failure_class': case when status = 'failed' and node % 2 = 0 then 'functional_failed' end, 'ask_detail': case when node % 3 = 0 then 'not_asked' end, 'mapping_confidence': 'high', 'grader_output': case when status = 'failed' then concat('said "', node, '"') end} order by node) as nodes from v_nodes where node_class = 'f2p' group by run, req),
d as (select run, card, list({'owner': owner, 'followed': followed, 'disclosed': disclosed, 'budget_left_hours': b, 'hours_until_run_end': h} order by owner) as deferrals from (select run, concat('c', req % 9) as card, holder as owner, bool_or(req % 5 = 0) as followed, bool_or(req % 7 = 0) as disclosed, max(req % 16) / 2.0 as b, min(req % 10) / 4.0 as h from v_reqs where holder <> 'public' group by all) t group by run, card),
r as (select q.run, q.req, {'req': q.req, 'card': case when q.req % 6 <> 0 then concat('c', q.req % 9) end, 'topic': case when q.req % 4 = 0 then '' else concat('t', q.req % 4) end, 'holder': q.holder, 'acquisition': q.disclosure, 'questions': q.req % 3, 'nodes_total': coalesce(n.nodes_total, 0), 'nodes_passed': coalesce(n.nodes_passed, 0), 'pipeline_loss_stage': n.pipeline_loss_stage, 'nodes': coalesce(n.nodes, []),
'delivery_note': {'strict': case when q.req % 5 <> 0 then 'claimed_done' end, 'broad': case when q.req % 2 = 0 then 'not_mentioned' end, 'listed_as_open': case when q.req % 5 <> 0 then q.req % 3 = 0 end, 'match_method': case when q.req % 5 <> 0 then 'card_id' end, 'excerpt': case when q.req % 5 in (1, 2) then 'über' end, 'line': case when q.req % 5 <> 0 then 'SOLUTION.md:3' end},
'deferrals': coalesce(d.deferrals, [])} as x from v_reqs q left join n on n.run = q.run and n.req = q.req left join d on d.run = q.run and q.req % 6 <> 0 and d.card = concat('c', q.req % 9)),
p as (select run, list({'node': node, 'failure_class': null, 'grader_output': case when node % 2 = 0 then 'tail' end} order by node) as p2p_failed from v_nodes where node_class = 'p2p' and status <> 'passed' group by run)
select c.run, cast(to_json({'outcome': {'f2p_passed': f2p_passed, 'f2p_total': f2p_total}, 'requirements': coalesce(rs, []), 'p2p_failed': coalesce(p2p_failed, [])}) as varchar) as document from v_counts c left join (select run, list(x order by req) as rs from r group by run) r using (run) left join p using (run)"""


@query("h09_skipped_runs", _H09_SKIP + "select run, reason from sk where reason is not null")
def h09_skipped(v):
    reconciled = v.v_counts.select("run", (F.col("total") % 4 != 0).alias("match"))
    return summaries.skipped_runs(v.v_runs, reconciled, v.v_runs.where("run % 5 <> 0"), ["run"])


@query("h09_diagnosis_documents", _H09)
def h09_documents(v):
    v.keep("v_nodes")
    req, node = F.col("req"), F.col("node")
    failed = F.col("status") == "failed"
    card = F.concat(F.lit("c"), req % 9)
    runs = v.v_counts.select("run", F.struct("f2p_passed", "f2p_total").alias("outcome"))
    reqs = v.v_reqs.select("run", "req", F.when(req % 6 != 0, card).otherwise("").alias("card"), F.when(req % 4 != 0, F.concat(F.lit("t"), req % 4)).alias("topic"), "holder", F.col("disclosure").alias("acquisition"), (req % 3).alias("questions"))
    nodes = v.v_nodes.where("node_class = 'f2p'").select(
        "run", "req", "node", "status", F.when(failed & (node % 2 == 0), "functional_failed").otherwise("").alias("failure_class"), F.when(node % 3 == 0, "not_asked").otherwise("").alias("ask_detail"),
        F.when(failed, F.when(node % 3 == 0, "ask").otherwise("implement")).alias("loss_stage"), F.lit("high").alias("mapping_confidence"), F.when(failed, F.concat(F.lit('said "'), "node", F.lit('"'))).otherwise("").alias("grader_output"),
    )
    claims = v.v_reqs.where("req % 5 <> 0").select("run", "req", F.lit("claimed_done").alias("claim_class"), (req % 3 == 0).alias("listed_as_open"), F.lit("card_id").alias("match_method"), F.when((req % 5).isin(1, 2), "über").otherwise("").alias("excerpt"), F.lit("SOLUTION.md:3").alias("line"))
    broad = v.v_reqs.where("req % 2 = 0").select("run", "req", F.lit("not_mentioned").alias("claim_class"))
    deferrals = v.v_reqs.where("holder <> 'public'").groupBy("run", card.alias("card"), F.col("holder").alias("owner")).agg(
        F.bool_or(req % 5 == 0).alias("followed"), F.bool_or(req % 7 == 0).alias("disclosed"), (F.max(req % 16) / 2).alias("budget_left_hours"), (F.min(req % 10) / 4).alias("hours_until_run_end"),
    )
    lost = v.v_nodes.where("node_class = 'p2p' and status <> 'passed'").select("run", "node", F.lit("").alias("failure_class"), F.when(node % 2 == 0, "tail").otherwise("").alias("grader_output"))
    return summaries.diagnosis_documents(runs, reqs, nodes, claims, broad, deferrals, lost, ["run"])


# --- J20, J25, K07, L01

_LANGUAGES = (*rules.LANGUAGE_GROUPS, "Zig")
_IN_DOMAINS = (*rules.DOMAINS, "Science", "Other")
_GROUPED = " ".join(f"when {i} then '{rules.LANGUAGE_GROUPS.get(x, 'Other')}'" for i, x in enumerate(_LANGUAGES))
_DOMAIN = " ".join(f"when {i} then '{x}'" for i, x in enumerate(rules.DOMAINS))
_J20 = f"""with r as (select c.run, f2p_passed / nullif(f2p_total, 0) as rate, f2p_passed = f2p_total as strict, q.o as obtained, total, c.run % 7000 as added from v_counts c left join (select run, avg(case when disclosure = 'obtained' then 1.0 else 0.0 end) as o from v_reqs where holder <> 'public' group by run) q using (run) where c.run % 10 <> 0),
s as (select 'verifier_nodes' as axis, case when total < 28 then '<28' when total <= 35 then '28-35' else '>35' end as stratum, * from r union all select 'edit_size', case when added < 1000 then '<1k' when added <= 5000 then '1k-5k' else '>5k' end, * from r
union all select 'language', case run % {len(_LANGUAGES)} {_GROUPED} end, * from r union all select 'domain', case run % {len(_IN_DOMAINS)} {_DOMAIN} else 'Other' end, * from r)
select axis, stratum, count(*) as n, round(100 * avg(rate), 6) as rate_pct, count(case when strict then 1 end) as strict, round(100 * avg(obtained), 6) as obtained_pct from s group by axis, stratum"""


def _one_of(c: str, names: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names)).cast("int") + 1)


@query("j20_release_strata", _J20)
def j20_release(v):
    obtained = v.v_reqs.where("holder <> 'public'").groupBy("run").agg(F.avg((F.col("disclosure") == "obtained").cast("int")).alias("obtained"))
    runs = v.v_counts.join(obtained, "run", "left").select("run", F.try_divide("f2p_passed", "f2p_total").alias("rate"), (F.col("f2p_passed") == F.col("f2p_total")).alias("strict"), "obtained")
    release = v.v_counts.where("run % 10 <> 0").select("run", F.col("total").alias("n_nodes"), (F.col("run") % 7000).alias("added"), _one_of("run", _LANGUAGES).alias("language"), _one_of("run", _IN_DOMAINS).alias("domain"))
    return r6(summaries.release_strata(runs, release, ["run"]), "rate_pct", "obtained_pct")


_J25 = """with l as (select run, args, arg_max(action, action) as i, arg_max(action % 50, action) as o from v_actions group by run, args), u as (select run, cast(sum(i) as double) as input_tokens, cast(sum(o) as double) as output_tokens from l where args is not null group by run)
select metric, count(*) as n, round(sum(x), 6) as total, round(min(x), 6) as least, round(max(x), 6) as most, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75), 6) as p75 from (select 'input_tokens' as metric, input_tokens as x from u union all select 'output_tokens', output_tokens from u) t group by metric"""


@query("j25_reviewer_tokens", _J25)
def j25_tokens(v):
    records = v.v_actions.select("run", "args", "action", F.col("action").alias("input_tokens"), (F.col("action") % 50).alias("output_tokens"))
    usage = reviews.reviewer_usage(records, ["run"], "args", ["action"], ["input_tokens", "output_tokens"])
    return r6(relational.five_number(usage.select(*[F.col(c).cast("double").alias(c) for c in ("input_tokens", "output_tokens")]), ["input_tokens", "output_tokens"]), "total", "least", "most", "p25", "median", "p75")


_K07 = """with l as (select run, case when node % 4 = 0 then 'discovery' when node % 4 = 1 then 'ask' when node % 4 = 2 then 'read' else 'implement' end as stage, count(*) as n from v_nodes where status = 'failed' and node % 9 <> 0 group by 1, 2),
t as (select run, string_agg(upper(stage[1]) || n, ' ' order by case stage when 'discovery' then 0 when 'ask' then 1 when 'read' then 2 else 3 end) as lost_at from l group by run),
q as (select run, count(*) as held, count(case when disclosure = 'obtained' then 1 end) as obtained from v_reqs where holder <> 'public' group by run)
select c.run, concat('task ', c.run) as task, f2p_passed || '/' || f2p_total as f2p, p2p_passed || '/' || p2p_total as p2p, case when c.run % 3 = 0 then 'time_budget' end as end_reason, printf('%.1f', case when c.run % 8 = 0 then 0.0 else c.run % 33 / 4.0 + 0.01 end) as hours, total as messages,
coalesce(obtained, 0) || '/' || coalesce(held, 0) as obtained, coalesce(lost_at, '') as lost_at, c.run % 2 || '/' || c.run % 5 as deferrals, '0/' || c.run % 4 as claims, case when c.run % 7 = 0 then '–' else 'no' end as premature from v_counts c left join q using (run) left join t using (run)"""


@query("k07_short_index", _K07)
def k07_index(v):
    run, node = F.col("run"), F.col("node")
    stage = F.when(node % 9 == 0, "unmapped").otherwise(_one_of("node", rules.LOSS_STAGES))
    losses = v.v_nodes.where("status = 'failed'").select("run", stage.alias("stage"))
    held = v.v_reqs.where("holder <> 'public'").groupBy("run").agg(F.count("*").alias("held"), F.count_if(F.col("disclosure") == "obtained").alias("obtained"))
    summary = v.v_counts.join(held, "run", "left").withColumns({
        "task": F.concat(F.lit("task "), "run"), "end_reason": F.when(run % 3 == 0, "time_budget"), "hours": F.when(run % 8 != 0, run % 33 / 4 + 0.01), "messages": F.col("total"), "abandoned": run % 2, "threads": run % 5,
        "done_failed": F.lit(None).cast("int"), "done": run % 4, "premature": F.when(run % 7 != 0, "no"),
    })
    return summaries.short_index(summary, losses, ["run"])


_FIGURES = ["n", "obtained_rate", "failed", "listed_open_pct", "claimed_done_pct"]


@query("l01_model_rows", """with c as (select domain as model, disclosure, delivered, req from v_reqs join v_runs using (run) join (select run, req, bool_and(status = 'passed') as delivered from v_nodes group by run, req) d using (run, req)),
m as (select model, cast(count(*) as double) as n, 100 * avg(case when disclosure = 'obtained' then 1.0 else 0.0 end) as obtained_rate, cast(count(case when not delivered then 1 end) as double) as failed, 100.0 * count(case when not delivered and req % 3 = 1 then 1 end) / nullif(count(case when not delivered then 1 end), 0) as listed_open_pct,
100.0 * count(case when not delivered and req % 3 = 0 then 1 end) / nullif(count(case when not delivered then 1 end), 0) as claimed_done_pct from c group by model)
select model, n, round(obtained_rate, 6) as obtained_rate, failed, round(listed_open_pct, 6) as listed_open_pct, round(claimed_done_pct, 6) as claimed_done_pct, round(case when failed > 0 then 100 - listed_open_pct - claimed_done_pct end, 6) as silent_pct from m""")
def l01_rows(v):
    j = v.v_reqs.join(v.v_runs, "run").join(workplace.delivered(v.v_nodes, ["run", "req"]).hint("merge"), ["run", "req"])
    failed, req = ~F.col("delivered"), F.col("req")
    pct = lambda w: F.try_divide(100 * F.count_if(failed & w), F.count_if(failed))
    by_model = j.groupBy(F.col("domain").alias("model")).agg(
        F.count("*").cast("double").alias("n"), F.avg((F.col("disclosure") == "obtained").cast("double")).alias("obtained_rate"), F.count_if(failed).cast("double").alias("failed"),
        pct(req % 3 == 1).alias("listed_open_pct"), pct(req % 3 == 0).alias("claimed_done_pct"),
    )
    return r6(summaries.model_rows(by_model.unpivot("model", _FIGURES, "figure", "value"), _FIGURES), "obtained_rate", "listed_open_pct", "claimed_done_pct", "silent_pct")
