"""Queries of the operators on open JSON, card ranges, resampling and cases, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import cases, mentions, nodes, sidecars, verifier
from runlens.plans.queries import query


def text(template: str, **columns: str) -> F.Column:
    """A template's text with <name> replaced by a column or expression."""
    parts, rest = [], template
    while "<" in rest:
        before, rest = rest.split("<", 1)
        name, rest = rest.split(">", 1)
        parts += [F.lit(before), F.expr(columns.get(name, name)).cast("string")]
    return F.concat(*parts, F.lit(rest))


_NAMES = "element_at(array('f2p_rate', 'xf2p', 'review_flagged', 'Reward', 'my_score', 'scoreboard', 'API_KEY_2', 'secretary'), cast(action % 8 as int) + 1)"
_A07 = """with n as (select action, tool, list_extract(['f2p_rate', 'xf2p', 'review_flagged', 'Reward', 'my_score', 'scoreboard', 'API_KEY_2', 'secretary'], cast(action % 8 as int) + 1) as name from v_actions)
select action, case when name in ('xf2p', 'scoreboard') then '{"a":[{"' || name || '":1,"tool":"' || tool || '"}],"' || name || '":{"tool":"x"},"n":' || action || '}' else '{"a":[{"tool":"' || tool || '"}],"n":' || action || '}' end as record from n"""


@query("a07_strip_private", _A07)
def a07(v):
    record = text('{"a": [{"<name>": 1, "tool": "<tool>"}], "<name>": {"tool": "x"}, "n": <action>}', name=_NAMES)
    return v.v_actions.select("action", sidecars.strip_private(record).alias("record"))


_A11 = """with l as (select run, action % 3 as path, action as line, action % 5 <> 4 as parsed, case when action % 5 < 3 then tool when action % 5 = 3 then 'unknown' end as kind from v_actions)
select run, line, parsed, kind, case when parsed then row_number() over (partition by run, parsed order by path, line) end as number from l"""


@query("a11_scan_sidecar", _A11)
def a11(v):
    forms = ('{"event": "<tool>", "type": "other"}', '{"type": "<tool>"}', '{"event": "", "type": null, "kind": "<tool>"}', '{"event": 0, "score": 1}', '{"event": <tool>')
    line = F.coalesce(*[F.when(F.col("action") % 5 == i, text(f)) for i, f in enumerate(forms)])
    lines = v.v_actions.select("run", (F.col("action") % 3).cast("string").alias("path"), F.col("action").alias("line"), line.alias("text"))
    return sidecars.scan_sidecar(lines, ["run"]).select("run", "line", "parsed", "kind", "number")


_B08 = """with e as (select run, 'id' as kind, 'K' || ord1 as key, null as version from v_records where ord2 % 3 = 0
union select run, 'body', 'K' || ord1, null from v_records where ord2 % 3 = 0
union select run, 'version', 'K' || ord1, '' || ord2 from v_records where ord2 % 3 = 0
union select run, 'conversation', 'c' || ord2, null from v_records where ord2 % 3 = 0
union select run, 'id', 'MR-' || ord1, null from v_records where ord2 % 3 = 1 and status = 'passed'
union select run, 'id', 'm' || ord1, null from v_records where ord2 % 3 = 2 and status = 'passed'
union select run, 'conversation', 'v' || ord2, null from v_records where ord2 % 3 = 2)
select * from e"""


@query("b08_returned_entities", _B08)
def b08(v):
    docs = text('{"conversation": {"id": "c<ord2>"}, "items": [[{"key": "K<ord1>", "id": "no", "selected_version": {"version": <ord2>, "body": ""}}]]}')
    reviews = text('{"id": "<start><ord1>"}', start="case status when 'passed' then 'MR-' else 'X' end")
    chat = text('[{"id": "m<ord1>", "<key>": "t", "conversation_id": "v<ord2>"}]', key="case status when 'passed' then 'text' else 'title' end")
    kind = F.col("ord2") % 3
    call = F.concat_ws("-", "node", "ord1", "ord2")  # a node may have several records
    results = v.v_records.select("run", call.alias("call"), F.when(kind == 0, "docs").when(kind == 1, "reviews").otherwise("chat").alias("family"), F.when(kind == 0, docs).when(kind == 1, reviews).otherwise(chat).alias("payload"))
    return sidecars.returned_entities(results, ["run"], "call", "family", "payload")


_D04 = """with r as (select distinct node, status, node_class from v_nodes)
select node, '' || node as id, status, '' as label, node_class as hint, 1 as style from r
union all select node, 'a' || node, 'failed', 'p2p_errors', '', 3 from r
union all select node, 't' || node, status, '', 'm', 2 from r
union all select node, 'd' || node, 'failed', 'load_error', 'm', 0 from r"""


@query("d04_walk_verifier", _D04)
def d04(v):
    file = text(
        '{"tests": [{"node_id": <node>, "status": "<status>", "kind": "<node_class>"}, {"note": "no id"}], "p2p_errors": ["a<node>"], "m": {"t<node>": <flag>, "d<node>": {"ok": "error", "reason": "load_error"}, "n": 3}}',
        flag="status = 'passed'",
    )
    found = verifier.walk_verifier(v.v_nodes.select("node", file.alias("file")), ["node"], "file")
    return found.select("node", F.col("ids")[0].alias("id"), "status", "label", "hint", "style")


_D11 = """select node, case when (node % 3 = 1 and req % 2 = 0) or (node % 3 <> 1 and status = 'passed') then 'passed' else 'failed' end as status,
case when (node % 3 = 1 and req % 2 = 0) or (node % 3 <> 1 and status = 'passed') then '' when node % 3 = 0 then 'pytest_failed' when node % 3 = 1 then 'suite_failed' else 'tap_failed' end as label from v_nodes"""


@query("d11_supplemental_rules", _D11)
def d11(v):
    kind = F.col("node") % 3
    phases = text('{"exit": 0, "phases": [{"outcome": "passed"}, {"outcome": "<status>"}]}')
    tap = text("# pass 0\n# fail 9\n# pass 3\n# fail <n>\n", n="case status when 'passed' then 0 else 1 end")
    files = v.v_nodes.select("run", "node", F.col("node").cast("string").alias("path"), F.when(kind == 0, phases).when(kind == 1, text('{"p2p_exit": <x>}', x="req % 2")).otherwise(tap).alias("text"))
    table = files.select("run", "node", "path", F.when(kind == 0, "phases").when(kind == 1, "exit").otherwise("tap").alias("rule"))
    return verifier.supplemental_rules(files, table, ["run"]).select("node", "status", "label")


_D13 = """with c as (select run, count(case when node_class = 'f2p' and status = 'passed' then 1 end) as p, count(*) as total, count(case when node % 4 <> 0 then 1 end) as kept,
count(case when node_class = 'f2p' and status = 'passed' and node % 4 <> 0 then 1 end) as f, count(case when node_class = 'p2p' and status = 'passed' and node % 4 <> 0 then 1 end) as g,
count(case when node_class = 'p2p' and status = 'passed' then 1 end) as q from v_nodes group by run)
select run, node, case when not (f = p and g = q and kept >= 0.5 * total) then 'unresolved' when node % 4 = 0 then 'failed' else status end as status,
case when f = p and g = q and kept >= 0.5 * total and node % 4 = 0 then 'not_reported' else '' end as label from v_nodes join c using (run)"""


@query("d13_reconciled_nodes", _D13)
def d13_nodes(v):
    v.keep("v_nodes")
    candidates = v.v_nodes.where("node % 4 <> 0").select("run", F.lit("kept").alias("candidate"), F.lit(0).alias("priority"), "node", "node_class", "status")
    chosen = nodes.reconcile(candidates, v.v_counts.select("run", "f2p_passed", "p2p_passed", "total"), ["run"])
    return verifier.reconciled_nodes(v.v_nodes, candidates, chosen, ["run"])


_F03 = """with u as (select run, req, 200 + req % 80 as x, 200 + req % 80 + req % 9 as y, 200 + req % 97 as z from v_reqs),
n as (select run, req, unnest(generate_series(x, y)) as number, y - x > 5 as blanket, 0 as mention, 10 as "at" from u
union all select run, req, z, y - x > 5, 0, 10 from u where y > x
union all select run, req, x, false, null, 1 from u)
select run, req, cast(number as int) as number, blanket, cast(mention as int) as mention, "at" from n where (run, number) in (select run, 200 + req % 100 from v_reqs)"""


@query("f03_card_ranges", _F03)
def f03(v):
    x = "200 + req % 80"
    unit = text("|<x>| see AB-<x>–<y>, <z> and more, not AB-1234 or XAB-200|", x=x, y=f"{x} + req % 9", z="200 + req % 97")
    units = v.v_reqs.select("run", "req", F.lit("AB").alias("prefix"), unit.alias("text"))
    return mentions.card_ranges(units, v.v_reqs.select("run", F.expr("cast(200 + req % 100 as int)").alias("number")), ["run"]).select("run", "req", "number", "blanket", "mention", "at")


_J12 = """with r as (select dimension, run, score, effort, row_number() over (partition by dimension order by run, score, effort) - 1 as at, count(*) over (partition by dimension) as n from v_ratings where score is not null and effort is not null),
s as (select dimension, n, rep, unnest(range(n)) as place from (select dimension, n, unnest(range(1, 1001)) as rep from (select distinct dimension, n from r) g) h),
d as (select s.dimension, s.n, s.rep, r.score, r.effort from s join r on r.dimension = s.dimension and r.at = cast('0x' || substr(md5('7|' || s.rep || '|' || s.place), 1, 8) as bigint) % s.n),
k as (select *, rank() over (partition by dimension, rep order by score) + (count(*) over (partition by dimension, rep, score) - 1) / 2 as a, rank() over (partition by dimension, rep order by effort) + (count(*) over (partition by dimension, rep, effort) - 1) / 2 as b from d),
c as (select dimension, n, rep, case when n >= 3 and min(score) <> max(score) and min(effort) <> max(effort) then corr(a, b) end as rho from k group by dimension, n, rep)
select dimension, n, count(rho) as used, round(quantile_cont(rho, 0.025), 6) as lo, round(quantile_cont(rho, 0.975), 6) as hi, coalesce(quantile_cont(rho, 0.025) > 0 or quantile_cont(rho, 0.975) < 0, false) as significant from c group by dimension, n"""


@query("j12_bootstrap_ci", _J12)
def j12(v):
    out = cases.bootstrap_ci(v.v_ratings, "score", "effort", ["dimension"], "run")
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


_J26 = """with l as (select run, count(*) as fails, count(case when node % 3 = 0 then 1 end) as ask, count(case when node % 3 = 1 then 1 end) as impl from v_nodes where status = 'failed' group by run),
q as (select run, avg(case when disclosure in ('obtained', 'returned_not_visible') then 1.0 else 0.0 end) as rate, count(case when disclosure = 'not_disclosed' then 1 end) as ab from v_reqs group by run),
a as (select run, coalesce(fails, 0) as fails, coalesce(ask, 0) as ask, coalesce(impl, 0) as impl, coalesce(rate, 0) as rate, coalesce(ab, 0) as ab from q full join l using (run)),
pool as (select * from a where rate = 1 union all select * from (select * from a where not exists (select 1 from a where rate = 1) order by rate desc, run limit 5) t),
picks as ((select 'ask_loss' as "case", run from a where ask > 0 order by ask desc, ask / greatest(fails, 1) desc, run limit 1)
union all (select 'implement_despite_all_obtained', run from pool where impl > 0 order by impl desc, run limit 1)
union all (select 'abandoned_deferrals', run from a where ab > 0 order by ab desc, ask desc, run limit 1)) """


def _cases(v):
    losses = v.v_nodes.where("status = 'failed'").select("run", F.expr("case node % 3 when 0 then 'ask' when 1 then 'implement' else 'read' end").alias("loss_stage"))
    reqs = v.v_reqs.select("run", F.col("disclosure").alias("acquisition"))
    return cases.select_cases(losses, reqs, v.v_reqs.where("disclosure = 'not_disclosed'").select("run"), "run")


@query("j26_select_cases", _J26 + "select * from picks")
def j26_cases(v):
    return _cases(v)


_J27 = """, t as (select run, req as card, count(*) as questions, max(node) as latest from v_nodes where (run, req) in (select run, req from v_reqs where disclosure = 'not_disclosed') group by run, req),
b as (select * from t qualify row_number() over (partition by run order by questions desc, card) = 1)
select "case", run, card, questions, round((latest - run) / 3600, 2) as last_hour from picks left join b using (run)"""


@query("j27_case_detail", _J26 + _J27)
def j27(v):
    asks = v.v_nodes.select("run", F.col("req").alias("card"), F.col("node").alias("at"))
    hidden = v.v_reqs.where("disclosure = 'not_disclosed'").select("run", F.col("req").alias("card"))
    out = cases.case_detail(_cases(v), asks, hidden, v.v_runs.select("run", F.col("run").alias("started_at")), "run", "card")
    return out.select("case", "run", "card", "questions", F.array_max("hours").alias("last_hour"))
