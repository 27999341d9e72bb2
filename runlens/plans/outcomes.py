"""Queries of the operators on node names, graders' texts and reviews, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import checks, claims, comms, grader, mentions, nodes, normalize, relational, reviews, wide
from runlens.functions import rules
from runlens.plans.evidence import text
from runlens.plans.queries import longs, query, r6

# --- D06: names of nodes

_IDS = "case node % 4 when 0 then concat('tests/x.py::test_unit[', node, ']') when 1 then concat('PR-', node) when 2 then concat('case ', req, ' v', node % 100) else concat('Behavior: Load-', node) end"
_NODE_IDS = f"select run, req, node as place, node_class, {_IDS} as node from {{v_nodes}}"
_SAYS = "case ord1 % 7 when 0 then i.node when 1 then concat('alias-', place) when 2 then concat('  [F2P] ', upper(i.node)) when 3 then concat('test ', i.node) when 4 then concat('item 00', place) when 5 then concat('case ', r.req, '!') else concat('load/', place % 10) end"
_RECORDS = f"select distinct r.run, concat(r.node, '-', ord1, '-', ord2) as record, concat('item ', place + 1) as first, {_SAYS} as second from {{v_records}} r join ids i on i.run = r.run and i.place = r.node"
_CANON = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '^\\[(f2p|p2p)\\]\\s*', ''), '^(f2p|p2p)[\\s:_\\-/]+', ''), '[^a-z0-9]+', '_', 'g'), '_')"
_NUMBER = "regexp_replace(list_extract(list_sort(list_transform(regexp_extract_all({0}, '\\d+'), lambda x, i: (-len(x), i, x))), 1)[3], '^0+(.)', '\\1')"
_D06 = f"""with ids as ({_NODE_IDS.format(v_nodes="v_nodes")}), records as ({_RECORDS.format(v_records="v_records")}),
named as (select run, place, node, {_CANON.format("node")} as canon, {_NUMBER.format("node")} as num from ids),
keyed as (select *, count(*) over (partition by run, canon) as canons, count(*) over (partition by run, num) as nums from named),
said as (select run, record, pos, name, {_CANON.format("name")} as canon, {_NUMBER.format("name")} as num from (select run, record, unnest([0, 1]) as pos, unnest([first, second]) as name from records) t),
p as (select unnest([0, 1, 2, 3, 4, 5]) as sub, unnest(['pr_', 'node_', 'behavior_', 'test_', 'f2p_', 'p2p_']) as pre),
hits as (select s.run, record, 'exact' as tier, 0 as t, pos, 0 as sub, place, node from said s join ids i on i.run = s.run and i.node = s.name
union all select s.run, record, 'alias', 1, pos, 0, place, node from said s join ids i on i.run = s.run and s.name = 'alias-' || place where node_class = 'f2p'
union all select s.run, record, 'canonical', 2, pos, 0, place, node from said s join keyed k on k.run = s.run and k.canon = s.canon and canons = 1
union all select s.run, record, 'prefix', 3, pos, sub, place, node from said s join keyed k on k.run = s.run join p on k.canon = pre || s.canon or s.canon = pre || k.canon
union all select s.run, record, 'number', 4, pos, 0, place, node from said s join keyed k on k.run = s.run and k.num = s.num and nums = 1 and len(s.num) >= 2)
select run, record, tier, node from hits qualify row_number() over (partition by run, record order by t, pos, sub, place) = 1"""


def _named(nodes):
    return nodes.sparkSession.sql(_NODE_IDS.format(v_nodes="{nodes}"), nodes=nodes)


def _dealt(v):
    """Records, and nodes with their names, dealt out by run after both were written once: numbers move, and texts are made of them there."""
    v.keep("v_records")
    v.keep("v_nodes", "run", "req", "node", "node_class")
    return relational.dealt(v.v_records, ["run"]), _named(relational.dealt(v.v_nodes, ["run"]))


@query("d06_match_all_tiers", _D06)
def d06_all(v):
    given, ids = _dealt(v)
    records = ids.sparkSession.sql(_RECORDS.format(v_records="{r}").replace("join ids i", "join {ids} i"), r=given, ids=ids)
    records = records.select("run", "record", F.array("first", "second").alias("ids"))
    ids = _named(v.v_nodes)
    aliases = ids.where("node_class = 'f2p'").select("run", F.concat(F.lit("alias-"), "place").alias("alias"), "node")
    return v.written_in_place(nodes.match_nodes(records, ids, aliases, ["run"], "record", "ids", "node", "place"), "matched")


# --- D09: classes by every pattern of a message

_SAID = (
    "a.cs(1): error CS0103: no such name", "error[E0382]: use of moved value", "x.java: cannot find symbol", "Compilation Failed", "compilation error", "error TS2304: no name", "it does not compile", "undefined reference to f", "go build ./...", "BUILD FAILED",
    "it timed out", "Timeout after 5 s", "ModuleNotFoundError: x", "ImportError: y", "LoadError", "Cannot find module 'z'", "NoClassDefFoundError", "ClassNotFoundException", "NameError: q", "f is not a function", "TypeError: bad", "NoMethodError", "thread panicked at",
    "assert x", "Expected 3", "Failure: two", "a mismatch", "1 !== 2", "it should hold", "not equal", "typeerror", "nothing told", "error CS", "error[Ex]",
)
_CLASS_OF = " ".join(f"when {i} then '{c}'" for i, c in enumerate(["solver_compile_error"] * 10 + ["timeout"] * 2 + ["solver_runtime_or_load_error"] * 11 + ["functional_failed"] * 7 + ["unspecified"] * 4))


@query("d09_message_classes", f"select node, case cast(node as bigint) % {len(_SAID)} {_CLASS_OF} end as failure_class from v_nodes where status = 'failed'")
def d09_messages(v):
    message = F.array(*map(F.lit, _SAID))[(F.col("node") % len(_SAID)).cast("int")]
    return v.v_nodes.where("status = 'failed'").select("node", nodes.failure_class(F.lit(None).cast("string"), message).alias("failure_class"))


# --- K03: graders' texts

_FORMS = "case ord1 % 6 when 0 then concat('FAILED ', i.node, ' (', status, ')') when 1 then concat('see <', i.node, '>') when 2 then concat('x', i.node, ' is another') when 3 then concat('no ', place, '-b') when 4 then concat('unit ', place, ': ', status) else concat('[p2p] ', i.node) end"
_LINES = f"select r.run, case ord2 % 3 when 0 then concat('r', r.run, '/verifier/run.log') when 1 then concat('r', r.run, '/verifier/b.log') else concat('r', r.run, '/all.log') end as file, concat({_FORMS}, ' ', ord1, ' ', ord2, ' ', cast(round(ord3 * 100) as bigint)) as said from {{v_records}} r join ids i on i.run = r.run and i.place = r.node"
_K03_NODES = "select run, node, place, req, case when place % 5 = 0 then concat('r', run, '/verifier/out.jsonl') else concat('r', run, '/verifier/run.log') end as path from ids"
_ESCAPED = "regexp_replace(name, '([\\[\\]().*+?^$|{}\\\\])', '\\\\\\1', 'g')"
_K03 = f"""with ids as ({_NODE_IDS.format(v_nodes="v_nodes")}),
lines as (select *, row_number() over (partition by run, file order by said) as no from ({_LINES.format(v_records="v_records")}) t),
own as ({_K03_NODES}),
names as (select distinct run, node, path, unnest([node, nullif(regexp_extract(node, '\\[([^\\]]+)\\]$', 1), ''), nullif(regexp_extract(node, '(?i)^pr[-_ ]?(\\d+)$', 1), '')]) as name from own),
hits as (select n.run, n.node, case when file = path then 0 when contains(file, 'verifier') then 1 else 2 end as far, file, no, any_value(said) as said from names n join lines l on l.run = n.run and contains(said, name) where name is not null and regexp_matches(said, '(^|[^\\w-])' || {_ESCAPED} || '($|[^\\w-])') group by all),
last as (select * from hits qualify row_number() over (partition by run, node, file order by no desc) <= case when far = 0 then 20 else 12 end),
logs as (select run, node, far, file, case when far = 0 then '' else '[' || regexp_extract(file, '[^/]*$') || ']' || chr(10) end || string_agg(said, chr(10) order by no) as t from last group by run, node, far, file),
recs as (select run, node, 0 as far, '' as file, case when req % 2 = 0 then 'err_tail: lost ' || place || chr(10) || 'reason: none' else '{{"id": "' || node || '", "n": ' || place || '}}' end as t from own where place % 5 = 0),
parts as (select run, node, string_agg(t, chr(10) order by far, file) as t from (select run, node, far, file, t from logs union all select * from recs) u group by run, node)
select run, node, case when t is null then '' when len(t) <= 90 then t else substr(t, 1, 60) || chr(10) || '… [' || (len(t) - 90) || ' chars omitted] …' || chr(10) || right(t, 30) end as output from own left join parts using (run, node)"""


@query("k03_grader_output", _K03)
def k03(v):
    given, ids = _dealt(v)
    spark = ids.sparkSession
    lines = spark.sql(_LINES.format(v_records="{r}").replace("join ids i", "join {ids} i"), r=given, ids=ids)
    logs = lines.groupBy("run", F.col("file").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("said")), "\n").alias("text"))
    own = spark.sql(_K03_NODES.replace("from ids", "from {ids}"), ids=ids)
    told = text('{"name": "<node>", "err_tail": " lost <place> ", "reason": "none", "in": [1]}')
    bare = text('{"id": "<node>", "n": <place>, "sub": {"other": 1}}')
    record = F.when(F.col("req") % 2 == 0, told).otherwise(bare)
    json = own.where("place % 5 = 0").groupBy("run", "path").agg(F.array_join(F.collect_list(record), "\n").alias("text"))
    files = v.written_in_place(logs.unionByName(json), "files")
    return v.written_in_place(grader.grader_output(own, files, ["run"], "node", 90), "said")


# --- A09, B17: orphans, nested usage

_A09 = """with c as (select req, node, ord1, ord2, node || '-' || ord1 || '-' || ord2 as action from v_records where node_class = 'f2p'),
r as (select distinct req, ord1, ord2, node from v_records where node_class = 'p2p'),
o as (select *, exists (select 1 from c where c.req = r.req and (c.ord1, c.ord2) <= (r.ord1, r.ord2)) as called from r)
select 'matching_later_call' as kind, req, node, ord1, ord2, (select arg_min(action, (c.ord1, c.ord2, c.action)) from c where c.req = o.req and (c.ord1, c.ord2) > (o.ord1, o.ord2)) as action from o where not called
union all select distinct 'missing_result', req, null, null, null, null from c where not exists (select 1 from r where r.req = c.req and r.ord1 > (select min(ord1) from c d where d.req = c.req))"""


@query("a09_orphans", _A09)
def a09_orphans(v):
    v.keep("v_records", "req", "node", "node_class", "ord1", "ord2")
    name = F.concat_ws("-", "node", "ord1", "ord2")
    calls = v.v_records.where("node_class = 'f2p'").select("req", "ord1", "ord2", name.alias("action"))
    results = v.v_records.where("node_class = 'p2p'").select("req", "ord1", "ord2", "node")
    later = normalize.later_calls(calls, results, ["req"], ["ord1", "ord2"], "action").distinct()
    later = later.select(F.lit("matching_later_call").alias("kind"), "req", "node", "ord1", "ord2", F.col("matching_later_call").alias("action"))
    missing = normalize.missing_results(calls, results, ["req"], "ord1")
    return later.unionByName(missing.select(F.lit("missing_result").alias("kind"), "req"), allowMissingColumns=True)


_PHASE = "case action % 3 when 0 then concat('{\"input_tokens\": ', action, ', \"output_tokens\": 2, \"d\": {\"cached\": {\"read\": ', action % 7, ', \"w\": 0}, \"x\": \"no\", \"z\": true}}') when 1 then concat('{\"input_tokens\": ', action, ', \"d\": {\"cached\": {\"read\": null}}}') else '{\"input_tokens\": null, \"output_tokens\": 1.5}' end"
_B17 = """select run, action, cast(action % 4 as int) as phases, cast(case when action % 3 = 0 then action % 4 else 0 end as int) as with_needed,
case when action % 4 > 0 then action % 5 <> 0 end as matches from v_actions"""


@query("b17_usage_by_event", _B17)
def b17_events(v):
    n = F.col("action") % 4
    phases = F.slice(F.array_repeat(F.expr(_PHASE), 3), F.lit(1), n.cast("int"))
    # the sums of n equal phases; a fifth of the events tells something else
    kind, k = F.col("action") % 3, F.when(F.col("action") % 5 == 0, n + 1).otherwise(n)
    own = F.when(kind == 0, F.format_string('{"d": {"cached": {"w": 0, "read": %d}}, "output_tokens": %d, "input_tokens": %d}', F.col("action") % 7 * k, 2 * k, F.col("action") * k))
    own = own.when(kind == 1, F.format_string('{"input_tokens": %d}', F.col("action") * k)).otherwise(F.format_string('{"output_tokens": %s}', (1.5 * k).cast("string")))
    events = v.v_actions.select("run", "action", phases.alias("phases"), own.alias("usage"))
    return reviews.usage_by_event(events.unionByName(events), ["run"], ["action"], "phases", "usage")


_B17_KEYS = """with p as (select run, action, action % 3 as kind from v_actions, range(3) r(i) where i < action % 4)
select run, 'input_tokens' as usage_key, count(case when kind < 2 then 1 end) as reporting, sum(case when kind < 2 then action end)::double as total from p group by run having count(case when kind < 2 then 1 end) > 0
union all select run, 'output_tokens', count(case when kind <> 1 then 1 end), sum(case kind when 0 then 2.0 when 2 then 1.5 end)::double from p group by run having count(case when kind <> 1 then 1 end) > 0
union all select run, 'd.cached.read', count(case when kind = 0 then 1 end), sum(case when kind = 0 then action % 7 end)::double from p group by run having count(case when kind = 0 then 1 end) > 0
union all select run, 'd.cached.w', count(case when kind = 0 then 1 end), sum(case when kind = 0 then 0 end)::double from p group by run having count(case when kind = 0 then 1 end) > 0"""


@query("b17_nested_usage", _B17_KEYS)
def b17_nested(v):
    phases = v.v_actions.select("run", "action", F.explode(F.slice(F.array_repeat(F.expr(_PHASE), 3), F.lit(1), (F.col("action") % 4).cast("int"))).alias("phase"))
    flat = phases.select("run", F.monotonically_increasing_id().alias("no"), reviews.flat_usage(F.col("phase")).alias("usage"))
    return reviews.phase_usage(flat, ["run"], ["no"], "usage")


# --- F05, F07: claims by clauses and topics

_CARDS = "select distinct run, 200 + req % 50 as number from v_reqs union select distinct run, 260 + req % 30 from v_reqs"
_FILL = "repeat('note ', 70)"
_F05 = f"""with c as ({_CARDS}), u as (select run, req, 200 + req % 50 as a, 260 + req % 30 as b, req % 7 as kind from v_reqs),
m as (select run, req, a as number, case kind when 0 then 'claimed_done' when 1 then 'claimed_partial_or_open' when 4 then 'claimed_done' when 5 then 'claimed_partial_or_open' else 'claimed_done' end as claim,
case kind when 0 then 'AB-' || a || ' was implemented.' when 1 then 'AB-' || a || ' was implemented. AB-' || b || ' is pending; more' when 4 then 'AB-' || a || ' answered' when 5 then 'AB-' || a || ' 待回复！AB-' || b || ' 已实现' else '关于 AB-' || a || ' 已实现！' end as said from u where kind in (0, 1, 4, 5, 6)
union all select run, req, b, case when kind = 6 then 'not_mentioned' else 'claimed_partial_or_open' end, case kind when 0 then 'AB-' || b || ' is pending;' when 1 then 'AB-' || a || ' was implemented. AB-' || b || ' is pending; more' when 5 then 'AB-' || a || ' 待回复！AB-' || b || ' 已实现' else 'AB-' || b || '？' end from u where kind in (0, 1, 5, 6)
union all select run, req, unnest(generate_series(200, 250)), case kind when 2 then 'not_mentioned' else 'claimed_done' end, case kind when 2 then 'See AB-200–250.' else 'Implemented all of AB-200–250;' end from u where kind in (2, 3))
select m.* from m join c using (run, number)"""


@query("f05_claims_by_clause", _F05)
def f05_clauses(v):
    a, b = "200 + req % 50", "260 + req % 30"
    forms = (
        "Some words. AB-<a> was implemented. AB-<b> is pending; <fill>", "AB-<a> was implemented. AB-<b> is pending; more", "See AB-200–250. All is pending.", "Implemented all of AB-200–250; rest pending", "AB-<a> answered", "AB-<a> 待回复！AB-<b> 已实现", "<fill>。关于 AB-<a> 已实现！AB-<b>？",
    )
    unit = F.coalesce(*[F.when(F.col("req") % 7 == i, text(f, a=a, b=b, fill=_FILL)) for i, f in enumerate(forms)])
    units = v.v_reqs.select("run", "req", F.lit("AB").alias("prefix"), unit.alias("text"), F.when(F.col("req") % 7 == 4, "Open items").when(F.col("req") % 7 == 2, "Code changes").otherwise("").alias("heads"))
    cards = v.sql(_CARDS.replace("v_reqs", "{v_reqs}")).withColumn("number", F.col("number").cast("int"))
    several = F.col("req") % 7 != 4
    j = claims.judge(F.col("text"), F.col("heads"), F.col("at"), several, F.col("blanket"))
    # a mention says the same of all cards of its range
    judged = mentions.card_mentions(units).select("run", "req", "numbers", j.alias("j")).select("run", "req", "numbers", "j.claim", "j.said")
    return mentions.of_cards(judged, cards, ["run"])


_F07 = """with c as (select run, req, cast(200 + row_number() over (partition by run order by req) as int) as number, req % 6 as kind from v_reqs)
select run, number, case when kind in (0, 1, 4) then 'claimed_partial_or_open' when kind = 2 then 'claimed_done' else 'not_mentioned' end as claim, kind = 4 as listed_open, kind in (1, 2, 4) as also_done,
case when kind in (0, 4) then 'substantive' when kind = 1 then 'late_record_only' else '' end as open_kind, case when kind in (0, 4) then 'claimed_partial_or_open' when kind in (1, 2) then 'claimed_done' else 'not_mentioned' end as note_claim,
case when kind = 1 then 'claimed_partial_or_open' else 'not_mentioned' end as goal_claim, case when kind in (0, 1, 4, 5) then 'card_id' when kind = 2 then 'topic' else 'none' end as method, case when kind in (1, 4) then 2 when kind = 3 then 0 else 1 end as mentions,
case kind when 0 then 'AB-' || number || ' is pending' when 1 then '[goal] AB-' || number || ' re-runnable once the late record is not yet here' when 2 then substr('zq' || number || ' and wx' || number || ' are done ' || repeat('abc ', 80), 1, 199) || '…' when 4 then 'zq' || number || ' wx' || number || ' left' when 5 then 'source: AB-' || number else '' end as evidence
from c where number < 300"""


@query("f07_card_claims", _F07)
def f07_cards(v):
    c = v.sql("select run, req, cast(200 + row_number() over (partition by run order by req) as int) as number, req % 6 as kind from {v_reqs}").where("number < 300")
    unit = lambda where, no, form, heads="", goal=False: c.where(where).select("run", (F.col("number") * 10 + no).alias("unit"), text(form, n="number", fill="repeat('abc ', 80)").alias("text"), F.lit(heads).alias("heads"), F.lit("AB").alias("prefix"), F.lit(False).alias("is_head"), F.lit(goal).alias("is_goal"))
    parts = [
        unit("kind = 0", 0, "AB-<n> is pending"), unit("kind in (1, 4)", 0, "AB-<n> done"), unit("kind = 1", 1, "AB-<n> re-runnable once the late record is not yet here", goal=True), unit("kind = 2", 0, "zq<n> and wx<n>  are\ndone <fill>"),
        unit("kind = 3", 0, "zq<n> only, pending"), unit("kind = 4", 1, "zq<n> wx<n> left", heads="Open items"), unit("kind = 5", 0, "source: AB-<n>"), unit("kind = 5", 1, "AB-<n>", goal=True),
    ]
    units = parts[0]
    for p in parts[1:]:
        units = units.unionByName(p)
    cards = c.select("run", "number", text("the zq<n> and wx<n>", n="number").alias("topic"))
    return claims.card_claims(units, cards, ["run"]).select("run", "number", "claim", "listed_open", "also_done", "open_kind", "note_claim", "goal_claim", "method", "mentions", "evidence")


# --- H01, H02, H10: citations, reviews, diagnoses

_CITED = "select run, req, node, status, row_number() over (partition by run order by node) as n, node % 3 as kind, req % 9 as form from {v_nodes}"
_H02 = f"""with c as ({_CITED.format(v_nodes="v_nodes")})
select run, cast(node as varchar) as id, case form when 1 then 'quote not found in cited lines: ' || node when 2 then 'invalid evidence path: a/../../b' when 3 then 'invalid evidence path: /a/log.jsonl' when 4 then 'invalid line range: ' || node when 5 then 'invalid line range: ' || node when 6 then 'event ID not found in cited lines: ' || node else 'quote not found in cited lines: ' || node end as error
from c where form in (1, 2, 3, 4, 5, 7) or form = 6 and kind <> 1"""
_SOURCE = ("node <node> is\t<status>", '{"e": "E<node>", "t": ["said  <status> of <node>", {"x": 1}]}', '{"out": "{\\"msg\\": [\\"inner   <node>\\"]}"}')
_QUOTES = ("node  <node> is <status> ", "said <status> of <node>", '{"msg": ["inner <node>"]}')


def _by_kind(forms, column="kind"):
    return F.coalesce(*[F.when(F.col(column) == i, text(f)) for i, f in enumerate(forms)])


def _citations(c):
    path = F.when(F.col("form") == 2, "a/../../b").when(F.col("form") == 3, "/a/log.jsonl").when(F.col("form") == 8, "a/x/.././log.jsonl").otherwise("a/log.jsonl")
    start = F.when(F.col("form") == 4, F.col("n") + 10_000).when(F.col("form") == 8, F.lit(1)).otherwise(F.col("n"))
    end = F.when(F.col("form") == 4, F.col("n") + 10_000).when(F.col("form") == 5, F.col("n") - 1).otherwise(F.col("n"))
    quote = F.when(F.col("form") == 1, "never said").when(F.col("form") == 7, "  ").otherwise(_by_kind(_QUOTES))
    event = F.when(F.col("form") == 6, F.concat(F.lit("E"), "node")).otherwise("")
    return c.select("run", F.col("node").cast("string").alias("id"), path.alias("path"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), quote.alias("quote"), event.alias("event_id"))


def _files(c):
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", _by_kind(_SOURCE).alias("line")))), lambda x: x["line"]), "\n")
    return c.groupBy("run").agg(F.concat(body, F.lit("\n")).alias("text")).withColumn("path", F.lit("a/log.jsonl"))


@query("h02_citations", _H02)
def h02_citations(v):
    v.keep("v_nodes")
    c = v.sql(_CITED)
    return checks.check_citations(_citations(c), _files(c), ["run"])


_H10 = """with q as (select run, 'q' || req as req_id, count(*) as total, count(case when status = 'passed' then 1 end) as ok, min(node) as node from v_nodes group by run, req),
k as (select run, run % 12 as kind, (select min(req_id) from q where q.run = v_counts.run and ok < total) as lost, (select max(req_id) from q where q.run = v_counts.run) as last from v_counts)
select run, 'task identity mismatch: run_id' as error from k where kind = 1 union all select run, 'task identity mismatch: row' from k where kind = 1
union all select run, 'outcome mismatch: f2p_total' from k where kind = 2
union all select run, 'failed requirements not diagnosed: ' || lost from k where kind = 3 and lost is not null
union all select run, 'unknown requirement: x' from k where kind = 4
union all select run, 'empty chain: ' || last from k where kind = 5 union all select run, 'chain without trajectory evidence: ' || last from k where kind = 5
union all select run, 'chain without trajectory evidence: ' || last from k where kind = 6
union all select run, 'duplicate evidence IDs' from k where kind = 7 union all select run, 'unknown evidence reference: E99' from k where kind = 7
union all select run, unnest(['malformed context ref: spec', 'malformed context ref: Node:1', 'context ref to unknown requirement: req:none', 'context ref to unknown node: p2p:none']) from k where kind = 8
union all select run, 'case_paragraph must not contain evidence/context IDs; put them in case_evidence_ids' from k where kind = 9
union all select run, unnest(['case_evidence_ids is empty', 'case_paragraph too short (79 words/characters)']) from k where kind = 10
union all select run, 'quote not found in cited lines: E1' from k where kind = 11"""


@query("h10_check_diagnoses", _H10)
def h10(v):
    v.keep("v_nodes")
    v.keep("v_counts")
    kind, run = F.col("run") % 12, F.col("run")
    name = lambda lead: F.concat(F.lit(lead), "run")
    context = v.v_counts.select("run", name("t").alias("task_id"), F.lit("1").alias("task_version"), name("r").alias("run_id"), run.alias("row"), *checks.OUTCOME)
    prose = F.when(kind == 9, F.concat(F.repeat(F.lit("word "), F.lit(90)), F.lit("see E12"))).when(kind == 10, F.concat(F.repeat(F.lit("卡"), F.lit(40)), F.repeat(F.lit(" 3d_x,"), F.lit(39)))).otherwise(F.repeat(F.lit("卡 a-"), F.lit(40)))
    reports = context.withColumns(
        {
            "run_id": F.when(kind == 1, "other").otherwise(F.col("run_id")), "row": F.when(kind == 1, run + 1).otherwise(F.col("row")), "f2p_total": F.when(kind == 2, F.col("f2p_total") + 1).otherwise(F.col("f2p_total")),
            "case_paragraph": prose, "case_evidence_ids": F.when(kind == 10, F.array().cast("array<string>")).otherwise(F.array(F.lit("E1"))),
        }
    )
    reqs = v.v_nodes.groupBy("run", F.concat(F.lit("q"), "req").alias("req_id")).agg(F.count("*").alias("nodes_total"), F.count_if(F.col("status") == "passed").alias("nodes_passed"))
    of_run = reqs.groupBy("run").agg(F.min(F.when(F.col("nodes_passed") < F.col("nodes_total"), F.col("req_id"))).alias("lost"), F.max("req_id").alias("last"))
    last = F.col("req_id") == F.col("last")
    chains = reqs.join(of_run, "run").where(~((kind == 3) & F.col("req_id").eqNullSafe(F.col("lost"))))
    chains = chains.select("run", "req_id", F.when(kind == 6, "ask").otherwise("read").alias("stage"), F.when((kind == 5) & last, 0).otherwise(2).alias("steps"), (~(last & kind.isin(5, 6))).alias("proven"))
    extra = v.v_counts.where(kind == 4).select("run", F.lit("x").alias("req_id"), F.lit("infrastructure").alias("stage"), F.lit(1).alias("steps"), F.lit(False).alias("proven"))
    files = v.v_counts.select("run", F.lit("f.md").alias("path"), F.lit("one\ntwo words\n").alias("text"))
    quote = F.when(kind == 11, "three").otherwise("one two")
    evidence = v.v_counts.select("run", F.explode(F.when(kind == 7, F.array(F.lit("E1"), F.lit("E1"))).otherwise(F.array(F.lit("E1")))).alias("id"), F.lit("f.md").alias("path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), quote.alias("quote"), F.lit(None).cast("string").alias("event_id"))
    given = F.when(kind == 8, F.array(*map(F.lit, ("spec", "Node:1", "req:none", "p2p:none", "note")))).otherwise(F.array(F.lit("outcome"), F.concat(F.lit("req:"), "last"), F.lit("deferral:3")))
    known = v.v_counts.join(of_run, "run")
    refs = known.select("run", F.lit("context_refs").alias("kind"), F.explode(given).alias("ref")).unionByName(known.select("run", F.lit("evidence_ids").alias("kind"), F.explode(F.when(kind == 7, F.array(F.lit("E1"), F.lit("E99"))).otherwise(F.array(F.lit("E1")))).alias("ref")))
    nodes_of = v.v_nodes.select("run", F.col("node").cast("string").alias("node_id"))
    return checks.check_diagnoses(reports, chains.unionByName(extra), evidence, refs, files, context, reqs, nodes_of, ["run"])


_H01 = """with k as (select run, run % 12 as kind, (select count(*) from v_nodes n where n.run = v_runs.run) as total from v_runs)
select run, unnest(['task identity mismatch: task_id', 'task identity mismatch: row']) as error from k where kind = 1
union all select run, unnest(['dimension set mismatch: collaboration_dimensions', 'dimension set mismatch: strategy_dimensions']) from k where kind = 2
union all select run, unnest(['non-observed dimension has a score: search_strategy', 'scored dimension lacks evidence: causal_debugging']) from k where kind = 3
union all select run, 'empty evidence or duplicate IDs' from k where kind in (4, 5) union all select run, 'unknown evidence reference: E1' from k where kind = 4
union all select run, 'invalid evidence path: f/../..' from k where kind = 6
union all select run, 'unknown evidence reference: E7' from k where kind = 7
union all select run, unnest(['coverage total_actions mismatch', 'full coverage claimed without all actions']) from k where kind = 8 and total > 0
union all select run, unnest(['invalid examined action count', 'full coverage claimed without all actions']) from k where kind = 9 and total > 0
union all select run, 'invalid examined file: g.md' from k where kind = 10"""


@query("h01_review_rules", _H01)
def h01_rules(v):
    kind, run = F.col("run") % 12, F.col("run")
    counted = v.v_runs.select("run").join(v.v_nodes.groupBy("run").agg(F.count("*").alias("actions")), "run", "left")
    source = counted.select("run", F.concat(F.lit("t"), "run").alias("task_id"), F.lit("1").alias("task_version"), F.concat(F.lit("r"), "run").alias("run_id"), run.alias("row"), "actions")
    total = F.coalesce("actions", F.lit(0))
    reports = source.select(
        "run", F.when(kind == 1, "t").otherwise(F.col("task_id")).alias("task_id"), "task_version", "run_id", F.when(kind == 1, run - 1).otherwise(run).alias("row"),
        F.when(kind == 8, total + 1).otherwise(total).alias("total_actions"), F.when(kind == 9, total + 1).when(kind == 8, total - 1).otherwise(total).alias("examined_actions"), F.lit(True).alias("fully_examined"),
    )
    ids = [(f, i) for f, group in rules.DIMENSIONS.items() for i in group]
    all_dims = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("id")) for f, i in ids])
    # one dimension is left out, another one stands twice
    dims = v.v_runs.select("run", F.inline(F.when(kind == 2, F.concat(F.slice(all_dims, 2, len(ids) - 1), F.slice(all_dims, len(ids), 1))).otherwise(all_dims)))
    odd = (kind == 3) & (F.col("id") == "search_strategy")
    dims = dims.select("run", "field", "id", F.when(odd, "not_observed").otherwise("observed").alias("observation_status"), F.lit(2).alias("score"), F.when((kind == 3) & (F.col("id") == "causal_debugging"), 0).otherwise(1).alias("n_evidence"))
    cited = F.when(kind == 4, F.array().cast("array<string>")).when(kind == 5, F.array(F.lit("E1"), F.lit("E1"))).otherwise(F.array(F.lit("E1")))
    evidence = v.v_runs.select("run", F.explode(cited).alias("id"), F.when(kind == 6, "f/../..").otherwise("f.md").alias("path"), F.lit(2).alias("line_start"), F.lit(2).alias("line_end"), F.lit("two words").alias("quote"), F.lit("ev-1").alias("event_id"))
    files = v.v_runs.select("run", F.lit("f.md").alias("path"), F.lit('one\r\n{"a": ["two  words"], "id": "ev-1"}').alias("text"))
    refs = v.v_runs.select("run", F.when(kind == 7, "E7").otherwise("E1").alias("ref"))
    examined = v.v_runs.select("run", F.when(kind == 10, "g.md").otherwise("./f.md").alias("path"))
    return checks.check_reviews(reports, dims, evidence, refs, files, examined, source, ["run"])


# --- A13, C11, K06: wide rows

_A13 = """with e as (select run, count(*) as lines, count(case when tool <> 'view' then 1 end) as evidence, count(distinct args) as sessions, count(case when tool = 'signup' then 1 end) as init_segments from v_actions group by run),
t as (select run, string_agg(tool || ':' || n, ',' order by tool) as event_types from (select run, tool, count(*) as n from v_actions group by run, tool) g group by run),
r as (select run, action, (select count(*) from v_actions b where b.run = a.run and b.args = a.args and b.action > a.action and b.is_error) as n_results, action % 3 as n_replays from v_actions a where is_ask),
c as (select run, count(*) as calls, count(case when n_results = 0 then 1 end) as without_result, cast(sum(n_replays) as bigint) as replays from r group by run),
s as (select run, count(*) as results, count(case when action % 4 = 1 then 1 end) as repeat_results, count(case when action % 4 = 2 then 1 end) as orphans from v_actions where is_error group by run),
x as (select run, count(*) as exposures, count(distinct text) as messages from v_turns group by run)
select v.run, coalesce(lines, 0) as lines, coalesce(evidence, 0) as evidence, coalesce(sessions, 0) as sessions, coalesce(init_segments, 0) as init_segments, coalesce(calls, 0) as calls, coalesce(without_result, 0) as without_result, coalesce(replays, 0) as replays,
coalesce(results, 0) as results, coalesce(repeat_results, 0) as repeat_results, coalesce(orphans, 0) as orphans, coalesce(exposures, 0) as exposures, coalesce(messages, 0) as messages, coalesce(event_types, '') as event_types
from v_runs v left join e using (run) left join t using (run) left join c using (run) left join s using (run) left join x using (run)"""


@query("a13_inventory", _A13)
def a13_inventory(v):
    a = v.v_actions
    events = a.select("run", F.col("tool").alias("type"), F.col("args").alias("session"), (F.col("tool") == "signup").alias("is_init"), (F.col("tool") != "view").alias("is_kept"))
    asked = a.where("is_ask").select("run", "args", "action")
    after = asked.hint("merge").join(a.where("is_error").select("run", "args", F.col("action").alias("later")), ["run", "args"]).where("later > action").groupBy("run", "action").agg(F.count("*").alias("n"))
    calls = asked.hint("merge").join(after, ["run", "action"], "left").select("run", F.coalesce("n", F.lit(0)).alias("n_results"), (F.col("action") % 3).alias("n_replays"))
    status = F.when(F.col("action") % 4 == 1, "repeat_result").when(F.col("action") % 4 == 2, "orphan").otherwise("result")
    return wide.input_counts(v.v_runs, events, calls, a.where("is_error").select("run", status.alias("status")), v.v_turns.select("run", F.col("text").alias("message")), ["run"])


_C11 = """with q as (select run, count(*) as asks, count(case when action % 2 = 0 then 1 end) as asks_returned, count(case when action % 3 = 0 then 1 end) as asks_linked, count(case when action % 5 = 0 then 1 end) as asks_with_fact from v_actions where is_ask group by run),
t as (select run, count(*) as questions, count(case when turn % 2 = 0 then 1 end) as questions_linked, count(case when turn % 4 = 0 then 1 end) as questions_linked_by_text, count(case when turn % 3 = 0 then 1 end) as replies_visible, cast(sum(turn % 2) as bigint) as defer_items, cast(sum(turn % 3) as bigint) as clarify_items from v_turns where role = 'user' group by run),
f as (select run, count(*) as facts, count(distinct ord1) as distinct_facts, count(case when status = 'passed' then 1 end) as facts_committed, count(case when ord2 % 2 = 0 then 1 end) as facts_repeated, count(case when ord2 % 3 = 0 then 1 end) as facts_linked, count(case when node_class = 'f2p' then 1 end) as facts_visible, count(case when status = 'passed' and node_class = 'f2p' then 1 end) as facts_committed_visible from v_records group by run),
a as (select run, count(*) as availability_events, count(case when is_error then 1 end) as availability_linked, count(case when tool = 'click' and action % 2 = 0 then 1 end) as availability_first_defers from v_actions where not is_ask group by run),
n as (select run, count(*) as notifications, count(case when disclosure = 'obtained' then 1 end) as notifications_released, count(case when disclosure <> 'not_disclosed' then 1 end) as notifications_read, count(case when holder = 'public' then 1 end) as notifications_mentioned, count(case when req % 2 = 0 then 1 end) as notifications_with_card from v_reqs group by run),
u as (select run, count(*) as released_unmatched from v_nodes where status = 'failed' group by run), b as (select run, count(*) as unbound_failures from v_asks where req is null group by run),
j as (select v.run, v.run % 3 <> 0 as has_sidecar, q.*, t.*, f.*, a.*, n.*, u.*, b.* from v_runs v left join q on q.run = v.run left join t on t.run = v.run left join f on f.run = v.run left join a on a.run = v.run left join n on n.run = v.run left join u on u.run = v.run left join b on b.run = v.run)
select run, has_sidecar, """
_ALWAYS = ("asks", "asks_returned", "notifications", "notifications_read", "notifications_mentioned", "notifications_with_card")
_C11 += ", ".join([f"coalesce({c}, 0) as {c}" for c in _ALWAYS] + [f"case when has_sidecar then coalesce({c}, 0) end as {c}" for c in wide.SIDECAR_ONLY]) + " from j"


@query("c11_coverage", _C11)
def c11_coverage(v):
    flag = lambda name, cond: F.expr(cond).alias(name)
    asks = v.v_actions.where("is_ask").select("run", flag("returned", "action % 2 = 0"), flag("linked", "action % 3 = 0"), flag("declared", "case when action % 5 = 0 then true end"))
    questions = v.v_turns.where("role = 'user'").select("run", flag("linked", "turn % 2 = 0"), flag("by_text", "turn % 4 = 0"), flag("visible", "turn % 3 = 0"), flag("defers", "turn % 2"), flag("clarifies", "turn % 3"))
    facts = v.v_records.select("run", F.col("ord1").alias("fact"), flag("committed", "status = 'passed'"), flag("is_first", "ord2 % 2 <> 0"), flag("linked", "ord2 % 3 = 0"), flag("visible", "node_class = 'f2p'"))
    availability = v.v_actions.where("not is_ask").select("run", flag("event", "case tool when 'click' then 'availability_deferred' else 'other' end"), flag("first_defer", "action % 2 = 0"), flag("linked", "is_error"))
    notifications = v.v_reqs.select("run", flag("released", "disclosure = 'obtained'"), flag("read", "disclosure <> 'not_disclosed'"), flag("mentioned", "holder = 'public'"), flag("with_card", "req % 2 = 0"))
    runs = v.v_runs.select("run", flag("has_sidecar", "run % 3 <> 0"))
    return wide.comm_coverage(runs, asks, questions, facts, availability, notifications, v.v_nodes.where("status = 'failed'"), v.v_asks.where("req is null"), ["run"])


_STATES = ("obtained", "returned_not_visible", "asked_owner_about_card", "asked_wrong_person_about_card", "contacted_owner_not_card", "owner_never_contacted", "public")
_PICK = lambda names, of: f"case cast({of} as bigint) % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"
_CLAIMS = _PICK(("claimed_done", "claimed_partial_or_open", "not_mentioned"), "req")
_STAGES = _PICK(("discovery", "ask", "read", "implement", "none"), "node")
_KINDS = _PICK(("test", "production", "doc"), "turn")
_K06 = f"""with q as (select r.run, r.req, holder, {_PICK(_STATES, "r.req")} as state, {_CLAIMS.replace("req", "r.req")} as claim, count(node) as n, count(case when status = 'passed' then 1 end) as ok from v_reqs r left join v_nodes x on x.run = r.run and x.req = r.req group by r.run, r.req, holder),
a as (select run, count(case when h then 1 end) as colleague_held, count(case when h and state in ('obtained', 'returned_not_visible') then 1 end) as obtained, count(case when h and state like 'asked%' then 1 end) as card_raised_not_disclosed, count(case when h and state = 'contacted_owner_not_card' then 1 end) as owner_contacted_card_not_raised, count(case when h and state = 'owner_never_contacted' then 1 end) as owner_never_contacted,
count(case when claim = 'claimed_done' then 1 end) as claimed_done, count(case when claim = 'claimed_done' and ok < n then 1 end) as claimed_done_failed, count(case when claim like '%open' then 1 end) as listed_open, count(case when claim = 'not_mentioned' then 1 end) as not_mentioned from (select *, holder <> 'public' and state <> 'public' as h from q) g group by run),
n as (select run, count(case when f then 1 end) as f2p_failed, count(case when node_class = 'p2p' and status = 'failed' then 1 end) as p2p_failed, count(case when f and s = 'discovery' then 1 end) as lost_discovery, count(case when f and s = 'ask' then 1 end) as lost_ask, count(case when f and s = 'read' then 1 end) as lost_read, count(case when f and s = 'implement' then 1 end) as lost_implement from (select *, node_class = 'f2p' and status = 'failed' as f, {_STAGES} as s from v_nodes) g group by run),
d as (select run, count(*) as deferral_threads, count(case when req % 2 = 0 then 1 end) as deferrals_abandoned from v_reqs where disclosure = 'not_disclosed' group by run),
p as (select run, count(*) as patch_files, cast(sum(turn * 2) as bigint) as patch_added, cast(sum(turn % 4) as bigint) as patch_removed, count(case when k = 'test' and role <> 'user' and turn % 4 > 0 then 1 end) as test_files_cut from (select *, {_KINDS} as k from v_turns) g group by run),
e as (select run, cast(max(end_us) - min(start_us) as bigint) as wall_us, count(*) as tool_calls from v_actions group by run)
select v.run, v.domain, c.f2p_passed, c.f2p_total, c.p2p_passed, c.p2p_total, c.f2p_passed = c.f2p_total and c.p2p_passed = c.p2p_total as strict, """
_ZERO = ("colleague_held", "obtained", "card_raised_not_disclosed", "owner_contacted_card_not_raised", "owner_never_contacted", "claimed_done", "claimed_done_failed", "listed_open", "not_mentioned", "f2p_failed", "p2p_failed", "lost_discovery", "lost_ask", "lost_read", "lost_implement", "deferral_threads", "deferrals_abandoned", "patch_files", "patch_added", "patch_removed", "test_files_cut")
_K06 += ", ".join(f"coalesce({c}, 0) as {c}" for c in _ZERO) + ", wall_us, tool_calls from v_counts c join v_runs v using (run) left join a using (run) left join n using (run) left join d using (run) left join p using (run) left join e using (run)"


@query("k06_dossier", _K06)
def k06_dossier(v):
    of_req = v.v_nodes.groupBy("run", "req").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("status") == "passed").alias("passed"))
    reqs = v.v_reqs.join(of_req, ["run", "req"], "left").select("run", "holder", F.expr(_PICK(_STATES, "req")).alias("acquisition"), F.expr(_CLAIMS).alias("claim"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("passed", F.lit(0)).alias("passed"))
    nodes_of = v.v_nodes.select("run", "node_class", "status", F.expr(_STAGES).alias("loss_stage"))
    threads = v.v_reqs.where("disclosure = 'not_disclosed'").select("run", F.expr("req % 2 <> 0").alias("followed"))
    patches = v.v_turns.select("run", F.expr(_KINDS).alias("kind"), F.when(F.col("role") == "user", "added").otherwise("modified").alias("status"), (F.col("turn") * 2).alias("added"), (F.col("turn") % 4).alias("removed"))
    effort = v.v_actions.groupBy("run").agg((F.max("end_us") - F.min("start_us")).alias("wall_us"), F.count("*").alias("tool_calls"))
    runs = v.v_counts.join(v.v_runs.select("run", "domain"), "run").select("run", "domain", "f2p_passed", "f2p_total", "p2p_passed", "p2p_total")
    return wide.run_dossier(runs, reqs, nodes_of, threads, patches, [effort], ["run"])


# --- C04, C08: links of disclosures and notifications

_C04 = """with q as (select run, args as question, any_value(action) as action, count(*) as n from v_actions where is_ask group by run, args),
x as (select run, text as message, min(turn) as first_visible, min(case when role = 'user' then turn end) as first_read from (select run, turn, role, 'm' || (turn % 4) as text from v_turns) t group by run, text)
select a.run, a.tool as fact, a.args as question, 'm' || (action_id % 6) as reply, action_id as place, row_number() over (partition by a.run, a.tool order by action_id) as ordinal, row_number() over (partition by a.run, a.tool order by action_id) = 1 as is_first,
q.action, case when q.action is not null then 'm' || (q.action % 3) = 'm' || (action_id % 6) end as reply_agrees, x.first_visible is not null as visible, x.first_visible, x.first_read
from (select *, action as action_id from v_actions where not is_ask) a left join q on q.run = a.run and q.question = a.args and q.n = 1 left join x on x.run = a.run and x.message = 'm' || (action_id % 6)"""


@query("c04_linked_disclosures", _C04)
def c04_linked(v):
    name = lambda c, n: F.concat(F.lit("m"), F.col(c) % n)
    facts = v.v_actions.where("not is_ask").select("run", F.col("tool").alias("fact"), F.col("args").alias("question"), name("action", 6).alias("reply"), F.col("action").alias("place"))
    questions = v.v_actions.where("is_ask").select("run", F.col("args").alias("question"), name("action", 3).alias("reply"), "action")
    exposures = v.v_turns.select("run", name("turn", 4).alias("message"), F.col("turn").alias("place"), (F.col("role") == "user").alias("is_read"))
    return comms.linked_disclosures(facts, questions, exposures, ["run"]).withColumn("ordinal", F.col("ordinal").cast("bigint"))


_C08 = """with e as (select run, ord1 as k, ord2 as place, status = 'passed' as is_read from v_records where node_class = 'f2p'),
m as (select run, k, count(*) as occurrences, min(place) as first_seen, min(case when is_read then place end) as first_read from e group by run, k),
r as (select run, ord1 as k, count(*) as releases, any_value(node) as release from v_records where node_class = 'p2p' or ord1 % 2 = 0 group by run, ord1),
a as (select run, node || '-' || ord1 || '-' || ord2 as action, ord1 as k, ord2 as place, req % 5 as form from v_records),
h as (select m.run, m.k, count(distinct case when form in (0, 1) then action end) as mentions, count(distinct case when form in (1, 2) then action end) as with_card from m join a on a.run = m.run and a.k = m.k and a.place > m.first_seen group by m.run, m.k)
select m.run, 'runtime-D' || m.k || '-7' as message, 'D' || m.k as delivery, coalesce(releases, 0) as releases, case when releases = 1 then release end as release, occurrences, first_seen, first_read, 1 as cards, coalesce(mentions, 0) as mentions, coalesce(with_card, 0) as with_card
from m left join r on r.run = m.run and r.k = m.k left join h on h.run = m.run and h.k = m.k"""


@query("c08_notification_links", _C08)
def c08_links(v):
    card = {"h": "ord1 div 900000", "n": "100000 + ord1 % 900000"}  # six digits, the most of a card
    # numbers move, and texts are made of them there
    v.keep("v_records", "run", "req", "node", "node_class", "status", "ord1", "ord2")
    records = relational.dealt(v.v_records, ["run"])
    shown = lambda message, is_read, said: F.struct(message.alias("message"), F.col("ord2").alias("place"), is_read.alias("is_read"), said.alias("text"))
    own = shown(text("runtime-D<ord1>-7"), F.col("status") == "passed", text("see CARD_<h>-<n>, not DOC-12 or MR-77 (xCARD-13)", **card))
    exposures = records.where("node_class = 'f2p'").select("run", F.inline(F.array(own, shown(text("other-D<ord1>-7"), F.lit(True), F.lit("CARD-12")))))
    freed = records.where("node_class = 'p2p' or ord1 % 2 = 0").select("run", text("D<ord1>").alias("delivery"), F.col("node").alias("release"))
    forms = ('{"id": "runtime-D<ord1>-7"}', "re: runtime-D<ord1>-7-x and a-CARD_<h>-<n>-b", "CARD_<h>-<n>", "xruntime-D<ord1>-7 CARD_<h>-<n>0", "runtime-D<ord1>-75, _CARD_<h>-<n>")
    said = F.coalesce(*[F.when(F.col("req") % 5 == i, text(f, **card)) for i, f in enumerate(forms)])
    actions = records.select("run", F.concat_ws("-", "node", "ord1", "ord2").alias("action"), F.col("ord2").alias("place"), said.alias("input"))
    return v.written_in_place(comms.notification_links(exposures, freed, actions, ["run"]), "links")


# --- D12, D13: which file tells of the nodes

_PATHS = (
    ("x/ctrf.json", 0), ("ctrf.json", 0), ("a/ctrf.jsonl", 1), ("private-runtime/a.json", 5), ("a/private-runtime/ctrf.json", 0), ("v/reward.json", 3), ("v/source-rewards.jsonl", 3), ("v/adapter-1.json", 3), ("v/my-reward.json", 1), ("v/a.jsonl", 1),
    ("test-stdout.log", 2), ("v/test-stdout.log", 2), ("v/my-test-stdout.log", 4), ("a.txt", 4), ("a.out", 4), ("a.csv", 6), ("v/artifacts/a.json", None), ("artifacts/a.json", 1), ("reward/x.json", 1), ("a.json.bak", 6),
)
_RANK = " ".join(f"when {i} then {'null' if r is None else r}" for i, (_, r) in enumerate(_PATHS))


@query("d12_evidence_order", f"select node, case when req % 9 = 0 then null else case cast(node as bigint) % {len(_PATHS)} {_RANK} end end as priority from v_nodes")
def d12_order(v):
    path = F.array(*[F.lit(p) for p, _ in _PATHS])[(F.col("node") % len(_PATHS)).cast("int")]
    size = F.when(F.col("req") % 9 == 0, 80_000_000).otherwise(79_999_999)
    return v.v_nodes.select("node", nodes.candidate_rank(path, size).alias("priority"))


_D13 = """with t as (select run, count(*) as total, count(case when node_class = 'f2p' and status = 'passed' then 1 end) as f, count(case when node_class = 'p2p' and status = 'passed' then 1 end) as p, count(case when status = 'passed' then 1 end) as ok, count(case when node % 2 = 0 or status = 'passed' then 1 end) as half from v_nodes group by run)
select run, case when run % 3 = 0 then 'plain' when run % 3 = 1 and half = total then 'half' when run % 3 = 1 then 'numbers' when half >= 0.5 * total then 'half' end as candidate, round(case when run % 3 < 2 then 1.0 when half >= 0.5 * total then half / total end, 6) as coverage, run % 3 < 2 or half >= 0.5 * total as resolved from t"""


@query("d13_prefer_plain", _D13)
def d13_plain(v):
    n = v.v_nodes.select("run", "node", "node_class", "status")
    of = lambda d, name, priority, numbers: d.select("*", F.lit(name).alias("candidate"), F.lit(priority).alias("priority"), F.lit(numbers).alias("numbers"))
    # all nodes by name, all by number from a better file, and in some runs a part of them
    some = n.where("run % 3 > 0 and (node % 2 = 0 or status = 'passed')")
    parts = [of(n.where("run % 3 = 0"), "plain", 4, False), of(n.where("run % 3 < 2"), "numbers", 0, True), of(some, "half", 2, False)]
    found = nodes.reconcile(parts[0].unionByName(parts[1]).unionByName(parts[2]), v.v_counts.select("run", "f2p_passed", "p2p_passed", "total"), ["run"])
    return r6(found, "coverage")


# --- K04, K05: wide rows of requirements and nodes

_LOSS = f"case when status = 'failed' and node % 7 > 0 then {_STAGES} end"
_K04 = f"""with n as (select run, req, count(*) as nodes, count(case when status = 'passed' then 1 end) as passed from v_nodes group by run, req),
l as (select run, req, string_agg(s || ':' || n, ',' order by s) as loss from (select run, req, s, count(*) as n from (select *, {_LOSS} as s from v_nodes) t where s is not null group by run, req, s) g group by run, req),
d as (select run, 'C-' || turn % 9 as card, case when count(case when turn % 2 = 0 then 1 end) > 0 then 'abandoned' else 'followed' end as deferral from v_turns where role = 'user' group by run, turn % 9)
select r.run, r.req, 'C-' || r.req % 9 as card, holder, coalesce(nodes, 0) as nodes, coalesce(passed, 0) as passed, coalesce(loss, '') as loss, case when r.req % 4 = 0 then '' else {_CLAIMS.replace("req", "r.req")} end as claim, case when r.req % 4 = 0 then '' else 'said ' || r.req end as note_excerpt,
case when r.req % 5 = 0 then '' else disclosure end as claim_broad, coalesce(deferral, '') as deferral from v_reqs r left join n on n.run = r.run and n.req = r.req left join l on l.run = r.run and l.req = r.req left join d on d.run = r.run and d.card = 'C-' || r.req % 9"""


@query("k04_requirement_dossier", _K04)
def k04_dossier(v):
    reqs = v.v_reqs.select("run", "req", text("C-<n>", n="req % 9").alias("card"), "holder")
    nodes_of = v.v_nodes.select("run", "req", "status", F.expr(_LOSS).alias("loss_stage"))
    told = v.v_reqs.where("req % 4 <> 0").select("run", "req", F.expr(_CLAIMS).alias("claim"), text("said <req>").alias("evidence"))
    broad = v.v_reqs.where("req % 5 <> 0").select("run", "req", F.col("disclosure").alias("claim"))
    threads = v.v_turns.where("role = 'user'").select("run", text("C-<n>", n="turn % 9").alias("card"), F.expr("turn % 2 <> 0").alias("followed"))
    return wide.requirement_dossier(reqs, nodes_of, told, broad, threads, ["run"])


_K05 = f"""select run, node, node_class, st as status, case when st = 'failed' then 'c' || node % 3 end as failure_class, case when node_class = 'f2p' and node % 5 > 0 then 'q' || req end as req_ids, case when node_class = 'f2p' and node % 5 > 0 then {_LOSS.replace("status", "st")} end as loss_stage,
case when st = 'failed' and node % 3 = 0 then 'lost ' || node else '' end as grader_message from (select *, case when req % 6 = 0 then 'unresolved' else status end as st from v_nodes) t"""


@query("k05_node_dossier", _K05)
def k05_dossier(v):
    n = v.v_nodes.withColumn("status", F.when(F.col("req") % 6 == 0, "unresolved").otherwise(F.col("status")))
    nodes_of = n.select("run", "node", "node_class", "status", F.when(F.col("status") == "failed", text("c<k>", k="node % 3")).alias("failure_class"))
    links = n.where("node % 5 > 0").select("run", "node", text("q<req>").alias("req_ids"), F.expr(_LOSS).alias("loss_stage"))
    return wide.node_dossier(nodes_of, links, v.v_nodes.where("node % 3 = 0").select("run", "node", text("lost <node>").alias("output")), ["run"])
