"""Wide rows of runs, requirements and nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.operators.comms import null_without

#: What of a run's coverage is told by its sidecar alone.
SIDECAR_ONLY = (
    "asks_linked", "asks_with_fact", "questions", "questions_linked", "questions_linked_by_text", "replies_visible", "facts", "distinct_facts", "facts_committed", "facts_repeated", "facts_linked", "facts_visible", "facts_committed_visible",
    "availability_events", "availability_linked", "availability_first_defers", "defer_items", "clarify_items", "notifications_released", "released_unmatched", "unbound_failures",
)


def _counts(df: DataFrame, by: list[str], **named: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in named.items()])


def _beside(runs: DataFrame, tables: list[DataFrame], by: list[str], blank: tuple[str, ...] = ()) -> DataFrame:
    """Every run with the counts of each table, 0 where it has no row there; the columns of ``blank`` stay null."""
    kept = set(runs.columns)
    out = reduce(lambda a, t: a.hint("merge").join(t, by, "left"), tables, runs)
    return out.select(*[F.col(c) if c in kept or c in blank else F.coalesce(c, F.lit(0)).alias(c) for c in out.columns])


def input_counts(runs: DataFrame, events: DataFrame, calls: DataFrame, results: DataFrame, exposures: DataFrame, by: list[str]) -> DataFrame:
    """What was read of each run.

    events: by, type, session, is_init, is_kept (evidence, not a heartbeat).
    calls: by, n_results, n_replays. results: by, status (as pair_results
    gives it). exposures: by, message. event_types: the types with their
    numbers, by name.
    """
    one = F.count("*")
    lines = _counts(events, by, lines=one, evidence=F.count_if("is_kept"), sessions=F.count_distinct("session"), init_segments=F.count_if("is_init"))
    made = _counts(calls, by, calls=one, without_result=F.count_if(F.col("n_results") == 0), replays=F.sum("n_replays"))
    got = _counts(results, by, results=one, repeat_results=F.count_if(F.col("status") == "repeat_result"), orphans=F.count_if(F.col("status") == "orphan"))
    seen = _counts(exposures, by, exposures=one, messages=F.count_distinct("message"))
    of_type = events.groupBy(*by, "type").agg(one.alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws(":", x["type"], x["n"])), ",")
    out = _beside(runs.select(*by), [lines, made, got, seen, _counts(of_type, by, event_types=shown)], by, ("event_types",))
    return out.withColumn("event_types", F.coalesce("event_types", F.lit("")))


def comm_coverage(runs: DataFrame, asks: DataFrame, questions: DataFrame, facts: DataFrame, availability: DataFrame, notifications: DataFrame, unmatched: DataFrame, unbound: DataFrame, by: list[str]) -> DataFrame:
    """C11: how far a run's asks, questions, facts and notifications are linked; what only a sidecar tells is null, not 0, without one.

    runs: by, has_sidecar. asks: by, returned, linked, declared. questions: by,
    linked, by_text, visible, defers, clarifies. facts: by, fact, committed,
    is_first, linked, visible. availability: by, event, first_defer, linked.
    notifications: by, released, read, mentioned, with_card. unmatched and
    unbound: by, a row for each released message that was never seen, and for
    each failure without an ask. A flag that is null counts as false.
    """
    one, both = F.count("*"), F.col("committed") & F.col("visible")
    tables = [
        _counts(asks, by, asks=one, asks_returned=F.count_if("returned"), asks_linked=F.count_if("linked"), asks_with_fact=F.count_if("declared")),
        _counts(questions, by, questions=one, questions_linked=F.count_if("linked"), questions_linked_by_text=F.count_if("by_text"), replies_visible=F.count_if("visible"), defer_items=F.sum("defers"), clarify_items=F.sum("clarifies")),
        _counts(facts, by, facts=one, distinct_facts=F.count_distinct("fact"), facts_committed=F.count_if("committed"), facts_repeated=F.count_if(~F.col("is_first")), facts_linked=F.count_if("linked"), facts_visible=F.count_if("visible"), facts_committed_visible=F.count_if(both)),
        _counts(availability, by, availability_events=one, availability_linked=F.count_if("linked"), availability_first_defers=F.count_if((F.col("event") == "availability_deferred") & F.col("first_defer"))),
        _counts(notifications, by, notifications=one, notifications_released=F.count_if("released"), notifications_read=F.count_if("read"), notifications_mentioned=F.count_if("mentioned"), notifications_with_card=F.count_if("with_card")),
        _counts(unmatched, by, released_unmatched=one), _counts(unbound, by, unbound_failures=one),
    ]
    return null_without(_beside(runs.select(*by, "has_sidecar"), tables, by), "has_sidecar", list(SIDECAR_ONLY))


def run_dossier(runs: DataFrame, reqs: DataFrame, nodes: DataFrame, threads: DataFrame, patches: DataFrame, others: list[DataFrame], by: list[str]) -> DataFrame:
    """The wide row of a run: its own columns, outcome, acquisition, losses, claims, deferrals, patch, and the columns of other tables with a row per run.

    runs: by, f2p_passed, f2p_total, p2p_passed, p2p_total and more. reqs: by,
    holder, acquisition, claim, n_nodes, passed. nodes: by, node_class, status,
    loss_stage. threads: by, followed. patches: by, kind, status, added,
    removed. Counts are 0 where a run has no row; the others' columns stay null.
    """
    held = (F.col("holder") != "public") & (F.col("acquisition") != "public")
    got = lambda *states: F.count_if(held & F.col("acquisition").isin(*states))
    claim = lambda c: F.count_if(F.col("claim") == c)
    open_ = F.col("status") != "passed"
    f2p = (F.col("node_class") == "f2p") & open_
    tables = [
        _counts(
            reqs, by, colleague_held=F.count_if(held), obtained=got("obtained", "returned_not_visible"), card_raised_not_disclosed=got("asked_owner_about_card", "asked_wrong_person_about_card"), owner_contacted_card_not_raised=got("contacted_owner_not_card"), owner_never_contacted=got("owner_never_contacted"),
            claimed_done=claim("claimed_done"), claimed_done_failed=F.count_if((F.col("claim") == "claimed_done") & (F.col("n_nodes") > 0) & (F.col("passed") < F.col("n_nodes"))), listed_open=claim("claimed_partial_or_open"), not_mentioned=claim("not_mentioned"),
        ),
        _counts(nodes, by, f2p_failed=F.count_if(f2p), p2p_failed=F.count_if((F.col("node_class") == "p2p") & open_), **{f"lost_{s}": F.count_if(f2p & (F.col("loss_stage") == s)) for s in rules.LOSS_STAGES}),
        _counts(threads, by, deferral_threads=F.count("*"), deferrals_abandoned=F.count_if(~F.col("followed"))),
        _counts(patches, by, patch_files=F.count("*"), patch_added=F.sum("added"), patch_removed=F.sum("removed"), test_files_cut=F.count_if((F.col("kind") == "test") & (F.col("status") != "added") & (F.col("removed") > 0))),
    ]
    blank = tuple(c for t in others for c in t.columns if c not in by)
    strict = (F.col("f2p_passed") == F.col("f2p_total")) & (F.col("p2p_passed") == F.col("p2p_total"))
    return _beside(runs.withColumn("strict", strict), [*tables, *others], by, blank)


def requirement_dossier(reqs: DataFrame, nodes: DataFrame, claims: DataFrame, broad: DataFrame, threads: DataFrame, by: list[str]) -> DataFrame:
    """The wide row of a requirement: its own columns, nodes, passed, losses by stage, both claims with the note's words, and what became of its deferrals.

    reqs: by, req, card and more. nodes: by, req, status, loss_stage, a row for
    each requirement of a node. claims: by, req, claim, evidence. broad: by,
    req, claim. threads: by, card, followed. loss: ``stage:n``, by name. Texts
    are empty, not null, where nothing is known.
    """
    key = [*by, "req"]
    of_node = _counts(nodes, key, nodes=F.count("*"), passed=F.count_if(F.col("status") == "passed"))
    stages = nodes.where("loss_stage <> ''").groupBy(*key, "loss_stage").agg(F.count("*").alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loss_stage", "n"))), lambda x: F.concat_ws(":", x["loss_stage"], x["n"])), ",")
    deferred = _counts(threads, [*by, "card"], deferral=F.when(F.bool_or(~F.col("followed")), "abandoned").otherwise("followed"))
    said = claims.select(*key, "claim", F.col("evidence").alias("note_excerpt")).hint("merge").join(broad.select(*key, F.col("claim").alias("claim_broad")), key, "full")
    out = _beside(reqs, [of_node, _counts(stages, key, loss=shown), said], key, ("loss", "claim", "note_excerpt", "claim_broad"))
    out = out.hint("merge").join(deferred, [*by, "card"], "left")
    return out.fillna("", ["loss", "claim", "note_excerpt", "claim_broad", "deferral"])


def node_dossier(nodes: DataFrame, links: DataFrame, graders: DataFrame, by: list[str]) -> DataFrame:
    """The wide row of a node: status and failure class, the columns of its links if it is an f2p node, and the graders' words if it failed.

    nodes: by, node, node_class, status, failure_class. links: by, node and
    more (requirements, information state, stage of the loss). graders: by,
    node, output.
    """
    key = [*by, "node"]
    more = [c for c in links.columns if c not in key]
    out = nodes.hint("merge").join(links, key, "left").hint("merge").join(graders.select(*key, "output"), key, "left")
    own = [F.when(F.col("node_class") == "f2p", F.col(c)).alias(c) for c in more]
    told = F.when(~F.col("status").isin("passed", "unresolved"), F.col("output"))
    return out.select(*nodes.columns, *own, F.coalesce(told, F.lit("")).alias("grader_message"))
