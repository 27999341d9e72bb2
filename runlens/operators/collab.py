"""E: acquisition of requirements, collaboration measures, attribution of losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules

PUBLIC = "public"


def held_requirements(reqs: DataFrame) -> DataFrame:
    """Requirements that a colleague holds."""
    return reqs.where(F.col("holder") != PUBLIC)


def card_mentions(texts: DataFrame, keep: list[str], text: str, pattern: str) -> DataFrame:
    """The distinct tokens of a text that match a card pattern, one row each."""
    return texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("card"))


def acquisition_state(reqs: DataFrame, asks: DataFrame) -> DataFrame:
    """For each held requirement the first state that holds, and its question counts.

    reqs: run, req, holder, disclosure (obtained, returned_not_visible or other).
    asks: run, recipient, req (the requirement that the question names, or null).
    """
    named = asks.where("req is not null").groupBy("run", "req").agg(F.count("*").alias("n_named"), F.collect_set("recipient").alias("asked"))
    owner = asks.groupBy("run", F.col("recipient").alias("holder")).agg(F.count("*").alias("n_owner"))
    j = held_requirements(reqs).join(named, ["run", "req"], "left").join(owner, ["run", "holder"], "left")
    to_owner = F.coalesce(F.array_contains("asked", F.col("holder")), F.lit(False))
    state = (
        F.when(F.col("disclosure").isin("obtained", "returned_not_visible"), F.col("disclosure"))
        .when(to_owner, "asked_owner_about_card").when(F.col("n_named") > 0, "asked_wrong_person_about_card")
        .when(F.col("n_owner") > 0, "contacted_owner_not_card").otherwise("owner_never_contacted")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("run", "req", "holder", state.alias("state"), to_owner.alias("asked_owner"), zero("n_named"), zero("n_owner"))


def collab_run_metrics(states: DataFrame) -> DataFrame:
    """Shares of held requirements that were asked for, obtained and visible, of those asked for that were obtained, and of those obtained that stayed unread, per run."""
    got = F.col("state").isin("obtained", "returned_not_visible")
    out = states.groupBy("run").agg(F.count("*").alias("held"), F.count_if(got | F.col("asked_owner")).alias("asked"), F.count_if(got).alias("got"), F.count_if(F.col("state") == "obtained").alias("visible"), F.sum("n_owner").alias("questions"))
    share = lambda n, d, name: F.try_divide(n, d).alias(name)
    return out.select("run", "held", "asked", "got", "visible", share("asked", "held", "ask_rate"), share("got", "held", "obtained_rate"), share("visible", "got", "visible_rate"), share("got", "questions", "gain_per_q"), share("got", "asked", "followthrough"), F.try_divide(F.col("got") - F.col("visible"), "got").alias("unread"))


def targeting(asks: DataFrame, reqs: DataFrame, order: list[str]) -> DataFrame:
    """Share of held requirements whose first naming question went to the holder, per run."""
    first = asks.where("req is not null").groupBy("run", "req").agg(F.min_by("recipient", F.struct(*order)).alias("first_recipient"))
    hit = held_requirements(reqs).join(first, ["run", "req"])
    return hit.groupBy("run").agg(F.count("*").alias("named"), F.count_if(F.col("first_recipient") == F.col("holder")).alias("on_target"), F.avg((F.col("first_recipient") == F.col("holder")).cast("int")).alias("targeting"))


def redundancy(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Questions all of whose named cards had been disclosed strictly before, per run.

    questions: run, question, at, card. facts: run, card, disclosed_at.
    """
    known = questions.join(facts, ["run", "card"], "left").groupBy("run", "question").agg(F.bool_and(F.coalesce(F.col("disclosed_at") < F.col("at"), F.lit(False))).alias("redundant"))
    return known.groupBy("run").agg(F.count("*").alias("questions"), F.count_if("redundant").alias("redundant"))


def texts_with_card(cards: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """Which cards occur among the tokens of the same run."""
    there = tokens.select(*by, "card").distinct().withColumn("__there", F.lit(True))
    return cards.join(there.hint("merge"), [*by, "card"], "left").withColumn("seen", F.coalesce("__there", F.lit(False))).drop("__there")


def requirement_stage(holder: Column, seen: Column, read_doc: Column, disclosure: Column) -> Column:
    """The stage at which a requirement would be lost."""
    public = F.when(seen | read_doc, "implement").otherwise("discovery")
    held = F.when(disclosure == "obtained", "implement").when(disclosure == "returned_not_visible", "read").when(seen, "ask").otherwise("discovery")
    return F.when(holder == PUBLIC, public).otherwise(held)


def attribute_losses(nodes: DataFrame, stages: DataFrame) -> DataFrame:
    """Each failed node with the earliest stage of its requirements; excluded classes and unmapped nodes are told apart.

    nodes: run, node, status, failure_class. stages: run, node, stage (one row per linked requirement).
    """
    rank = F.array_position(F.lit(list(rules.LOSS_STAGES)), F.col("stage"))
    least = stages.groupBy("run", "node").agg(F.min(rank).alias("r"))
    failed = nodes.where("status = 'failed'").join(least, ["run", "node"], "left")
    name = F.get(F.lit(list(rules.LOSS_STAGES)), (F.col("r") - 1).cast("int"))
    stage = F.when(F.col("failure_class").isin(*rules.EXCLUDED_CLASSES), "excluded_infrastructure").otherwise(F.coalesce(name, F.lit("unmapped")))
    return failed.select("run", "node", "failure_class", stage.alias("stage"))


def requirements_table(reqs: DataFrame, states: DataFrame, node_counts: DataFrame) -> DataFrame:
    """All requirements with holder class, acquisition (public or unlinked where there is none) and counts."""
    s = states.select("run", "req", "state", "n_named")
    j = reqs.join(s, ["run", "req"], "left").join(node_counts, ["run", "req"], "left")
    cls = F.when(F.col("holder") == PUBLIC, PUBLIC).otherwise("colleague")
    acquired = F.coalesce("state", F.when(F.col("holder") == PUBLIC, PUBLIC).otherwise("unlinked"))
    return j.select("run", "req", cls.alias("holder_class"), acquired.alias("acquisition"), F.coalesce("n_named", F.lit(0)).alias("questions"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


def information_state(links: DataFrame) -> DataFrame:
    """Per node public, colleague_obtained (all held requirements visible) or colleague_not_obtained.

    links: run, node, holder, state.
    """
    held = F.col("holder") != PUBLIC
    ok = F.bool_and(F.when(held, F.col("state") == "obtained"))
    raised = F.bool_or(F.when(held, F.col("state").isin("asked_owner_about_card", "asked_wrong_person_about_card")))
    kind = F.when(~F.bool_or(held), "public").when(ok, "colleague_obtained").otherwise("colleague_not_obtained")
    return links.groupBy("run", "node").agg(kind.alias("information_state"), F.when(F.coalesce(raised, F.lit(False)), "card_raised").otherwise("card_not_raised").alias("ask_detail"))


def chain_positions(items: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """Ordinal of an item on its chain, and the next one."""
    along = Window.partitionBy(*by).orderBy(*order)
    return items.withColumn("ordinal", F.row_number().over(along)).withColumn("next_item", F.lead(item).over(along))


def docs_fetched(cards: DataFrame, public: DataFrame) -> DataFrame:
    """The distinct document keys in a run's arguments that are keys of public documents."""
    return cards.distinct().join(public.select("card").distinct().hint("merge"), "card", "left_semi")


def node_rows(nodes: DataFrame, links: DataFrame, stages: DataFrame) -> DataFrame:
    """All nodes with their information state and the stage of their loss, both null where there is none."""
    return nodes.join(links, ["run", "node"], "left").join(stages.select("run", "node", "stage"), ["run", "node"], "left")
