"""C: communication chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.operators.relational import dealt, unique_match


def bind_questions(asks: DataFrame, questions: DataFrame) -> DataFrame:
    """Tie questions to asks by an id that one ask returned; else by a text unique on both sides; else unbound.

    asks: run, ask, question_id (null if none returned), recipient, text.
    questions: run, question, recipient, text. Time is never used.
    """
    with_id = asks.where("question_id is not null").select("run", F.col("question_id").alias("question"), "ask")
    counted = with_id.groupBy("run", "question").agg(F.count("*").alias("n"), F.min("ask").alias("ask"))
    by_id = questions.join(counted, ["run", "question"], "left")
    first = by_id.where("n = 1").select("run", "question", "ask", F.lit("question_id").alias("method"))
    rest = by_id.where("n is null").select("run", "question", "recipient", "text")
    pairs = unique_match(asks.select("run", "ask", "recipient", "text"), rest, ["run", "recipient", "text"])
    second = pairs.select("run", "question", "ask", F.lit("recipient_text").alias("method"))
    bound = first.unionByName(second)
    return questions.select("run", "question").join(bound, ["run", "question"], "left").withColumn("method", F.coalesce("method", F.lit("unbound")))


def fact_disclosures(events: DataFrame, by: list[str], order: list[str], visible: str) -> DataFrame:
    """Ordinal of each disclosure of a fact, first flag, and the first visible one."""
    along = Window.partitionBy(*by).orderBy(*order)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.withColumn("ordinal", F.row_number().over(along)).withColumn("is_first", F.col("ordinal") == 1).withColumn("first_visible", F.first(F.when(F.col(visible), F.col(order[0])), ignorenulls=True).over(whole))


def linked_disclosures(facts: DataFrame, questions: DataFrame, exposures: DataFrame, by: list[str]) -> DataFrame:
    """Disclosures with their ordinal per fact, the question they answer, and when their reply was seen and read.

    facts: by, fact, question, reply, place. questions: by, question, reply,
    action; a question that stands more than once is no link. exposures: by,
    message, place, is_read. reply_agrees is null without a link.
    """
    along = Window.partitionBy(*by, "fact").orderBy("place")
    counted = facts.select(*by, "fact", "question", "reply", "place", F.row_number().over(along).alias("ordinal"))
    once = questions.groupBy(*by, "question").agg(F.count("*").alias("__n"), F.first("reply").alias("__reply"), F.first("action").alias("action")).where("__n = 1").withColumn("__linked", F.lit(True))
    seen = exposures.groupBy(*by, F.col("message").alias("reply")).agg(F.min("place").alias("first_visible"), F.min(F.when(F.col("is_read"), F.col("place"))).alias("first_read"))
    j = counted.hint("merge").join(once, [*by, "question"], "left").hint("merge").join(seen, [*by, "reply"], "left")
    agrees = F.when(F.col("__linked"), F.col("__reply").eqNullSafe(F.col("reply")))
    return j.select(*by, "fact", "question", "reply", "place", "ordinal", (F.col("ordinal") == 1).alias("is_first"), "action", agrees.alias("reply_agrees"), F.col("first_visible").isNotNull().alias("visible"), "first_visible", "first_read")


def notification_links(exposures: DataFrame, releases: DataFrame, actions: DataFrame, by: list[str]) -> DataFrame:
    """Messages that the runtime sent, with the release of their delivery, when they were seen and read, and the later actions that name them or their cards.

    exposures: by, message, place, is_read, text. releases: by, delivery,
    release. actions: by, action, place, input. Only a delivery that was
    released once is linked. Names and cards count where no letter, digit
    or underscore stands beside them. All three are moved once, to the task
    of their ``by``; texts become words only there.
    """
    sent = dealt(exposures.withColumn("delivery", F.regexp_extract("message", rules.RUNTIME_MESSAGE, 1)).where("delivery <> ''"), by)
    seen = sent.groupBy(*by, "message", "delivery").agg(F.count("*").alias("occurrences"), F.min("place").alias("first_seen"), F.min(F.when(F.col("is_read"), F.col("place"))).alias("first_read"), F.min_by("text", "place").alias("text"))
    cards = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(rules.CARD), F.lit(0))), lambda c: ~c.rlike(rules.NO_CARD))
    seen = seen.withColumn("cards", F.coalesce(cards, F.array().cast("array<string>"))).drop("text")
    freed = dealt(releases, by).groupBy(*by, "delivery").agg(F.count("*").alias("releases"), F.first("release").alias("release"))
    # cards have two parts between hyphens and names three, so actions meet them by two or three neighbouring parts

    def neighbours(run: Column) -> Column:
        parts = F.split(run, "-")
        of = lambda k: F.when(F.size(parts) >= k, F.transform(F.sequence(F.lit(1), F.size(parts) - (k - 1)), lambda i: F.array_join(F.slice(parts, i, F.lit(k)), "-"))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(2), of(3))

    words = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all("input", F.lit("[A-Za-z0-9_-]+"), F.lit(0)), neighbours)))
    said = dealt(actions, by).select(*by, "action", F.col("place").alias("__at"), F.explode(words).alias("__word"))
    asked = seen.select(*by, "message", "first_seen", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("own"), F.col("message").alias("__word"))), F.transform("cards", lambda c: F.struct(F.lit(False).alias("own"), c.alias("__word"))))).alias("w"))
    asked = asked.select(*by, "message", "first_seen", "w.own", "w.__word")
    hits = said.join(asked.hint("shuffle_hash"), [*by, "__word"]).where("__at > first_seen").groupBy(*by, "message")
    hits = hits.agg(F.count_distinct(F.when(F.col("own"), F.col("action"))).alias("mentions"), F.count_distinct(F.when(~F.col("own"), F.col("action"))).alias("with_card"))
    out = seen.hint("merge").join(freed, [*by, "delivery"], "left").hint("merge").join(hits, [*by, "message"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*by, "message", "delivery", n("releases"), F.when(F.col("releases") == 1, F.col("release")).alias("release"), "occurrences", "first_seen", "first_read", F.size("cards").alias("cards"), n("mentions"), n("with_card"))


def notification_chains(notices: DataFrame, actions: DataFrame, by: list[str]) -> DataFrame:
    """Per notice the later actions that share its token (equality on the token, then order)."""
    later = notices.join(actions.select(*by, "token", F.col("at").alias("action_at")), [*by, "token"], "left")
    after = F.col("action_at") > F.col("at")
    return later.groupBy(*by, "notice", "token", "at").agg(F.count_if(after).alias("later_actions"), F.min(F.when(after, F.col("action_at"))).alias("first_later"))


def never_seen(released: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Released items without a visible return."""
    return released.join(seen.select(*key).distinct(), key, "left_anti")


def null_without(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """Counts that are null, not 0, where the run has no sidecar."""
    return df.select(*[F.when(F.col(flag), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def link_ratio(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Numerator and denominator of each link over the corpus."""
    return df.agg(*[F.sum(c).alias(c) for p in pairs for c in dict.fromkeys(p)])


def check_refs(refs: DataFrame, lines: DataFrame, place: list[str], ident: str) -> DataFrame:
    """Distinct references whose place is missing or holds another id."""
    there = lines.select(*place, F.col(ident).alias("__id"))
    return refs.select(*place, ident).distinct().join(there, place, "left").where(~F.col("__id").eqNullSafe(F.col(ident))).select(*place, ident)


def asks(sends: DataFrame, results: DataFrame, call: list[str], is_error: str) -> DataFrame:
    """One row per send call: number of returns, and missing, explicit_is_error or no_is_error_flag."""
    back = results.groupBy(*call).agg(F.count("*").alias("returns"), F.bool_or(is_error).alias("__bad"))
    status = F.when(F.col("returns").isNull(), "missing").when(F.col("__bad"), "explicit_is_error").otherwise("no_is_error_flag")
    return sends.join(back, call, "left").select(*sends.columns, F.coalesce("returns", F.lit(0)).alias("returns"), status.alias("return_status"))


def conversation(sends: DataFrame, shown: DataFrame, by: list[str], at: str) -> DataFrame:
    """Sends and first-shown replies or notices of a run in one numbered order; a send comes first on a tie."""
    both = sends.withColumn("kind", F.lit("send")).unionByName(shown.withColumn("kind", F.lit("shown")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(at, "kind", "item")))


def committed_unseen(released: DataFrame, seen: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """C14: released items that never appeared, with the number of lines in which their id occurs literally."""
    occurs = tokens.groupBy(*key).agg(F.count("*").alias("lines"))
    return never_seen(released, seen, key).join(occurs, key, "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


# Kinds of sidecar events.
AVAILABILITY = ("availability_deferred", "availability_followup_counted", "availability_opened")
UNBOUND = ("colleague_model_failed_closed", "conversation_transaction_rolled_back")


def availability(events: DataFrame, kind: str, questions: DataFrame, key: list[str], action: str) -> DataFrame:
    """Deferral-gate events with all their counters and times, and the action of their question if exactly one has that id."""
    once = questions.groupBy(*key).agg(F.count("*").alias("__n"), F.min(action).alias("question_action")).where("__n = 1").drop("__n")
    return events.where(F.col(kind).isin(*AVAILABILITY)).join(once, key, "left")


def unbound_failures(events: DataFrame, kind: str) -> DataFrame:
    """Failures and rollbacks; they carry no id of a call or question, and time alone binds nothing."""
    return events.where(F.col(kind).isin(*UNBOUND)).withColumn("binding_status", F.lit("unbound"))
