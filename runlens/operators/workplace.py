"""F, G: notes, claims, timing, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.functions.words import says
from runlens.operators.nodes import first_rule


def note_units(notes: DataFrame, key: list[str], text: str) -> DataFrame:
    """lines of a markdown note grouped to units with start line, kind and heading path.

    Headings (# and whole bold lines, level 7), table rows, and runs of other lines; a blank line,
    a heading, a row or a new bullet that is not indented deeper ends a run.
    """
    lines = notes.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("s", F.trim("raw"))
    mark = F.regexp_extract("raw", r"^(#{1,6})\s+", 1)
    bold = F.col("s").rlike(r"^\*\*[^*]{2,80}\*\*:?\s*$")
    level = F.when(F.length(mark) > 0, F.length(mark)).when(bold, F.lit(7))
    row = F.col("s").startswith("|")
    rule = F.col("s").rlike(r"^\|[\s:|-]+\|?$")
    bullet = F.col("s").rlike(r"^([-*+]|\d+[.)])\s+")
    kind = F.when(level.isNotNull(), "head").when(F.col("s") == "", "blank").when(rule, "blank").when(row, "row").when(bullet, "bullet").otherwise("text")
    lines = lines.withColumn("kind", kind).withColumn("level", level).withColumn("indent", F.length("raw") - F.length(F.ltrim("raw")))
    along = Window.partitionBy(*key).orderBy("line")
    before, deeper = F.lag("kind").over(along), F.col("indent") > F.lag("indent").over(along)
    inside = F.col("kind").isin("bullet", "text") & before.isin("bullet", "text") & (deeper | (F.col("kind") == "text"))
    lines = lines.withColumn("starts", (~F.coalesce(inside, F.lit(False)) & (F.col("kind") != "blank")).cast("int"))
    upto = along.rowsBetween(Window.unboundedPreceding, -1)
    for n in range(1, 8):  # the last heading of each level counts until a shallower or equal one follows
        lines = lines.withColumn(f"h{n}", F.last(F.when(F.col("level") == n, F.struct(F.col("line"), F.regexp_replace("s", r"^#+\s+|\*\*", "").alias("t"))), ignorenulls=True).over(upto))
    valid = []
    for n in range(1, 8):
        shallower = [F.coalesce(F.col(f"h{m}.line"), F.lit(-1)) < F.col(f"h{n}.line") for m in range(1, n)]
        ok = F.col(f"h{n}").isNotNull()
        for c in shallower:
            ok &= c
        ok &= F.coalesce(F.lit(n) < F.when(F.col("kind") == "head", F.col("level")), F.lit(True))
        valid.append(F.when(ok, F.col(f"h{n}.t")))
    lines = lines.withColumn("heads", F.concat_ws(" > ", *valid)).where("kind <> 'blank'")
    lines = lines.withColumn("unit", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line", "s")))
    out = lines.groupBy(*key, "unit").agg((F.min("line") + 1).alias("start_line"), F.min_by("kind", "line").alias("kind"), F.min_by("heads", "line").alias("heads"), parts.alias("p"))
    return out.select(*key, "unit", "start_line", "kind", "heads", F.array_join(F.transform("p", lambda x: x["s"]), "\n").alias("unit_text"))


def heard(unit: Column) -> tuple[Column, Column, Column]:
    """Whether a unit's words speak of open work, of work done, and of answers."""
    return says(unit, rules.OPEN_WORDS) | (F.contains(unit, F.lit("未知")) & unit.rlike(rules.OPEN_UNKNOWN)), says(unit, rules.DONE_WORDS), says(unit, rules.ANSWERED)


def classify_claim(unit: Column, heads: Column, broad: bool = False) -> Column:
    """partial or open, done, or not mentioned, from the unit's words and its headings."""
    return claim_of(*heard(unit), heads, broad)


def claim_of(has_open: Column, done: Column, answered: Column, heads: Column, broad: bool = False) -> Column:
    """the claim of a unit of which ``heard`` is known."""
    open_section = heads.rlike(rules.OPEN_HEAD) & ~(answered & ~has_open)
    implemented = heads.rlike(rules.IMPLEMENT_HEAD_BROAD if broad else rules.IMPLEMENT_HEAD)
    return F.when(open_section | has_open, "claimed_partial_or_open").when(done | implemented, "claimed_done").otherwise("not_mentioned")


def claims_strict_broad(units: DataFrame, by: list[str], text: str, heads: str) -> DataFrame:
    """each unit's claim by the strict and by the broad vocabulary of implementation headings."""
    told = dict(zip(("__open", "__done", "__answered"), heard(F.col(text)), strict=True))
    read = units.withColumns(told).select(*by, heads, *told)  # both take the same words
    modes = [F.struct(F.lit(n).alias("mode"), claim_of(*map(F.col, told), F.col(heads), broad).alias("claim")) for n, broad in (("strict", False), ("broad", True))]
    return read.select(*by, F.inline(F.array(*modes)))


def resolve_claims(claims: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """open beats done beats not mentioned; evidence is the first unit of the class that won."""
    rank = F.when(F.col("claim") == "claimed_partial_or_open", 0).when(F.col("claim") == "claimed_done", 1).otherwise(2)
    return claims.withColumn("__r", rank).groupBy(*by).agg(F.min_by("claim", F.struct("__r", *order)).alias("claim"), F.min_by("evidence", F.struct("__r", *order)).alias("evidence"), F.count("*").alias("mentions"))


def delivered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """false if a node failed, true if all passed, else null."""
    failed, passed = F.bool_or(F.col("status") == "failed"), F.bool_and(F.col("status") == "passed")
    return nodes.groupBy(*by).agg(F.when(failed, False).when(passed, True).alias("delivered"), F.count("*").alias("n_nodes"))


def topic_match(topics: DataFrame, units: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """share of a topic's features that occur among a unit's tokens, best score first.

    topics: by, topic, feature. units: by, unit, feature.
    """
    size = topics.groupBy(*by, "topic").agg(F.count_distinct("feature").alias("features"))
    hits = topics.distinct().join(units.distinct().hint("merge"), [*by, "feature"]).groupBy(*by, "topic", "unit").agg(F.count("*").alias("hits"))
    return hits.join(size.hint("merge"), [*by, "topic"]).where(F.col("hits") >= least).withColumn("score", F.col("hits") / F.col("features"))


def tenth(at: Column) -> Column:
    """The tenth of first_at to last_at that a time falls in; null without duration (``least`` alone would skip that null)."""
    of = F.floor(F.try_divide(10 * (at - F.col("first_at")), F.col("last_at") - F.col("first_at")))
    return F.when(of > 9, F.lit(9)).otherwise(of)


def question_deciles(asks: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """Tenth of the run in which each question falls; null for a run without duration."""
    return asks.join(spans, by).withColumn("decile", tenth(F.col(at)))


def first_edit(actions: DataFrame, by: list[str], at: str, edit: str, ask: str) -> DataFrame:
    """First edit of a run, its place in the run (0 to 1), and the questions after it."""
    spans = actions.groupBy(*by).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min(F.when(F.col(edit), F.col(at))).alias("edit_at"))
    after = actions.where(F.col(ask)).join(spans.select(*by, "edit_at"), by).groupBy(*by).agg(F.count("*").alias("asks"), F.count_if(F.col(at) > F.col("edit_at")).alias("asks_after"))
    return spans.join(after, by, "left").select(*by, "edit_at", F.try_divide(F.col("edit_at") - F.col("first_at"), F.col("last_at") - F.col("first_at")).alias("fraction"), F.coalesce("asks", F.lit(0)).alias("asks"), F.coalesce("asks_after", F.lit(0)).alias("asks_after"))


def deferral_threads(threads: DataFrame, asks: DataFrame, by: list[str]) -> DataFrame:
    """Threads with their first deferral and the later questions on the same card."""
    later = threads.join(asks.select(*by, F.col("at").alias("asked_at")), by, "left")
    after = F.col("asked_at") > F.col("deferred_at")
    return later.groupBy(*by, "deferred_at").agg(F.count_if(after).alias("followups"), F.coalesce(F.bool_or(after), F.lit(False)).alias("followed"))


def patch_files(patches: DataFrame, key: list[str], patch: str) -> DataFrame:
    """Path, status, lines added and removed of each file of a unified diff."""
    chunks = patches.select(*key, F.explode(F.split(patch, "(?m)(?=^diff --git )")).alias("chunk")).where(F.col("chunk").rlike(r"^diff --git a/\S+ b/\S+"))
    head = F.substring("chunk", 1, 400)
    status = F.when(head.contains("new file mode"), "added").when(head.contains("deleted file mode"), "deleted").otherwise("modified")
    count = lambda c, t: F.regexp_count("chunk", F.lit(rf"(?m)^{c}(?!{t})")).cast("long")
    return chunks.select(*key, F.regexp_extract("chunk", r"^diff --git a/\S+ b/(\S+)", 1).alias("path"), status.alias("status"), count(r"\+", r"\+\+").alias("added"), count("-", "--").alias("removed"))


def file_category(path: Column) -> Column:
    """The first category whose pattern fits, else production."""
    return F.coalesce(first_rule(path, rules.FILE_CATEGORIES), F.lit("production"))


def file_language(path: Column) -> Column:
    """Language by the whole file name, else by the ending; null if neither is known."""
    known = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    # a leading dot makes no ending
    end = F.regexp_extract(base, r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1)
    docker = F.when((end == "") & base.startswith("dockerfile"), "Dockerfile")
    return F.coalesce(F.element_at(known(rules.FILE_NAMES), base), docker, F.element_at(known(rules.LANGUAGES), end))


def note_source(runs: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """the note of lowest priority number that exists; state is missing, empty (white space only) or present."""
    first = files.where("text is not null").groupBy(*by).agg(F.min("priority").alias("priority"), F.min_by("text", "priority").alias("text"))
    state = F.when(F.col("text").isNull(), "missing").when(F.trim("text") == "", "empty").otherwise("present")
    return runs.select(*by).join(first, by, "left").select(*by, "priority", state.alias("state"))


def brief_rules(results: DataFrame, by: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """Per run, does any result that shows the brief fit each pattern."""
    return results.groupBy(*by).agg(*[F.coalesce(F.bool_or(F.col(text).rlike(p)), F.lit(False)).alias(n) for n, p in patterns.items()])


def test_rule_compliance(runs: DataFrame, files: DataFrame, by: list[str], least_note: int = 50) -> DataFrame:
    """Existing test files with removed lines or deleted, per run; a short note counts as none.

    runs: by, has_rule, migration, note_bytes. files: by, category, status, removed.
    """
    hit = (F.col("status") == "deleted") | ((F.col("status") == "modified") & (F.col("removed") > 0))
    found = files.where((F.col("category") == "test") & hit).groupBy(*by).agg(F.count("*").alias("files"), F.sum("removed").alias("lines_removed"), F.count_if(F.col("status") == "deleted").alias("deleted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    has_note = F.coalesce(F.col("note_bytes") >= least_note, F.lit(False))
    return runs.join(found, by, "left").select(*by, (F.col("has_rule") & ~F.col("migration")).alias("under_rule"), has_note.alias("has_note"), zero("files"), zero("lines_removed"), zero("deleted"))


def rule_stats(compliance: DataFrame) -> DataFrame:
    """Runs under the rule, those that break it, median lines they remove, deleted files, runs with a note."""
    broken = F.col("under_rule") & (F.col("files") > 0)
    return compliance.agg(
        F.count_if("under_rule").alias("rule_runs"), F.count_if(broken).alias("violating"), F.median(F.when(broken, F.col("lines_removed"))).alias("median_removed"),
        F.sum(F.when(broken, F.col("deleted"))).alias("deleted"), F.count_if("has_note").alias("notes"),
    )


def deferral_stats(threads: DataFrame) -> DataFrame:
    """Threads followed and abandoned, and their median number of follow-ups."""
    return threads.agg(F.count_if("followed").alias("followed"), F.count_if(~F.col("followed")).alias("abandoned"), F.median("followups").alias("median_followups"))


def timing_stats(deciles: DataFrame) -> DataFrame:
    """Shares of questions in the first and the last fifth of their run."""
    return deciles.agg(F.count("decile").alias("n"), F.avg((F.col("decile") < 2).cast("int")).alias("first_fifth"), F.avg((F.col("decile") >= 8).cast("int")).alias("last_fifth"))
