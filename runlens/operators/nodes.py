"""D: runs, test nodes, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.functions import rules
from runlens.operators.relational import dealt


def run_snapshot(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Passed and total per class, with rates that are null without a node."""
    parts = []
    for k in ("f2p", "p2p"):
        of = F.col("node_class") == k
        parts += [F.count_if(of).alias(f"{k}_total"), F.count_if(of & (F.col("status") == "passed")).alias(f"{k}_passed")]
    out = nodes.groupBy(*by).agg(*parts)
    return out.withColumn("f2p_rate", F.try_divide("f2p_passed", "f2p_total")).withColumn("p2p_rate", F.try_divide("p2p_passed", "p2p_total"))


def norm_status(raw: Column) -> Column:
    """Words and parts of words to passed or failed; anything else, numbers too, is null."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin(*rules.PASSED_WORDS), "passed").when(s.isin(*rules.FAILED_WORDS) | s.rlike("|".join(rules.FAILED_PARTS)), "failed")


def first_rule(text: Column, table: tuple[tuple, ...]) -> Column:
    """The name of the first pattern that occurs in a text; null if none does."""
    start = F.when(text.rlike(table[0][1]), table[0][0])
    return reduce(lambda acc, r: acc.when(text.rlike(r[1]), r[0]), table[1:], start)


def failure_class(label: Column, message: Column) -> Column:
    """Taxonomy by the label first, by the message second."""
    by_label = first_rule(F.lower(F.coalesce(label, F.lit(""))), rules.LABEL_CLASSES)
    return F.coalesce(by_label, first_rule(F.coalesce(message, F.lit("")), rules.MESSAGE_CLASSES), F.lit("unspecified"))


def match_tiers(records: DataFrame, nodes: DataFrame, keys: list[tuple[str, Column, Column]], node: str = "node") -> DataFrame:
    """The first tier under which a record meets a node; a derived key counts only if it names one node.

    keys: (tier, key of a record, key of a node), the strongest first.
    """
    found = None
    for no, (tier, left, right) in enumerate(keys):
        named = nodes.select(F.col(node).alias("__node"), right.alias("__key")).where("__key is not null")
        named = named.groupBy("__key").agg(F.min("__node").alias("matched"), F.count_distinct("__node").alias("__n")).where("__n = 1")
        hit = records.withColumn("__key", left).join(named, "__key").select(*records.columns, F.lit(no).alias("__tier"), F.lit(tier).alias("tier"), "matched")
        found = hit if found is None else found.unionByName(hit)
    best = Window.partitionBy(*records.columns).orderBy("__tier")
    return found.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn", "__tier")


def canonical_id(name: Column) -> Column:
    """Lower case, without a leading class, and runs of anything but a-z and 0-9 as one underscore."""
    s = F.lower(F.trim(name))
    for lead in (r"^\[(f2p|p2p)\]\s*", r"^(f2p|p2p)[\s:_\-/]+"):
        s = F.regexp_replace(s, lead, "")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def longest_number(name: Column) -> Column:
    """The longest run of digits in a text (the first of equal ones) without leading zeros; null if there is none."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))
    first = F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, F.length)))
    return F.regexp_replace(F.try_element_at(first, F.lit(1)), "^0+(?=.)", "")


def match_nodes(records: DataFrame, nodes: DataFrame, aliases: DataFrame, by: list[str], record: str, ids: str, node: str, place: str, numbers: Column | None = None) -> DataFrame:
    """(by, record, tier, node) of each record that names a node: by its exact id, an alias, the canonical form, a
    prefix that one of the two has more, or the longest number, in this order.

    records: by, record and ids, the names it may go by; of one tier the first
    name wins. nodes: by, node and place, their order, which decides between
    nodes that differ by a prefix only. aliases: by, alias, node. Canonical
    forms and numbers (of two digits at least) count only if they name one node
    of ``by``. numbers: may a record be matched by its number; true by default.
    One join holds all tiers: texts as they are (exact ids and aliases), canonical forms and numbers. A name with a
    prefix more meets the node's form by what is left of its own, a node with one by what is left of the node's.
    Records, nodes and aliases are moved once, to the task of their ``by``, and become several keys only there.
    """
    key = lambda space, tier, sub, text: F.struct(F.lit(space).alias("space"), F.lit(tier).alias("tier"), F.lit(sub).alias("sub"), text.alias("key"))
    cut = lambda form, p: F.when(F.startswith(form, F.lit(p)), F.substring(form, F.lit(len(p) + 1), F.length(form)))
    present = lambda keys: F.inline(F.filter(F.array(*keys), lambda k: k["key"].isNotNull()))
    order = F.struct(F.col(place).alias("place"), F.col(node).alias("node"))
    unplaced = F.struct(F.lit(None).cast(nodes.schema[place].dataType).alias("place"), F.col(node).alias("node"))
    also = aliases.where("alias is not null").select(*by, unplaced.alias("__order"), F.col("alias").cast("string").alias("__alias"))
    targets = dealt(nodes.select(*by, order.alias("__order"), F.lit(None).cast("string").alias("__alias")).unionByName(also), by)
    own, form, alias = F.col("__order.node"), F.col("__form"), F.col("__alias")
    targets = targets.withColumn("__form", F.when(alias.isNull(), canonical_id(own)))
    of_node = [key(0, 0, 0, own), key(1, 2, 0, form), key(2, 4, 0, longest_number(own)), *[key(1, 3, i, cut(form, p)) for i, p in enumerate(rules.NODE_PREFIXES)]]
    of_node = [F.when(alias.isNull(), k) for k in of_node]
    targets = targets.select(*by, "__order", present([*of_node, key(0, 1, 0, alias)]))
    # canonical forms and numbers count if they are of one node
    single = F.col("tier").isin(2, 4)
    targets = targets.groupBy(*by, "space", "key").agg(
        F.min(F.when(~single, F.struct("tier", "sub", "__order"))).alias("__any"), F.min(F.when(single, F.col("__order"))).alias("__own"),
        F.min(F.when(single, F.col("__order.node"))).eqNullSafe(F.max(F.when(single, F.col("__order.node")))).alias("__once"),
    )
    # ``short``: which prefix the name gave up, none by default
    said = lambda space, short, text: F.struct(F.lit(space).alias("space"), F.lit(short).cast("int").alias("short"), text.alias("key"))
    named = dealt(records, by).select(*by, record, *([] if numbers is None else [c for c in records.columns if c not in (*by, record, ids)]), F.posexplode(ids).alias("pos", "__name"))
    name, number = F.col("__name"), longest_number(F.col("__name"))
    counted = F.when((F.length(number) >= 2) & F.coalesce(numbers if numbers is not None else F.lit(True), F.lit(False)), number)
    named = named.withColumn("__number", counted).withColumn("__form", canonical_id(name))
    of_name = [said(0, None, name), said(1, None, form), said(2, None, F.col("__number")), *[said(1, i, cut(form, p)) for i, p in enumerate(rules.NODE_PREFIXES)]]
    sought = named.select(*by, record, "pos", present(of_name))
    # a name's own form meets a node's, if only one has it, or what is left of a node's; what is left of it meets any node's
    hits = sought.hint("merge").join(targets, [*by, "space", "key"])
    found = lambda tier, sub: F.when(F.col("__own").isNotNull(), F.struct(tier.alias("tier"), "pos", sub.alias("sub"), F.col("__own").alias("__order")))
    other = F.when(F.col("__any").isNotNull(), F.struct(F.col("__any.tier").alias("tier"), "pos", F.col("__any.sub").alias("sub"), F.col("__any.__order").alias("__order")))
    whole = F.array_min(F.array_compact(F.array(other, F.when(F.col("__once"), found(F.col("space") * 2, F.lit(0))))))
    hits = hits.withColumn("best", F.when(F.col("short").isNotNull(), found(F.lit(3), F.col("short"))).otherwise(whole))
    best = hits.where("best is not null").groupBy(*by, record).agg(F.min("best").alias("best"))
    tiers = F.array(*map(F.lit, ("exact", "alias", "canonical", "prefix", "number")))
    return best.select(*by, record, tiers[F.col("best.tier")].alias("tier"), F.col("best.__order.node").alias(node))


def merge_json_evidence(records: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first record sets the status; label is the first one not null among failed records."""
    o = F.struct(*order)
    failed = (F.col("status") == "failed") & F.col("label").isNotNull()
    return records.groupBy(*by).agg(F.min_by("status", o).alias("status"), F.min_by(F.when(failed, F.col("label")), F.when(failed, o)).alias("label"))


def merge_text_evidence(lines: DataFrame, by: list[str], node: str, pattern: str, order: str) -> DataFrame:
    """Of several patterns the one that matches most nodes of a file (the first on a tie); the last line of a node wins."""
    last = lines.groupBy(*by, pattern, node).agg(F.max_by("status", order).alias("status"))
    size = last.groupBy(*by, pattern).agg(F.count("*").alias("n"))
    pick = size.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), pattern)).alias("m")).select(*by, F.col(f"m.{pattern}").alias(pattern))
    return last.join(pick, [*by, pattern])


def candidate_rank(path: Column, size: Column | None = None) -> Column:
    """Order of evidence files, 0 the best; with a size in bytes null for artifacts and for files that are too large."""
    rank = F.coalesce(first_rule(path, tuple(rules.EVIDENCE_FILES)), F.lit(rules.LAST_EVIDENCE))
    return rank if size is None else F.when(~F.contains(path, F.lit("/artifacts/")) & (size < rules.LARGEST_EVIDENCE), rank)


def reconcile(candidates: DataFrame, expected: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Of each run's candidates the one whose pass counts equal the reported ones exactly and that covers enough nodes.

    candidates: by, candidate, priority, node, node_class, status. expected:
    by, f2p_passed, p2p_passed, total. The best coverage wins, then one that
    needs no matching by numbers (where candidates have the column
    ``numbers``), then priority. Runs without one are unresolved.
    """
    if "numbers" not in candidates.columns:
        candidates = candidates.withColumn("numbers", F.lit(False))
    passed = lambda k: F.count_if((F.col("node_class") == k) & (F.col("status") == "passed")).alias(f"got_{k}")
    sums = candidates.groupBy(*by, "candidate", "priority", "numbers").agg(passed("f2p"), passed("p2p"), F.count("*").alias("n"))
    fits = sums.join(expected, by).where("got_f2p = f2p_passed and got_p2p = p2p_passed").withColumn("coverage", F.try_divide("n", "total")).where(F.col("coverage") >= least)
    best = Window.partitionBy(*by).orderBy(F.desc("coverage"), "numbers", "priority")
    chosen = fits.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").select(*by, "candidate", "coverage")
    return expected.select(*by).join(chosen, by, "left").withColumn("resolved", F.col("candidate").isNotNull())


def node_aliases(aliases: DataFrame, priority: str, alias: str, node: str) -> DataFrame:
    """The node of each alias; ambiguous inside its own key it is dropped, and the key of lowest priority number wins."""
    # smallest and largest are equal where there is one node; to count the distinct ones, each pair would be moved and held once more
    clear = aliases.groupBy(priority, alias).agg(F.min(node).alias(node), F.max(node).alias("__last")).where(F.col(node) == F.col("__last"))
    return clear.groupBy(alias).agg(F.min_by(node, priority).alias(node), F.min(priority).alias(priority))


def reconcile_report(expected: DataFrame, rebuilt: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Do the rebuilt counts equal the expected ones; method is none without rebuilt ones; notes names what differs."""
    got = rebuilt.select(*by, F.lit(True).alias("__got"), *[F.col(c).alias(f"rebuilt_{c}") for c in cols])
    j = expected.select(*by, *cols).join(got, by, "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"rebuilt_{c}")), F.lit(c)) for c in cols]
    notes = F.when(F.col("__got"), F.concat_ws(";", *differs)).otherwise("no evidence")
    return j.select(*by, F.when(F.col("__got"), "rebuilt").otherwise("none").alias("method"), (notes == "").alias("matches"), notes.alias("notes"))
