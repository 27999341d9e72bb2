"""H: reviews and diagnoses held against the files and facts that they cite. Every check gives (by, error) rows; good reports have none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import rules
from runlens.functions.jsontree import json_strings

IDENTITY = ("task_id", "task_version", "run_id")
OUTCOME = ("f2p_passed", "f2p_total", "p2p_passed", "p2p_total")
_CONTEXT_REF = r"^(?:(?:req|spec|node|p2p|deferral):.+|note|outcome)$"
_ID_IN_PROSE = r"\b(?:E|Q)\d{1,3}\b|node:|req:|spec:"
#: A paragraph of fewer words, each Chinese character one, is too short.
LEAST_WORDS = 80


def _fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _clean_path(path: Column) -> Column:
    """A relative path without . and ..; null if it is absolute or leaves its folder."""
    step = lambda acc, p: (
        F.when(acc.isNull() | p.isin("", "."), acc).when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    )
    return F.when(~path.startswith("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def _lines(text: Column) -> Column:
    ends = r"\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"  # most texts have none of them
    parts = F.when(text.rlike(f"[{ends}]"), F.split(text, rf"\r\n|[\n{ends}]")).otherwise(F.split(text, "\n"))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def check_citations(evidence: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, error) of citations whose file or lines do not exist, or whose quote or event is not in the cited lines.

    evidence: by, id, path, line_start, line_end, quote, event_id. files: by,
    path, text. A quote stands in the lines together, or in a text inside of a
    line that is JSON, texts in JSON that is itself a text included; white
    space counts as one blank.
    """
    known = files.select(*by, F.col("path").alias("__file"), _lines(F.col("text")).alias("__lines"))
    cited = evidence.select(*by, "id", "path", "line_start", "line_end", "quote", "event_id", _clean_path(F.col("path")).alias("__file"))
    start, end, size = F.col("line_start"), F.col("line_end"), F.size("__lines")
    range_ok = F.coalesce((start >= 1) & (start <= end) & (end <= size), F.lit(False))
    where = F.when(F.col("__lines").isNull(), F.concat(F.lit("invalid evidence path: "), F.coalesce("path", F.lit("")))).when(~range_ok, F.concat(F.lit("invalid line range: "), "id"))
    # a merge join holds one file at a time; its rows take the cited lines with them, not the file
    texts = F.when(range_ok, F.slice("__lines", start, end - start + 1))
    section = cited.hint("merge").join(known, [*by, "__file"], "left").select(*by, "id", "quote", "event_id", where.alias("error"), texts.alias("__texts"))
    section = section.withColumn("__said", F.array_join("__texts", "\n")).withColumn("__quote", _fold(F.col("quote")))
    some, no = F.trim("quote") != "", F.lit(False)
    quoted = F.coalesce(some & F.contains(_fold(F.col("__said")), F.col("__quote")), no)
    event = (F.coalesce("event_id", F.lit("")) == "") | F.contains("__said", F.col("event_id"))
    section = section.withColumns({"__quoted": quoted, "__event": event})
    # texts inside of JSON are read only where the lines themselves do not tell enough: one Python call for a section, its lines as one JSON list
    more = F.col("error").isNull() & ((F.coalesce(some, no) & ~F.col("__quoted")) | ~F.col("__event")) & F.col("__said").rlike(r"[{\[]")
    inner = json_strings(F.when(more, F.to_json("__texts")))
    section = section.select(*by, "id", "error", "event_id", "__quote", "__quoted", "__event", some.alias("__some"), F.coalesce(inner, F.array().cast("array<string>")).alias("__inner"))
    quoted = F.col("__quoted") | F.coalesce(F.col("__some") & F.exists("__inner", lambda s: F.contains(_fold(s), F.col("__quote"))), no)
    event = F.col("__event") | F.exists("__inner", lambda s: F.contains(s, F.col("event_id")))
    wrong = F.array(F.when(~quoted, F.concat(F.lit("quote not found in cited lines: "), "id")), F.when(~event, F.concat(F.lit("event ID not found in cited lines: "), "id")))
    return section.select(*by, "id", F.explode(F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array_compact(wrong))).alias("error"))


def _mismatches(reports: DataFrame, facts: DataFrame, by: list[str], fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """The fields of a report that differ from those of its context; a missing context differs in all."""
    names = [c for cols in fields.values() for c in cols]
    j = reports.select(*by, *names).hint("merge").join(facts.select(*by, *[F.col(c).alias(f"__{c}") for c in names]), by, "left")
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"{label}: {c}")) for label, cols in fields.items() for c in cols]
    return j.select(*by, F.explode(F.array_compact(F.array(*wrong))).alias("error"))


def _errors(df: DataFrame, by: list[str], checks: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """One row per row and check whose condition holds; the error is the check's name and the text given with it."""
    told = [F.when(F.coalesce(bad, F.lit(False)), F.concat(F.lit(name), F.coalesce(of.cast("string"), F.lit("null"))) if of is not None else F.lit(name)) for name, (bad, of) in checks.items()]
    return df.select(*by, F.explode(F.array_compact(F.array(*told))).alias("error"))


def _absent(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.hint("merge").join(known.select(*on).distinct(), on, "left_anti")


def _repeated(evidence: DataFrame, by: list[str]) -> DataFrame:
    return evidence.groupBy(*by).agg((F.count("*") != F.count_distinct("id")).alias("__twice")).where("__twice").select(*by)


def check_diagnoses(reports: DataFrame, chains: DataFrame, evidence: DataFrame, refs: DataFrame, files: DataFrame, context: DataFrame, reqs: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """The errors of diagnoses.

    reports: by, the fields of IDENTITY and OUTCOME, row, case_paragraph,
    case_evidence_ids. chains: by, req_id, stage, steps and proven (does any
    step have evidence). evidence: as for check_citations. refs: by, kind
    (evidence_ids or context_refs), ref. context: by, and the fields that the
    report repeats. reqs: by, req_id, nodes_total, nodes_passed. nodes: by, node_id.
    """
    found = [_mismatches(reports, context, by, {"task identity mismatch": (*IDENTITY, "row"), "outcome mismatch": OUTCOME})]
    failed = reqs.where("nodes_total > 0 and nodes_passed < nodes_total").hint("merge").join(reports.select(*by), by, "left_semi")
    missing = _absent(failed, chains, [*by, "req_id"]).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("req_id")), ",").alias("__m"))
    found.append(missing.select(*by, F.concat(F.lit("failed requirements not diagnosed: "), "__m").alias("error")))
    req_id = F.col("req_id")
    found.append(_absent(chains, reqs, [*by, "req_id"]).select(*by, F.concat(F.lit("unknown requirement: "), "req_id").alias("error")))
    found.append(_errors(chains, by, {"empty chain: ": (F.col("steps") == 0, req_id), "chain without trajectory evidence: ": (~F.col("stage").isin("not_determinable", "infrastructure") & ~F.col("proven"), req_id)}))
    found.append(_repeated(evidence, by).withColumn("error", F.lit("duplicate evidence IDs")))
    found.append(check_citations(evidence, files, by).select(*by, "error"))
    found.append(_unknown_refs(refs.where("kind = 'evidence_ids'"), evidence, by))

    said = refs.where("kind = 'context_refs'")
    well = F.col("ref").rlike(_CONTEXT_REF)
    found.append(_errors(said, by, {"malformed context ref: ": (~well, F.col("ref"))}))
    name = F.regexp_extract("ref", "^[a-z0-9]+:(.+)$", 1)
    for kinds, known, key, what in (("^(req|spec):", reqs, "req_id", "requirement"), ("^(node|p2p):", nodes, "node_id", "node")):
        of = _absent(said.where(well & F.col("ref").rlike(kinds)).withColumn(key, name), known, [*by, key])
        found.append(of.select(*by, F.concat(F.lit(f"context ref to unknown {what}: "), "ref").alias("error")))
    words = F.size(F.regexp_extract_all("case_paragraph", F.lit("[一-鿿]|[A-Za-z0-9_]+"), F.lit(0)))
    found.append(
        _errors(
            reports,
            by,
            {
                "case_paragraph must not contain evidence/context IDs; put them in case_evidence_ids": (F.col("case_paragraph").rlike(_ID_IN_PROSE), None),
                "case_evidence_ids is empty": (F.size(F.coalesce("case_evidence_ids", F.array().cast("array<string>"))) == 0, None),
                "case_paragraph too short ": (words < LEAST_WORDS, F.format_string("(%d words/characters)", words)),
            },
        )
    )
    return reduce(DataFrame.unionByName, found)


def _unknown_refs(refs: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    of = _absent(refs.select(*by, F.col("ref").alias("id")), evidence, [*by, "id"])
    return of.select(*by, F.concat(F.lit("unknown evidence reference: "), "id").alias("error"))


def check_reviews(reports: DataFrame, dimensions: DataFrame, evidence: DataFrame, refs: DataFrame, files: DataFrame, examined: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """The errors of reviews.

    reports: by, the fields of IDENTITY, row, total_actions, examined_actions,
    fully_examined. dimensions: by, field (a key of rules.DIMENSIONS), id,
    observation_status, score, n_evidence. evidence, refs (by, ref) and files:
    as above. examined: by, path of the files read. source: by, the fields of
    IDENTITY, row, and actions, the number of recorded ones, null if there is no record.
    """
    found = [_mismatches(reports, source, by, {"task identity mismatch": (*IDENTITY, "row")})]
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), F.array(*map(F.lit, sorted(ids))).alias("__ids")) for f, ids in rules.DIMENSIONS.items()])
    has = dimensions.groupBy(*by, "field").agg(F.array_sort(F.collect_list("id")).alias("__has"))
    sets = reports.select(*by, F.inline(wanted)).hint("merge").join(has, [*by, "field"], "left")
    found.append(_errors(sets, by, {"dimension set mismatch: ": (~F.col("__has").eqNullSafe(F.col("__ids")), F.col("field"))}))
    scored, dim = F.col("score").isNotNull(), F.col("id")
    found.append(_errors(dimensions, by, {"non-observed dimension has a score: ": (~F.col("observation_status").eqNullSafe(F.lit("observed")) & scored, dim), "scored dimension lacks evidence: ": (scored & (F.coalesce("n_evidence", F.lit(0)) == 0), dim)}))
    none = _absent(reports.select(*by), evidence, by)
    found.append(none.unionByName(_repeated(evidence, by)).withColumn("error", F.lit("empty evidence or duplicate IDs")))
    found.append(check_citations(evidence, files, by).select(*by, "error"))
    found.append(_unknown_refs(refs, evidence, by))
    n, total = F.col("examined_actions"), F.col("actions")
    counted = reports.select(*by, "total_actions", "examined_actions", "fully_examined").hint("merge").join(source.select(*by, "actions"), by, "left").where("actions is not null")
    found.append(_errors(counted, by, {"coverage total_actions mismatch": (F.col("total_actions") != total, None), "invalid examined action count": (~n.between(F.lit(0), total), None), "full coverage claimed without all actions": (F.col("fully_examined") & (n != total), None)}))
    read = examined.select(*by, F.col("path").alias("__said"), _clean_path(F.col("path")).alias("path"))
    found.append(_absent(read, files, [*by, "path"]).select(*by, F.concat(F.lit("invalid examined file: "), "__said").alias("error")))
    return reduce(DataFrame.unionByName, found)
