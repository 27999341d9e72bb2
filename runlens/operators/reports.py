"""H: states of reviews and diagnoses, their reports as tables, and counts over these.

A report is one row with nested columns, as read from its JSON; every table
keeps the key columns of its report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.relational import exact_quantiles, spearman

DIMENSION_GROUPS = ("strategy_dimensions", "collaboration_dimensions")


def _ids(c: str | Column) -> Column:
    return F.array_join(c, ",")


def review_states(runs: DataFrame, status: DataFrame, problems: DataFrame, by: list[str], absent: Column | str, checks: dict[str, str]) -> DataFrame:
    """Each run's state, and the errors of those whose reports were complete but do not count, sorted.

    runs: by and further columns. status: one row per started run with by,
    state and further columns. problems: by, rule, several rows per run. absent:
    the state of a run without a status. checks: SQL conditions on ``status``
    that a complete report must fulfil; a null condition isn't fulfilled. A null
    state counts as its own state.
    """
    found = problems.groupBy(*by).agg(F.collect_set("rule").alias("__rules"))  # of a short list of rules
    j = runs.join(status.withColumn("__started", F.lit(True)), by, "left").join(found.hint("merge"), by, "left")
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in checks.items()])) if checks else F.array().cast("array<string>")
    errors = F.array_sort(F.concat(F.coalesce("__rules", F.array().cast("array<string>")), broken))
    done = F.coalesce(F.col("state") == "complete", F.lit(False))
    absent = F.lit(absent) if isinstance(absent, str) else absent
    state = F.when(F.col("__started").isNull(), absent).when(done & (F.size(errors) > 0), "invalidated").otherwise(F.col("state"))
    return j.select(*by, state.alias("state"), F.when(done, errors).otherwise(F.array().cast("array<string>")).alias("errors"))


def state_counts(states: DataFrame, expected: int | None = None) -> DataFrame:
    """Runs by state, and with ``expected`` how many runs have no input yet."""
    counts = states.groupBy("state").agg(F.count("*").alias("n"))
    if expected is None:
        return counts
    return counts.unionByName(states.agg(F.lit("input_not_ready").alias("state"), (F.lit(expected) - F.count("*")).alias("n")))


def accepted(reports: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """The reports that count."""
    return reports.join(states.where("state = 'complete'").select(*by), by, "left_semi")


def report_tables(reports: DataFrame, by: list[str], dimensions: tuple[str, ...], lensed: tuple[str, ...]) -> dict[str, DataFrame]:
    """Dimensions, phases, episodes, stops, coverage, issues, evidence and runs of accepted reports.

    reports: by; strategy_dimensions and collaboration_dimensions (id, score,
    observation_status, confidence, assessment, evidence_ids,
    counterevidence_ids), strategy_phases, episodes, quality_flags, evidence:
    arrays of structs; stop_assessment, coverage, summary: structs; limitations:
    texts. ``dimensions`` are the columns of the run table, ``lensed`` the kinds
    of episodes that name a lens. Lists of ids are joined with commas, other
    lists are JSON. Of dimensions with one id a run shows the last.
    """

    def flat(array: str, **changed: Column) -> DataFrame:
        return reports.select(*by, F.inline(array)).withColumns({n: c for n, c in changed.items()})

    def of(group: str) -> Column:
        return F.transform(F.coalesce(group, F.array()), lambda d: F.struct(F.lit(group).alias("group"), d.alias("d")))

    groups = F.concat(*map(of, DIMENSION_GROUPS))
    dims = reports.select(*by, F.inline(groups)).select(*by, "group", "d.*").withColumnRenamed("id", "dimension")
    both = {"evidence_ids": _ids("evidence_ids"), "counterevidence_ids": _ids("counterevidence_ids")}
    last = lambda d: F.try_element_at(F.filter(F.concat(*[F.coalesce(g, F.array()) for g in DIMENSION_GROUPS]), lambda x: x["id"] == d), F.lit(-1))
    marks = [c for d in dimensions for c in (last(d)["score"].alias(f"{d}_score"), last(d)["observation_status"].alias(f"{d}_status"))]
    categories = F.array_sort(F.array_distinct(F.transform("quality_flags", lambda q: q["category"])))
    seen = "coverage.action_index_fully_examined coverage.total_actions coverage.examined_actions coverage.detailed_events_examined".split()
    lists = {"files_examined": "coverage.files_examined", "missing_evidence": "coverage.missing_evidence", "coverage_limitations": "coverage.limitations", "report_limitations": "limitations"}
    return {
        "dimensions": dims.withColumns(both),
        "phases": flat("strategy_phases", tags=_ids("tags"), evidence_ids=_ids("evidence_ids")),
        "episodes": flat("episodes", lens=F.when(F.col("kind").isin(*lensed), F.col("kind")).otherwise(""), **both),
        "stops": reports.select(*by, "stop_assessment.*").withColumns({"evidence_ids": _ids("evidence_ids"), "known_unresolved_items": F.to_json("known_unresolved_items")}),
        "coverage": reports.select(*by, *seen, F.size("evidence").alias("validated_citations"), *[F.to_json(c).alias(n) for n, c in lists.items()]),
        "issues": flat("quality_flags", evidence_ids=_ids("evidence_ids")),
        "evidence": flat("evidence"),
        "runs": reports.select(
            *by, "summary.strategy_profile", "stop_assessment.ending_type", "stop_assessment.premature_stop", F.array_join(categories, ",").alias("quality_flag_categories"),
            F.size("quality_flags").alias("quality_flag_count"), F.size("evidence").alias("evidence_count"), *marks,
        ),
    }


def _counted(df: DataFrame, **of: Column) -> DataFrame:
    """of, name, n: counts of several columns in one pass; nulls and empty names are no names."""
    pairs = F.array(*[F.struct(F.lit(n).alias("of"), c.cast("string").alias("name")) for n, c in of.items()])
    return df.select(F.inline(pairs)).where("name <> ''").groupBy("of", "name").agg(F.count("*").alias("n"))


def review_counts(stops: DataFrame, episodes: DataFrame, issues: DataFrame, by: list[str]) -> DataFrame:
    """Runs by stop label and by ending, episodes by lens, and runs (not issues) by quality category."""
    runs = issues.select(*by, "category").distinct()
    tables = (
        _counted(stops, premature_stop=F.col("premature_stop"), ending_type=F.col("ending_type")), _counted(episodes, lens=F.col("lens")), _counted(runs, quality_category=F.col("category")),
    )
    return reduce(DataFrame.unionByName, tables)


def dimension_summary(dims: DataFrame, runs: DataFrame, by: list[str], rate: str, statuses: tuple[str, ...]) -> DataFrame:
    """Per dimension the rated runs, scores 0 to 3, each observation status, median and mean score, and the rank
    correlation of score and ``rate`` over the runs that have both, with their number.

    dims: by, dimension, score, observation_status. runs: by, rate.
    """
    hist = [F.count_if(F.col("score") == s).alias(f"n{s}") for s in range(4)]
    states = [F.count_if(F.col("observation_status") == s).alias(f"status_{s}") for s in statuses]
    main = dims.groupBy("dimension").agg(F.count("score").alias("rated"), *hist, *states, F.avg("score").alias("mean"))
    median = exact_quantiles(dims, ["dimension"], "score", {"median": 0.5}).select("dimension", "median")
    rho = spearman(dims.join(runs.select(*by, rate), by), "score", rate, ["dimension"]).select("dimension", F.col("n").alias("association_n"), "rho")
    return main.join(median.hint("merge"), "dimension", "left").join(rho.hint("merge"), "dimension", "left").fillna(0, ["association_n"])


def response_models(records: DataFrame, by: list[str], response: str, seq: list[str]) -> DataFrame:
    """The models that answered in a run, sorted, with commas; of a response's snapshots the last that names one counts."""
    named = records.where(f"{response} is not null").groupBy(*by, response).agg(F.max_by("model", F.when(F.col("model").isNotNull(), F.struct(*seq))).alias("model"))
    models = named.where("model <> ''").select(*by, "model").distinct().groupBy(*by).agg(_ids(F.array_sort(F.collect_list("model"))).alias("models"))
    return records.select(*by).distinct().join(models, by, "left").fillna("", ["models"])


def diagnosis_report_tables(reports: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Diagnoses, runs, findings and revisions of accepted diagnoses.

    reports: by; requirements (with delivery_note.verdict and the steps
    what_happened: phase, description), workplace_findings,
    blind_review_revisions: arrays of structs; delivery_audit (verdict,
    overstated_items), stage_summary (dominant_mechanism,
    disagreements_with_pipeline), outcome (f2p_passed, f2p_total): structs;
    headline, case_paragraph.
    """
    step = lambda s: F.concat(F.lit("["), s["phase"], F.lit("] "), s["description"])
    flat = reports.select(*by, F.inline("requirements"))
    rate = F.concat_ws("/", "outcome.f2p_passed", "outcome.f2p_total")
    sizes = {"overstated": "delivery_audit.overstated_items", "diagnosed": "requirements", "disagreements": "stage_summary.disagreements_with_pipeline", "findings": "workplace_findings", "revisions": "blind_review_revisions"}
    return {
        "diagnoses": flat.withColumns({"note_verdict": F.col("delivery_note.verdict"), "chain": F.array_join(F.transform("what_happened", step), " → ")}).drop("delivery_note", "what_happened"),
        "runs": reports.select(
            *by, rate.alias("f2p"), "headline", F.col("delivery_audit.verdict").alias("delivery_audit"), F.col("stage_summary.dominant_mechanism").alias("dominant_mechanism"),
            *[F.coalesce(F.size(c), F.lit(0)).alias(n) for n, c in sizes.items()], "case_paragraph",
        ),
        "findings": reports.select(*by, F.inline("workplace_findings")).withColumn("req_ids", _ids("req_ids")),
        "revisions": reports.select(*by, F.inline("blind_review_revisions")),
    }


def diagnosis_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Of, name, n: diagnoses by stage, pipeline stage, the pair of both, mechanism, responsibility and verdict on the note;
    runs by verdict of the audit; findings by novelty."""
    names = ("stage", "pipeline_stage", "mechanism", "agent_responsible", "note_verdict")
    pair = F.concat_ws("->", F.coalesce("pipeline_stage", F.lit("None")), F.coalesce("stage", F.lit("None")))
    diagnoses = _counted(tables["diagnoses"], stage_matrix=pair, **{n: F.col(n) for n in names})
    return diagnoses.unionByName(_counted(tables["runs"], delivery_audit=F.col("delivery_audit"))).unionByName(_counted(tables["findings"], novelty=F.col("novelty")))


def diagnosis_totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: runs, requirements, share of diagnoses that agree with the pipeline's stage (null without any), revisions."""
    runs = tables["runs"].agg(F.count("*").alias("runs"), F.coalesce(F.sum("revisions"), F.lit(0)).alias("revisions"))
    agree = tables["diagnoses"].agg(F.count("*").alias("requirements"), F.avg(F.coalesce("stage_agrees", F.lit(False)).cast("int")).alias("stage_agreement"))
    return runs.crossJoin(F.broadcast(agree))  # one row each
