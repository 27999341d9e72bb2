"""States of reviews and tables of reports on small inputs."""

from pyspark.sql import functions as F

from runlens.operators import reports

ARRAYS = """array<struct<id:string,score:int,observation_status:string,confidence:string,assessment:string,evidence_ids:array<string>,counterevidence_ids:array<string>>>"""
SCHEMA = f"""run int, strategy_dimensions {ARRAYS}, collaboration_dimensions {ARRAYS},
strategy_phases array<struct<phase:string,tags:array<string>,evidence_ids:array<string>>>,
episodes array<struct<id:string,kind:string,evidence_ids:array<string>,counterevidence_ids:array<string>>>,
stop_assessment struct<ending_type:string,premature_stop:string,known_unresolved_items:array<string>,evidence_ids:array<string>>,
coverage struct<action_index_fully_examined:boolean,total_actions:int,examined_actions:int,detailed_events_examined:int,files_examined:array<string>,missing_evidence:array<string>,limitations:array<string>>,
quality_flags array<struct<category:string,evidence_ids:array<string>>>, evidence array<struct<id:string>>, summary struct<strategy_profile:string>, limitations array<string>"""


def test_each_way_to_a_state(spark):
    runs = spark.range(1, 8).withColumnRenamed("id", "run")
    status = spark.createDataFrame([(1, "complete", True), (2, "complete", None), (3, "failed", False), (4, "complete", True), (5, None, True)], "run long, state string, same boolean")
    problems = spark.createDataFrame([(4, "b"), (4, "a"), (4, "b"), (3, "a"), (99, "a")], "run long, rule string")
    absent = F.when(F.col("run") == 6, "queued").otherwise("not_scheduled")
    states = reports.review_states(runs, status, problems, ["run"], absent, {"digest": "same"})
    assert {r.run: (r.state, r.errors) for r in states.collect()} == {
        1: ("complete", []), 2: ("invalidated", ["digest"]), 3: ("failed", []), 4: ("invalidated", ["a", "b"]), 5: (None, []), 6: ("queued", []), 7: ("not_scheduled", []),
    }
    assert {r.state: r.n for r in reports.state_counts(states, 10).collect()} == {"complete": 1, "invalidated": 2, "failed": 1, None: 1, "queued": 1, "not_scheduled": 1, "input_not_ready": 3}
    assert [r.run for r in reports.accepted(runs, states, ["run"]).collect()] == [1]
    assert reports.state_counts(states.limit(0), 4).collect() == [("input_not_ready", 4)]


def test_tables_of_a_report_and_of_an_empty_one(spark):
    dim = lambda i, s: (i, s, "observed", "low", "so", ["e1", "e2"], [])
    full = (
        1, [dim("x", 1), dim("x", 3)], [dim("y", None)], [("p", ["a", "b"], [])], [("E1", "causal", ["e1"], ["e2", "e3"]), ("E2", "other", [], [])], ("done", "no", ['say "hi"', "é"], ["e1"]),
        (True, 4, 3, 2, ["f"], [], ["l"]), [("b", ["e1"]), ("a", []), ("b", [])], [("e1",), ("e2",)], ("careful",), ["few"],
    )
    bare = (2, None, None, None, [], None, None, None, None, None, None)
    t = reports.report_tables(spark.createDataFrame([full, bare], SCHEMA), ["run"], ("x", "y", "z"), ("causal",))
    got = {n: [r.asDict() for r in d.orderBy("run").collect()] for n, d in t.items()}
    assert [(d["group"], d["dimension"], d["score"], d["evidence_ids"], d["counterevidence_ids"]) for d in got["dimensions"]] == [
        ("strategy_dimensions", "x", 1, "e1,e2", ""), ("strategy_dimensions", "x", 3, "e1,e2", ""), ("collaboration_dimensions", "y", None, "e1,e2", ""),
    ]
    assert [(e["id"], e["lens"], e["counterevidence_ids"]) for e in got["episodes"]] == [("E1", "causal", "e2,e3"), ("E2", "", "")]
    assert got["phases"] == [{"run": 1, "phase": "p", "tags": "a,b", "evidence_ids": ""}]
    assert [s["known_unresolved_items"] for s in got["stops"]] == ['["say \\"hi\\"","é"]', None]
    assert got["coverage"][0]["validated_citations"] == 2 and got["coverage"][0]["missing_evidence"] == "[]"
    first, second = got["runs"]
    assert (first["x_score"], first["y_score"], first["y_status"], first["z_score"], first["quality_flag_categories"], first["quality_flag_count"]) == (3, None, "observed", None, "a,b", 3)
    assert (second["run"], second["x_score"], second["ending_type"]) == (2, None, None)
    assert {(r.of, r.name): r.n for r in reports.review_counts(t["stops"], t["episodes"], t["issues"], ["run"]).collect()} == {
        ("premature_stop", "no"): 1, ("ending_type", "done"): 1, ("lens", "causal"): 1, ("quality_category", "a"): 1, ("quality_category", "b"): 1,
    }


def test_models_of_responses(spark):
    rows = [(1, "r1", "old", 1), (1, "r1", None, 3), (1, "r1", "new", 2), (1, "r2", "b", 1), (1, None, "none", 1), (2, "r1", None, 1)]
    found = reports.response_models(spark.createDataFrame(rows, "run int, response string, model string, seq int"), ["run"], "response", ["seq"])
    assert {r.run: r.models for r in found.collect()} == {1: "b,new", 2: ""}
