"""Operators over their whole tables, where a query once saw a part of them."""

import __spark_entry__ as entry
from conftest import SF
from runlens.operators import stats


def test_timeline_is_whole_without_a_clip(spark):
    events = spark.createDataFrame([(1, 0, "a" * 90), (1, 3_661_000_000, "short"), (1, 5_000_000, None)], "run long, at long, text string")
    for clip in (None, 0):
        rows = stats.timeline(events, ["run"], "at", clip).collect()
        assert {(r.offset, r.shown) for r in rows} == {("0:00:00", "a" * 90), ("1:01:01", "short"), ("0:00:05", None)}
    assert {r.shown for r in stats.timeline(events, ["run"], "at", 60).collect()} == {"a" * 40 + " ... " + "a" * 20, "short", None}


def test_quotes_are_sought_in_every_text(spark):
    texts = [("it says the  quick\nbrown fox ran",), ("xthe quick brown foxes",), ("the quick fox brown",), (None,), ("",), ("the quick brown fox",), ("the quick brown fox",)]
    quotes = [(1, "the quick brown fox"), (2, "quick"), (3, "absent words in here"), (4, None), (5, "brown fox")]
    rows = stats.find_quotes(spark.createDataFrame(quotes, "place long, quote string"), spark.createDataFrame(texts, "text string")).collect()
    assert {r.place: r.texts for r in rows} == {1: 4, 2: 5, 3: 0, 4: 0, 5: 4}


def test_windows_and_aliases_see_every_run_and_record(spark):
    query = lambda name: entry.queries()[name](spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert query("k09_trace_window_turns").select("run").distinct().count() == turns.where("turn between 1 and 4").select("conv_id").distinct().count()
    records = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey * 100 + l_linenumber as node").distinct()
    found = query("d05_node_aliases_all").cache()
    assert {0, 3} <= {r.priority for r in found.select("priority").distinct().collect()}
    assert records.join(found.selectExpr("alias as node"), "node", "anti").count() == 0  # every record is named, at least by its own number
