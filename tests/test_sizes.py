"""Queries at keys, and work at sizes, that the smallest tables do not have."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from runlens.functions import rules, words
from runlens.operators import checks, claims, comms, grader, mentions, nodes, normalize, relational, reviews, sidecars, verifier
from runlens.plans.bindings import TABLES
from test_oracles import ORACLES, rows


def shuffled(spark, df):
    """Records that a query writes to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda found: [found.apply(i) for i in range(found.size())])(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None))}
    before = set(stages())
    df.write.format("noop").mode("overwrite").save()
    sc.listenerBus().waitUntilEmpty()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with part and supplier keys as large as in 60 copies."""
    folder = str(tmp_path_factory.mktemp("far"))
    for t in TABLES:
        if t == "lineitem":
            duckdb.sql(f"copy (select * replace (l_partkey + 1200000 as l_partkey) from '{SF}/{t}.parquet') to '{folder}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    return folder


def by_sql(name, folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    return rows([d[0] for d in found.description], found.fetchall())


def test_d08_places_past_64_bits(spark, far):
    # the SQL's own places overflow there; part keys moved by a multiple of 3 leave order and patterns as they are
    df = entry.queries()["d08_merge_text_evidence"](spark, far)
    assert rows(df.columns, df.collect()) == by_sql("d08_merge_text_evidence", SF)


def test_c08_cards_of_large_keys(spark, far):
    df = entry.queries()["c08_notification_links"](spark, far)
    assert rows(df.columns, df.collect()) == by_sql("c08_notification_links", far)


def test_d06_shuffles_few_keys(spark):
    # 6,000 records of two names: 34 keys each before
    assert shuffled(spark, entry.queries()["d06_match_all_tiers"](spark, SF)) < 120_000


def moved(spark, make):
    """Records that go to shuffles while a query is made and read."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda found: [found.apply(i) for i in range(found.size())])(sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None))}
    before = set(stages())
    make().write.format("noop").mode("overwrite").save()
    sc.listenerBus().waitUntilEmpty()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_d06_moves_names_before_they_are_keys(spark):
    # 6,000 records and 4,600 nodes: 86,154 when each key was moved
    assert moved(spark, lambda: entry.queries()["d06_match_all_tiers"](spark, SF)) < 30_000
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_c08_moves_texts_before_they_are_words(spark):
    # 47,895 when each word was moved
    assert moved(spark, lambda: entry.queries()["c08_notification_links"](spark, SF)) < 25_000


def test_links_met_in_place(spark):
    exposures = [(r, f"runtime-D{k}-1", k, True, f"see CARD_1-{r}{k}") for r in range(20) for k in range(10, 13)] + [(1, "other", 0, True, "CARD-12")]
    actions = [(r, f"a{k}-{n}", k + n, t) for r in range(20) for k in range(10, 13) for n, t in enumerate((f"runtime-D{k}-1", f"re runtime-D{k}-1, CARD_1-{r}{k}", f"xCARD_1-{r}{k}"))]
    given = spark.createDataFrame(exposures, "run int, message string, place int, is_read boolean, text string")
    freed = spark.createDataFrame([(r, f"D{k}", f"f{k}") for r in range(20) for k in range(10, 12)] + [(3, "D10", "again")], "run int, delivery string, release string")
    df = comms.notification_links(given, freed, spark.createDataFrame(actions, "run int, action string, place int, input string"), ["run"])
    with relational.joined_in_place(spark):
        got = {(x.run, x.delivery): (x.releases, x.release, x.cards, x.mentions, x.with_card) for x in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    want = {(r, f"D{k}"): (int(k < 12) + int((r, k) == (3, 10)), f"f{k}" if k < 12 and (r, k) != (3, 10) else None, 1, 1, 1) for r in range(20) for k in range(10, 13)}
    assert got == want
    assert "__word" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_names_met_in_place(spark):
    # several partitions for each by, and rows that are no longer moved for the join
    given = spark.createDataFrame([(r, f"PR-{r}{k}", k) for r in range(20) for k in range(30, 33)], "run int, node string, place int")
    records = spark.createDataFrame([(r, f"r{k}", [f"zz{r}", f"pr {r}{k}"]) for r in range(20) for k in range(30, 34)], "run int, record string, ids array<string>")
    aliases = spark.createDataFrame([(r, f"pr {r}33", f"PR-{r}30") for r in range(20)] + [(1, None, "PR-130")], "run int, alias string, node string")
    df = nodes.match_nodes(records, given, aliases, ["run"], "record", "ids", "node", "place")
    want = {(r, f"r{k}", "alias" if k == 33 else "canonical", f"PR-{r}{30 if k == 33 else k}") for r in range(20) for k in range(30, 34)}
    with relational.joined_in_place(spark):
        assert {tuple(x) for x in df.collect()} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("REPARTITION_BY_NUM") == 0


def test_k03_moves_texts_before_they_are_words(spark):
    # 110,498 when each word of a line was moved
    assert moved(spark, lambda: entry.queries()["k03_grader_output"](spark, SF)) < 60_000


def test_graders_texts_met_in_place(spark):
    given = [(r, f"t[{k}]", f"r{r}/v/run.log") for r in range(20) for k in range(100, 103)] + [(r, "j", f"r{r}/v/a.json") for r in range(20)]
    files = [(r, f"r{r}/v/run.log", f"100 ok\nboth 100 and 101\nx102 {r}") for r in range(20)] + [(r, f"r{r}/all.log", "t[102]") for r in range(20)] + [(r, f"r{r}/v/a.json", '{"id": "j"}') for r in range(20)]
    df = grader.grader_output(spark.createDataFrame(given, "run int, node string, path string"), spark.createDataFrame(files, "run int, path string, text string"), ["run"], "node")
    with relational.joined_in_place(spark):
        got = {(x.run, x.node): x.output for x in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    said = {"t[100]": "100 ok\nboth 100 and 101", "t[101]": "both 100 and 101", "t[102]": "[all.log]\nt[102]", "j": '{"id": "j"}'}
    assert got == {(r, n): t for r in range(20) for n, t in said.items()}
    assert not [x for x in plan.splitlines() if "Exchange" in x and ("__key" in x or "__id" in x)]


def test_large_logs_are_searched_whole(spark):
    # logs of more than 20 MB were searched for their own nodes alone
    given = spark.createDataFrame([(1, "n1", "v/run.log"), (1, "n2", "v/a.json"), (1, "n3", "v/small.log")], "run int, node string, path string")
    small = spark.createDataFrame([(1, "v/small.log", "no names")], "run int, path string, text string")
    large = spark.range(1).select(F.lit(1).alias("run"), F.lit("v/run.log").alias("path"), F.concat(F.lit("n1 n2\n"), F.expr("repeat('x', 20000000)"), F.lit("\nn3")).alias("text"))
    found = grader.log_lines(given, small.unionByName(large), ["run"], "node")
    assert sorted((r.node, r.file, r.line, r.far) for r in found.collect()) == [("n1", "v/run.log", 0, 0), ("n2", "v/run.log", 0, 1), ("n3", "v/run.log", 2, 1)]


def test_f07_pieces_of_words_only(spark):
    # 300 words of six letters: four lengths within a word, 2,100 pieces; every place of the text began five before, 10,000
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{i:03d}x" for i in range(300)]
    units = spark.createDataFrame([(1, 1, " ".join(words)), (1, 2, "X12345.\nyy 权限校验")], "run int, unit int, text string")
    topics = spark.createDataFrame([(1, 7, ["c00", "x"]), (1, 8, ["限校", "345"]), (1, 9, ["ca002x"])], "run int, number int, features array<string>")
    found = claims.topic_scores(units, topics, ["run"], "unit", "number", "text")
    assert {(r.number, r.unit, r.score) for r in found.collect()} == {(8, 2, 1.0), (9, 1, 1.0)}
    assert shuffled(spark, found) < 4_000


def test_d03_reads_a_record_few_times(spark):
    label = reviews.failure_label(F.col("r"), F.col("st"))
    rows = [
        ('{"extra": {"extra": {"reason": "deep"}, "class": "mid"}, "category": "top"}', "deep"), ('{"extra": {"extra": {"reason": "two words"}, "class": "FAILED"}, "failure_reason": "last"}', "last"),
        ('{"extra": "{\\"class\\": \\"no_object\\"}", "reason": "told"}', "told"), ('{"category": 7, "reason": true, "class": {"a": 1}}', "odd_status"), ('{"category": "cut_off"', "odd_status"), (None, "odd_status"), ('[{"class": "listed"}]', "odd_status"),
    ]
    df = spark.createDataFrame([(r, "odd_status", want) for r, want in rows], "r string, st string, want string")
    assert df.where(label != F.col("want")).collect() == []
    # 45 paths before, each read up to three times
    plan = df.select(label)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") + plan.count("from_json") < 10


def test_d04_walks_a_file_once(spark):
    rows = [(1, '{"tests": [{"id": 7, "status": " OK ", "result": "no", "type": 0, "suite": ["x"]}], "b": {"state": "red", "class": "failed\\n", "reason": "why_so\\r", "stderr": "e1", "error": "e2"}, "P2P_Fail\\n": ["n1", "\\ud800"], "u": "broken é", "k": false}'), (2, "[1"), (3, None)]
    found = verifier.walk_verifier(spark.createDataFrame(rows, "f int, j string"), ["f"], "j")
    assert [tuple(r)[1:] for r in found.orderBy("no", "style", F.desc("ids")).collect()] == [
        (2, 1, ["7"], "passed", "", "", "tests"), (9, 0, ["b"], "failed", "failed\n", "why_so\r\ne1\ne2", ""), (15, 3, ["n1"], "failed", "p2p_fail\n", "", ""), (15, 3, ["?"], "failed", "p2p_fail\n", "", ""), (16, 2, ["u"], "failed", "broken é", "", ""), (17, 2, ["k"], "failed", "", "", ""),
    ]
    # before, each object came as a map that some 150 lookups searched
    assert "fields" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["k05_node_rows", "d13_reconciled_nodes", "j07_pass_by_state", "h02_citations", "h10_check_diagnoses", "h09_diagnosis_documents", "d06_match_nodes", "h12_diagnosis_counts"])
def test_records_are_not_read_again_for_each_use(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "node" in plan


def test_h02_moves_a_file_once(spark):
    files = spark.createDataFrame([("r", "f", "\n".join(f"line {i}" for i in range(2_000)) + "\n"), ("r", "g", '["a", "{\\"k\\": \\"in  ner\\"}"]\r\nb\x85c\n')], "run string, path string, text string")
    one = [("r", f"{i}", "f", i, i + 1, f"line {i - 1} line  {i}", None) for i in range(1, 1_500)]
    rows = [("r", "q", "./g", 1, 1, "in ner", ""), ("r", "w", "g", 3, 3, "b", "c"), ("r", "x", "g", 1, 1, "[", "inn"), ("r", "y", "g", 3, 4, "c", ""), ("r", "z", "../g", 1, 1, "a", ""), ("r", "b", "g", 2, 2, " ", "no")]
    cited = spark.createDataFrame([*one, *rows], "run string, id string, path string, line_start int, line_end int, quote string, event_id string")
    found = checks.check_citations(cited, files, ["run"])
    wrong = "quote not found in cited lines: "
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("b", "event ID not found in cited lines: b"), ("b", wrong + "b"), ("w", wrong + "w"), ("x", "event ID not found in cited lines: x"), ("y", "invalid line range: y"), ("z", "invalid evidence path: ../g")]
    # before, citations moved three times or more, and lines once
    assert shuffled(spark, found) < 1_600


def test_a08_holds_calls_once(spark):
    rows = [(1, 2, "a", None), (1, 1, "a", None), (2, 1, None, "x"), (2, 2, "b", "x"), (3, 1, "c", "y")]
    found = normalize.extract_calls(spark.createDataFrame(rows, "id int, at int, s string, c string"), ["id"], ["at"], ["s", "c"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", None, 1, False), (2, None, "x", 1, True), (3, "c", "y", 0, False)]
    # before, three aggregates stood behind the sort
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_a09_reads_records_once_and_sorts_them_once(spark):
    df = entry.queries()["a09_orphans"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # before, records were made three times, and calls joined to results
    assert "l_orderkey" not in plan and "Join" not in plan
    calls = spark.createDataFrame([("a", 5, "B"), ("a", 5, "A"), ("a", 9, "C"), ("b", 3, "D"), ("d", None, "E"), (None, 1, "F")], "id string, at int, action string")
    results = spark.createDataFrame([("a", 1), ("a", 6), ("b", 3), ("b", None), ("c", 7), ("d", 4), (None, 9)], "id string, at int")
    assert sorted(map(tuple, normalize.missing_results(calls, results, ["id"], "at").collect()), key=str) == [("b",), ("d",), (None,)]
    found = normalize.later_calls(calls, results, ["id"], ["at"], "action")
    assert sorted(map(tuple, found.collect()), key=str) == [("a", 1, "A"), ("b", None, "D"), ("c", 7, None)]


def test_b08_walks_a_payload_once(spark):
    rows = [
        ("docs", '[[{"conversation": {"id": 1.5}}], {"key": "k\\ud800", "body": "", "selected_version": {"version": ["a"], "key": "v", "body": 0}}, {"conversation": {"id": 8}}]'),
        ("docs", '{"conversation": {"id": 0}, "key": 7, "selected_version": [{"key": "in", "body": 1, "conversation_id": ""}]}'),
        ("chat", '{"a": {"conversation": {"id": "no"}}, "id": "c", "body": 1, "conversation_id": 3}'), ("chat", '{"id": "n"}'), ("reviews", '{"id": "MR-1"'), ("people", None), (None, '{"id": "x"}'),
    ]
    given = spark.createDataFrame([("r", f"{i}", f, p) for i, (f, p) in enumerate(rows)], "run string, result string, family string, payload string")
    found = sidecars.returned_entities(given, ["run"], "result", "family", "payload")
    assert {tuple(r)[1:] for r in found.collect()} == {
        ("conversation", "1.5", None), ("id", "k?", None), ("body", "k?", None), ("version", "k?", '["a"]'), ("id", "v", None), ("body", "v", None), ("id", "in", None), ("body", "in", None), ("conversation", "", None),
        ("id", "c", None), ("body", "c", None),
    }
    # before, each object came as a map, and was moved to the object that holds it
    assert "fields" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Aggregate") == 1


def test_f05_judges_a_mention_once(spark):
    df = entry.queries()["f05_claims_by_clause"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # before, each card of a range was judged by itself, by some 150 words sought one after the other
    explode, judged = plan.index("Generate explode(numbers"), plan.index("ArrowEvalPython")
    assert explode < judged and plan.count("contains(") < 10
    units = spark.createDataFrame([(1, "AB", "AB-201–204, AB-9, xAB-205 and AB-206/207"), (2, "A.", "A.-210 | AB-201"), (3, "AB", "| 201, 203 | AB-202 |"), (4, None, "AB-201")], "run int, prefix string, text string")
    found = {(r.run, r.mention, tuple(r.numbers), r.blanket, r.at) for r in mentions.card_mentions(units).collect()}
    assert found == {(1, 0, (201, 202, 203, 204), False, 0), (1, 1, (206, 207), False, 30), (2, 0, (210,), False, 0), (3, 0, (202,), False, 13), (3, None, (201,), False, 1), (3, None, (203,), False, 1)}


def test_words_beside_letters_that_are_not_ascii(spark):
    # the SQL's engine begins a word after them
    df = spark.createDataFrame([("已done",), ("édone",), ("xdone",), ("Done é",), (None,)], "t string")
    assert [r.s for r in df.select(words.says(F.col("t"), rules.DONE_WORDS).alias("s")).collect()] == [True, True, False, True, None]
    assert duckdb.sql(f"select regexp_matches('已done', '{rules.DONE_WORDS}') and not regexp_matches('xdone', '{rules.DONE_WORDS}')").fetchall()[0][0]


def test_f08_seeks_words_once_for_both_vocabularies(spark):
    plan = entry.queries()["f08_claims_strict_broad"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # before, some 150 words were sought one after the other, twice
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Contains(") <= 2


@pytest.mark.parametrize("name", ["j19_rule_figures", "j19_broken_rules", "g08_run_basics"])
def test_patches_are_read_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # before, patches were made and split twice for the basics, and the basics twice for their figures
    assert plan.count("collect_list") == (0 if name == "j19_rule_figures" else 1)


def test_d05_moves_an_alias_once(spark):
    rows = [(0, 1, 7), (0, 1, 7), (1, 1, 8), (1, 2, 8), (1, 2, 9), (2, 2, None), (2, 2, 5), (2, 3, None), (3, None, 4)]
    found = nodes.node_aliases(spark.createDataFrame(rows, "p int, a int, n int"), "p", "a", "n")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 7, 0), (2, 5, 2), (None, 4, 3)]
    # before, each distinct pair was moved before it was counted, and the records were made four times
    assert "count(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert entry.queries()["d05_node_aliases_all"](spark, SF)._jdf.queryExecution().analyzed().toString().count("Relation [l_orderkey") == 1


def test_a09_pairs_without_a_join(spark):
    calls = spark.createDataFrame([("a", 2), ("b", 5), (None, 0)], "id string, at int")
    results = spark.createDataFrame([("a", 2, "r1"), ("a", 3, "r2"), ("a", 4, "r3"), ("b", None, "r4"), ("c", 9, "r5"), (None, 3, "r6")], "id string, at int, name string")
    found = normalize.pair_results(calls, results, ["id"], "at")
    assert sorted((r.name, r.call_at, r.status) for r in found.collect()) == [("r1", 2, "orphan"), ("r2", 2, "result"), ("r3", 2, "repeat_result"), ("r4", 5, "orphan"), ("r5", None, "orphan"), ("r6", None, "orphan")]
    # before, calls were joined to results, and records made twice
    assert "Join" not in entry.queries()["a09_pair_results"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_c13_makes_records_once(spark):
    # before, the references and the lines joined lineitem and orders each
    assert "l_orderkey" not in entry.queries()["c13_validate_refs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
