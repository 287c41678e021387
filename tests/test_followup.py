import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import analysis, answers, followup, graph, vectors, warehouse


def test_options_and_paths_with_nulls(spark):
    df = spark.createDataFrame([("NEED_GRAPH_ANALYSIS", None, None, None), (None, True, [], 0.95), ("NEED_STANDARD_ANALYSIS", True, ["slang"], 0.7), ("LOW_RISK_ARCHIVED", True, ["feature"], 0.9)], "d string, auto boolean, entity_types array<string>, confidence double")
    out = followup.with_tools(df).select(followup.followup_options(F.col("d"), F.col("auto"))["analysis_mode"].alias("m"), followup.extraction_path(F.col("entity_types"), F.col("confidence")).alias("p"), "run_graph", "run_slang", "run_similar").collect()
    assert [tuple(r) for r in out] == [(None, "full", False, False, False), (None, "full", False, False, False), ("自动标准研判", "skip_model", False, True, False), (None, "fast", False, False, False)]


def test_entity_evidence_of_odd_rows(spark):
    text = "a" * 50 + " wx123 " + "b" * 50
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    found = spark.createDataFrame([(1, "wechat", "wx123", 0, None), (1, "wechat", "wx123", 1, ""), (1, "odd", "wx123", 2, "near it"), (1, "qq", None, 3, ""), (2, "qq", "9", 0, ""), (2, "qq", "9", 1, " 9 ")], "id int, entity_type string, entity_value string, ordinal int, context string")
    rows = sorted((r.id, r.ordinal, r.start, r.end, r.text, r.risk) for r in answers.entity_evidence(found, df).collect())
    assert rows == [(1, 0, 51, 56, "a" * 29 + " wx123 " + "b" * 29, "站外导流"), (1, 2, 51, 56, "...wx123...", "实体线索"), (2, 1, -1, -1, "9", "站外导流")]


def test_subgraph_of_few_edges(spark):
    posts = spark.createDataFrame([(1, "hello"), (2, None)], "raw_id int, text string")
    found = spark.createDataFrame([(1, "wechat", "w"), (1, "wechat", "w"), (1, "new", "1"), (2, "url", "u")], "raw_id int, entity_type string, entity_value string")
    nodes, edges = graph.subgraph(posts, found, limit=2)
    assert sorted(map(tuple, edges.collect())) == [("1", "1", "EXTRACTED_FROM"), ("1", "1", "MENTIONS")]
    assert sorted(map(tuple, nodes.collect())) == [("1", "hello", "intel")]
    nodes, edges = graph.subgraph(posts, found, limit=None)
    assert edges.count() == 4 and sorted(map(tuple, nodes.collect())) == [("1", "hello", "intel"), ("2", "", "intel"), ("u", "url:u", "url"), ("w", "wechat:w", "wechat")]


def test_changes_and_look_ups(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    changes = spark.createDataFrame([(1, "n", "7", 1), (1, "n", None, 2), (2, "name", "x", 1), (2, "name", "y", 2), (2, "k", "9", 3), (3, "n", "1", 1)], "k int, field string, value string, at int")
    assert sorted(map(tuple, warehouse.with_changes(base, changes, "k", ("n",)).collect())) == [(1, "a", None), (2, "b", 2)]
    assert sorted(map(tuple, warehouse.with_changes(base, changes, "k", ("n", "name")).collect())) == [(1, "a", None), (2, "y", 2)]
    clean = spark.createDataFrame([(i, i, "h" if i % 2 else None) for i in range(14)], "id int, raw_id int, simhash string")
    raw = spark.createDataFrame([(1, "weibo", "t")], "id int, platform string, content_raw string")
    got = warehouse.by_simhash(clean, raw, "h").orderBy("id").collect()
    assert [r.id for r in got] == [1, 3, 5, 7, 9] and [r.source_platform for r in got] == ["weibo", None, None, None, None]
    assert [r.id for r in warehouse.recent_simhashes(clean, 3).collect()] == [13, 11, 9]


def test_vectors_of_a_model(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    out = vectors.embedded(df, "text", lambda texts: [[len(t), 1.0] for t in pd.Series(texts)], characters=2).orderBy("id").collect()
    assert [r.embedding for r in out] == [[2.0, 1.0], [0.0, 1.0]]


def test_sets_of_fields(spark):
    df = spark.createDataFrame([(1, "b", ["x", "y"]), (1, "a", None), (1, "", ["y", None]), (2, None, []), (3, None, None)], "k int, f string, g array<string>")
    assert sorted(map(tuple, analysis.field_sets(df, "k", "f", "g").collect())) == [(1, ["a", "b"], ["x", "y"]), (2, [], []), (3, [], [])]
