import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.mixing import mix, mixed_rows, pivotal, targets


def filled(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Targets by resharing, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, total * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1}, {"a": 0, "b": 7}, {"a": 0}, {f"s{i}": 3 * i * i + 1 for i in range(17)}])
def test_targets_against_resharing(spark, sizes):
    rows = targets(spark.createDataFrame([*sizes.items()], "source string, size long")).collect()
    expected = filled(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(expected)


def test_pivotal_keeps_sums_and_chances():
    r = np.random.default_rng(1)
    p = r.random(7)
    taken = np.zeros(7)
    for _ in range(4000):
        q = pivotal(p, r.random(7))
        assert abs(q.sum() - p.sum()) < 1e-6 and ((q > 0) & (q < 1)).sum() <= 1
        taken += q
    assert np.abs(taken / 4000 - p).max() < 0.04


def test_edge_rows(spark):
    rows = [("1", 1, "a", 10), ("1", 1, "a", 10), ("2", 2, None, 4), ("3", 3, "b", 0), ("4", None, "b", 6), ("5", 5, "c", 300000)]
    df = spark.createDataFrame(rows, "row string, doc_id long, source string, size long")
    out = mix(df).collect()
    assert len(out) == 6 and all(0 <= r.copies <= 2 for r in out)
    assert mix(df.limit(0)).count() == 0


def test_tree_of_groups(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as row", "id as doc_id", "if(id % 3 = 0, 'a', 'b') as source", "1 + id % 97 as size")
    for r in mix(df, per_group=20).groupBy("source").agg({"target": "max", "source": "count"}).collect():
        pass
    got = mix(df, per_group=20).selectExpr("source", "target", "copies * size as taken").groupBy("source").agg({"target": "max", "taken": "sum"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.01 * r["max(target)"]


def test_rows_that_repeat_are_dealt_over_all_groups(spark):
    from millrace.llm import mixing

    df = spark.range(9000).selectExpr("if(id % 3 < 2, 'same', cast(id as string)) as row", "cast(null as long) as doc_id", "'a' as source", "5L as size")
    groups = mixing._numbered(df.repartition(5)).withColumn("g", F.pmod(F.xxhash64("row", "_same", F.lit(0), F.lit(0)), F.lit(45))).groupBy("g").count()
    assert groups.agg(F.max("count")).first()[0] < 300
    assert mixing._numbered(df).filter("row = 'same'").agg(F.count_distinct("_same"), F.min("_same"), F.max("_same")).first() == (6000, 1, 6000)
    out = mix(df, per_group=200)
    assert out.count() == 9000 and abs(out.agg(F.sum("copies")).first()[0] - 13500) <= 5
    one, other = ({(r.row, r.copies): r["count"] for r in mix(x, per_group=200).groupBy("row", "copies").count().collect()} for x in (df, df.repartition(7)))
    assert one == other


def test_rows_of_odd_documents(make):
    docs = make([(1, None), (2, "a b c", None, None), (2, "a b c", None, None), (None, "d e f"), (3, ""), (4, "g h", "x", "t")])
    out = mixed_rows(docs)
    assert out.columns == docs.columns and {r.text for r in out.collect()} <= {None, "", "a b c", "d e f", "g h"}
    assert sorted(map(str, out.collect())) == sorted(map(str, mixed_rows(docs.repartition(3)).collect()))
    assert mixed_rows(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    out = queries.op10_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, queries.op10_mixing(spark, sf_dir).collect()))
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in out:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and r.taken in (0, r.size, 2 * r.size)
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
        target[d.source] = r.target
    assert len(out) == len(docs) and target == pytest.approx(filled(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + max(d.n_chars for d in docs.values() if d.source == s) / 5
