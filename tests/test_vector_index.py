import random

import pytest

from millrace.operators import vector_index, vectors


def table(spark, n, seed=1, dim=8, first=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(20)]
    rows = [(first + i, [x + r.gauss(0, 0.4) for x in r.choice(centres)], "x") for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell string")


def asked(df, by=10):
    return df.filter(f"vec_id % {by} = 0").withColumnRenamed("vec_id", "query_id")


def test_recall_and_all_rows(spark, tmp_path):
    base, path = table(spark, 1500), str(tmp_path / "index")
    fitted = vector_index.build(base, path)
    assert spark.read.parquet(f"{path}/cells").count() == 1500 and fitted.probes < len(fitted.centres)
    exact = vectors.top_k(asked(base), base)
    found = vector_index.search(asked(base), path)
    assert vector_index.recall(found, exact) >= 0.9
    assert found.groupBy("query_id").count().filter("count <> 5").isEmpty()
    # with all cells it is exact, in any number of blocks
    rows = lambda df: sorted((r.query_id, r.rank, r.vec_id, round(r.similarity, 5)) for r in df.collect())
    everywhere = vector_index.search(asked(base), path, probes=10_000, block=40)
    assert rows(everywhere) == rows(exact)


def test_append_keeps_the_cells(spark, tmp_path):
    base, path = table(spark, 800), str(tmp_path / "index")
    vector_index.build(base, path)
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    more = table(spark, 300, first=10_000)
    vector_index.append(more, path)
    assert all(p.stat().st_mtime_ns == files[str(p)] for p in (tmp_path / "index").rglob("*.parquet") if str(p) in files)
    both = base.union(more)
    exact = vectors.top_k(asked(both), both)
    assert vector_index.recall(vector_index.search(asked(both), path), exact) >= 0.9


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "index")
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [1.0, 0.0])] + [(i, [1.0, 0.0]) for i in range(5, 60)], "vec_id long, embedding array<float>")
    vector_index.build(odd, path)
    out = [tuple(r) for r in vector_index.search(asked(odd, 3), path, 2, probes=100).filter("query_id = 3").orderBy("rank").collect()]
    assert out == [(3, 4, 1, 1.0), (3, 5, 2, 1.0)]
    vector_index.build(odd.limit(0), str(tmp_path / "none"))
    assert vector_index.search(asked(odd), str(tmp_path / "none")).count() == 0
    assert vector_index.search(asked(odd).limit(0), path).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_on_the_tables(spark, tmp_path, sf):
    base = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    vector_index.build(base, str(tmp_path))
    exact = vectors.top_k(asked(base, 100), base)
    assert vector_index.recall(vector_index.search(asked(base, 100), str(tmp_path)), exact) >= 0.9
