import random

import numpy as np
import pytest
from oracle_check import spark_rows, sql_rows
from pyspark.sql import functions as F

from millrace.operators import answers, vectors
from millrace.plans import extras


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_with_ties_nulls_and_more_vectors_than_a_batch(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "VECTORS_AT_ONCE", 16)
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 3)
    r = random.Random(4)
    name = (lambda i: f"v{i}") if kind == "string" else (lambda i: i)
    rows = [(name(i), None if i % 17 == 5 else [1.0, 2.0, 2.0] if i % 3 == 0 else [float(r.randrange(-3, 4)) or 1.0 for _ in range(3)]) for i in range(120)]
    rows += [(name(0), [1.0, 2.0, 2.0])] * 9  # a query's own id, repeated
    base = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<float>")
    asked = [rows[i] for i in (0, 1, 3, 5, 7, 22, 40)]
    queries = spark.createDataFrame(asked, f"query_id {kind}, embedding array<float>")

    def cosine(a, b):
        if a is None or b is None:
            return None
        dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
        return dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    want, near = set(), {}
    for q, a in asked:
        scored = sorted(((cosine(a, b), v) for v, b in rows if v != q), key=lambda t: (-t[0] if t[0] is not None else 9, t[1]))
        want |= {(q, v, k + 1, s) for k, (s, v) in enumerate(scored[:4])}
        near[q] = sorted(v for s, v in scored if s is not None and 1 - s < 0.2)
    assert {tuple(x) for x in vectors.top_k(queries, base, 4, block=4).collect()} == want
    got = {q: [] for q, _ in asked}
    for x in vectors.within(queries, base, 0.2, block=4).collect():
        got[x.query_id].append(x.vec_id)
    assert {q: sorted(v) for q, v in got.items()} == near


def test_a_task_multiplies_batches_instead_of_folding_each_pair(spark):
    base = spark.createDataFrame([(i, np.random.default_rng(i).random(64).tolist()) for i in range(500)], "vec_id long, embedding array<float>")
    queries = base.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    for found in (vectors.top_k(queries, base), vectors.within(queries, base, 0.5)):
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert vectors.top_k(queries.limit(0), base).count() == 0 and vectors.within(queries, base.limit(0), 0.5).count() == 0


def test_variants_are_found_in_whole_texts(spark):
    words = spark.createDataFrame([(1, i, f"w{i}", [1.0, 0.01 * i] if i == 40 else [0.0, 1.0]) for i in range(41)], "id long, n int, word string, embedding array<float>")
    terms = spark.createDataFrame([("t", [1.0, 0.4]), ("w3", [-1.0, 0.0])], "term string, embedding array<float>")
    assert [(r.id, r.word, r.similar_to) for r in vectors.term_variants(words, terms).collect()] == [(1, "w40", "t")]
    text = "".join(chr(0x4E00 + i) for i in range(900)) + "\U0001f600接 玛"
    df = spark.createDataFrame([(text,), (None,), ("接",), ("ab1",)], "text string")
    got = [r[0] for r in df.select(answers.candidate_grams(F.col("text"), limit=None, most=None)).collect()]
    want = [g.strip() for i in range(len(text) - 1) for g in (text[i : i + 2], text[i : i + 3] if i + 3 <= len(text) else "")]
    assert got[0] == [g for g in dict.fromkeys(want) if g not in ("", "\U0001f600")] and got[1:] == [[], [], ["ab", "ab1", "b1"]]
    long = vectors.embedded(spark.createDataFrame([("x" * 5000,)], "text string"), "text", lambda texts: [[float(len(t))] for t in texts])
    assert long.first().embedding == [5000.0]


def test_every_vector_is_asked_for_and_none_goes_through_the_driver(spark, tmp_path):
    rows = [(i, [1.0, 0.01 * i]) for i in range(150)] + [(150 + i, [-1.0, 5.0 * i]) for i in range(2)] + [(160, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = extras.vector_duplicates(spark, str(tmp_path))
    names, want = sql_rows(extras.ORACLE["vector_duplicates"].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'"), "/root/testdata/sf0.001")
    assert spark_rows(found) == (names, want) and len(want) > 150
    assert "CartesianProduct" in found._jdf.queryExecution().toString()
