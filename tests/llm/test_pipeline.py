import re
import zlib
from collections import Counter

import numpy as np
from test_ngram_join import direct
from test_packing import full_places

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.packing import encoder


def test_each_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if i == 0:
            assert {r.doc_id for r in rows} - {r.doc_id for r in after} == {r.doc_id for r in rows if not re.search(r"[^\W\d_]", r.text or "")}
        elif i == 1:
            best = {}
            for r in rows:
                best[r.text] = max(best.get(r.text, -1), r.doc_id)
            assert sorted(after) == sorted(r for r in rows if best[r.text] == r.doc_id)
        elif i == 2:
            groups = direct([(r.doc_id, r.text) for r in rows])
            assert sorted(after) == sorted(r for r in rows if r.doc_id in {c for _, _, c in groups})
        else:
            taken = Counter(r.doc_id for r in after)
            assert set(taken.values()) <= {1, 2} and set(after) <= set(rows)
            words = lambda rs: sum(len(r.text.split()) for r in rs)
            assert abs(words(after) / words(rows) - 1.5) < 0.02
        rows = after
    packed = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    encode = encoder(queries.tokenizer_path())
    want = Counter()
    for r in rows:
        ids = np.array([*encode(r.text), 2], "<u4")
        cut = len(ids) % 1024 or 1024
        for piece, a in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[a : cut if not a else a + 1024]
            want[r.doc_id, piece, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in packed) == want
    full_places(packed)


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert "sequence_id" in out.columns and out.count() > 1000 and corpus_pipeline.ORACLE_SQL is None


def test_odd_documents(spark, make):
    docs = make([(1, None), (2, ""), (3, "12 34"), (4, "the same words here"), (4, "the same words here"), (5, "the same words here"), (None, "other words of mine", None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    left = {r.text for r in docs.collect()}
    assert left <= {"the same words here", "other words of mine"} and left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
