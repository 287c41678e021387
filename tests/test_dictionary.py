import random

import oracle_check
import pytest

from millrace.operators import dictionary
from millrace.plans import operators


@pytest.mark.parametrize("how", [{}, {"part_bytes": 40}, {"part_bytes": 1, "parts": 1}])
def test_occurrences_against_plain_containment(spark, how):
    r = random.Random(4)
    letters = "abé汉x"
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60))), "t") for i in range(80)] + [(None, "abab", "t"), (1, None, "t"), (1, "", "t"), (2, "ab" * 20_000 + "汉汉汉汉汉汉汉汉汉汉汉汉汉汉汉汉汉汉汉xx", "t")]
    terms = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(60)}) + ["ab" * 12, "汉" * 18 + "xx", "汉" * 19 + "ab"]
    df = spark.createDataFrame(texts, "id long, text string, term string")
    known = spark.createDataFrame([(t, f"m{t}", 1) for t in terms] + [("ab", "other", 1), ("", "empty", 1), (None, "null", 1)], "term string, meaning string, id long")
    meanings = {**{t: {f"m{t}"} for t in terms}, "ab": {"other"} | ({"mab"} if "ab" in terms else set())}
    want = sorted(((i, t, m) for i, text, _ in texts if text for t in meanings if t in text for m in meanings[t]), key=repr)
    assert sorted(map(tuple, dictionary.occurrences(df, known, **how).collect()), key=repr) == want
    assert dictionary.occurrences(df, known.limit(0), **how).count() == 0
    assert dictionary.occurrences(df.limit(0), known, **how).count() == 0


@pytest.mark.parametrize("how", [{}, {"PART_BYTES": 2000}, {"PART_BYTES": 1, "PARTS": 1}])
def test_containment_of_benchmark_texts_by_each_way(spark, sf_dir, how, monkeypatch):
    real = dictionary.occurrences
    monkeypatch.setattr(operators.analysis.dictionary, "occurrences", lambda *a, **k: real(*a, **k, **{n.lower(): v for n, v in how.items()}))
    got = oracle_check.spark_rows(operators.QUERIES["benchmark_containment"](spark, sf_dir))
    assert got == oracle_check.sql_rows(operators.ORACLE["benchmark_containment"], sf_dir) and got[1]
