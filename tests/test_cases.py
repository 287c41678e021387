import pytest
from pyspark.sql import functions as F

from millrace.operators import reports
from millrace.plans import followups  # noqa: F401  registers its own
from millrace.plans.cases import CASES


@pytest.mark.parametrize("name", sorted(CASES))
def test_each_phrase(spark, name):
    use, of = CASES[name]
    inputs = list(next(iter(of.values())))
    out = use(F.col("input"))
    rows = spark.createDataFrame([(x,) for x in inputs], "input string").select("input", *((out if len(of) == 1 else out[c]).cast("string").alias(c) for c in of)).collect()
    assert {r.input: tuple(r[c] for c in of) for r in rows} == {x: tuple(of[c][x] for c in of) for x in inputs}


def test_two_decimals_as_the_nearest_double(spark):
    values = [k / 1000 for k in range(1001)] + [0.4751, 0.4749, 0.0049, 0.00501, 0.9999]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", reports.two_decimals(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"{v:.2f}" for v in values}
