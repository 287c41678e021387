import shutil
from pathlib import Path

from oracle_check import spark_rows, sql_rows

from millrace.plans import relational


def test_samples_of_the_report_go_by_number_and_not_by_text(spark, tmp_path):
    for t in Path("/root/testdata/sf0.001").iterdir():
        shutil.copy(t, tmp_path)
    labels = spark.createDataFrame([(10, 0, 1), (21, 0, 1), (219, 0, 1), (10394, 0, 1)], "doc_id long, quality int, toxic int")
    (tmp_path / "labels.parquet").chmod(0o644)
    labels.toPandas().to_parquet(tmp_path / "labels.parquet")
    names, rows = spark_rows(relational.QUERIES["union_report"](spark, str(tmp_path)))
    assert (names, rows) == sql_rows(relational.ORACLE["union_report"], str(tmp_path))


def test_accounts_of_a_contact_that_very_many_share(spark, tmp_path):
    """Few accounts have several items, most tie; the plan pairs no more than 101 of the 3,000, which would be 4.5 million pairs."""
    for t in Path("/root/testdata/sf0.001").iterdir():
        shutil.copy(t, tmp_path)
        (tmp_path / t.name).chmod(0o644)
    items = [(k, 3000 - k % 3000 if k % 3 else 7 * (k % 3000), 1 + (k % 50 == 0)) for k in range(4000)]
    spark.createDataFrame([(k, a) for k, a, _ in items], "o_orderkey long, o_custkey long").toPandas().to_parquet(tmp_path / "orders.parquet")
    spark.createDataFrame([(k, c) for k, _, c in items for _ in range(2)], "l_orderkey long, l_partkey long").toPandas().to_parquet(tmp_path / "lineitem.parquet")
    found = relational.QUERIES["shared_contact_accounts"](spark, str(tmp_path))
    assert "count(distinct item" not in found._jdf.queryExecution().toString()
    assert spark_rows(found) == sql_rows(relational.ORACLE["shared_contact_accounts"], str(tmp_path))
