import pytest
from oracle_check import spark_rows, sql_rows, sql_types

from millrace.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(name, spark, sf_dir):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert len(names) == len(set(names))
    if name in ORACLE:
        expected_names, expected = sql_rows(ORACLE[name], sf_dir)
        assert names == expected_names
        assert rows == expected


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_types_are_those_of_the_sql(name, spark):
    small = "/root/testdata/sf0.001"
    got = {f.name: TYPES[f.dataType.simpleString()] for f in QUERIES[name](spark, small).schema}
    assert got == sql_types(ORACLE[name], small)
