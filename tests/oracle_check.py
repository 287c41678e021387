"""Compares queries with their SQL in DuckDB, as the driver does: columns by name, rows in any order."""

import datetime
import decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(x[i]) for i in order) for x in r.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(plain, r)) for r in df.select(*names).collect())


def sql_types(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return {d[0]: str(d[1]) for d in con.execute(sql).description}
