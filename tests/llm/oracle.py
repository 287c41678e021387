import duckdb


def rows_of(sql, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(map(tuple, df.select(*names).collect()), key=repr)
