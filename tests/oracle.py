"""A query's rows beside those of its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    names = sorted(own)
    return names, sorted(tuple(_plain(r[own.index(n)]) for n in names) for r in found.fetchall())
