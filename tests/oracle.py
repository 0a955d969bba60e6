"""Runs a registered query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v, inside=False):
    """Floats to six decimals; inside lists, where they are compared exactly, zeros keep their sign."""
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x, True) for x in v)
    x = float(v)
    return "nan" if x != x else "-0" if inside and x == 0 and math.copysign(1, x) < 0 else round(x, 6) + 0.0


def rows_of(columns, data, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def same(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns), name
    wanted = sorted(df.columns)
    assert rows_of(df.columns, df.collect(), wanted) == rows_of(list(other.columns), other.fetchall(), wanted), name
