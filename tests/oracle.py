"""Comparison of a query with its SQL, as multisets of values."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings people orgs sources nodes edges person_topics person_tags lexicon role_list eval_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = p if os.path.isfile(p) else p + "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols: list[str], data) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, sf_dir: str, query, sql: str) -> tuple[int, list, list]:
    """Row count, and up to five rows that only one side has."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = connect(sf_dir).execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (df.columns, cols)
    return sum(got.values()), list((got - want).items())[:5], list((want - got).items())[:5]
