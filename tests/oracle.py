"""Runs a registered query and its SQL over the same Parquet files and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return float(v) if type(v).__name__ == "Decimal" else v


def compare(spark, name: str, run, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in names)) for r in df.collect()))
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"{name}: columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in names]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    if got != want:
        only = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{name}: {len(got)} and {len(want)} rows; only in Spark {only[0]}; only in SQL {only[1]}"
    return None
