"""Runs a query in Spark and its SQL in DuckDB and says how they differ."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{at}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def difference(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    rows = res.fetchall()
    key = lambda r: tuple((x is not None, str(type(x)), x if not isinstance(x, bool) else int(x)) for x in r)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rows), key=key)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.select(*cols).collect()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows: {[r for r in ours if r not in theirs][:2]} {[r for r in theirs if r not in ours][:2]}"
    for x, y in zip(ours, theirs, strict=True):
        if x != y:
            return f"{x} and {y}"
    return None
