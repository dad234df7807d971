"""Compare a Spark DataFrame with a DuckDB statement the way the driver does:
row count, column names (sorted) and an order-insensitive hash of values."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (int, str, bool)):
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {
        "rows_spark": len(s_rows), "rows_duck": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": sorted(s_cols) == sorted(d_cols) and digest(s_cols, s_rows) == digest(d_cols, d_rows),
    }
    res["ok"] = res["rows_spark"] == res["rows_duck"] and res["hash_match"]
    if not res["ok"]:
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = {repr(tuple(_norm(r[i]) for i in order_s)) for r in s_rows}
        dd = {repr(tuple(_norm(r[i]) for i in order_d)) for r in d_rows}
        res["only_spark"] = sorted(ss - dd)[:3]
        res["only_duck"] = sorted(dd - ss)[:3]
    return res
