"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB statement on the same parquet tables and compare rows
order-insensitively (columns sorted by name)."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    info = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
            "cols_match": sorted(scols) == sorted(dcols)}
    if not info["cols_match"]:
        info["spark_cols"], info["oracle_cols"] = scols, dcols
        info["match"] = False
        return info
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    info["match"] = a == b
    if not info["match"]:
        sa, sb = set(a), set(b)
        info["only_spark"] = [x for x in a if x not in sb][:3]
        info["only_oracle"] = [x for x in b if x not in sa][:3]
    return info
