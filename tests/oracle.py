"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same Parquet tables and compare row
count, column names and an order-insensitive canonical form of the values."""

from __future__ import annotations

import datetime as dt
import math
import sys

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return repr(0.0 if r == 0 else r)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def canon_rows(cols: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_canon(r[i]) for i in order) for r in rows)


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict) -> dict:
    sdf = queries[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"query": name, "spark_rows": len(s_rows)}
    if name not in oracles:
        out["oracle"] = "none"
        return out
    rel = duck(sf_dir).sql(oracles[name])
    o_cols = list(rel.columns)
    o_rows = rel.fetchall()
    out["oracle_rows"] = len(o_rows)
    out["columns_match"] = sorted(s_cols) == sorted(o_cols)
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(o_cols)
    a, b = canon_rows(s_cols, s_rows), canon_rows(o_cols, o_rows)
    out["values_match"] = a == b
    if not out["values_match"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_oracle"] = sorted(sb - sa)[:3]
    out["ok"] = out["columns_match"] and out["values_match"] and len(s_rows) == len(o_rows)
    return out


if __name__ == "__main__":
    import os
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from plantpulse.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or sorted(qs):
        t = time.time()
        try:
            r = compare(spark, n, sf, qs, ors)
        except Exception as ex:  # report and continue
            r = {"query": n, "error": repr(ex)[:600]}
        r["sec"] = round(time.time() - t, 2)
        if not r.get("ok", r.get("oracle") == "none"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
