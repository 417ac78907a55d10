"""Run registered queries against their SQL and report every difference.

    python tests/compare.py [sf] [name part]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(v is None, type(v).__name__, v) for v in r])


def difference(df, con, sql: str) -> str | None:
    """None if both give the same columns, value types and rows."""
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(b) for b in w]:
            return f"first difference: {g} != {w}"
    return None


def main() -> int:
    from surtscope.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if part not in name:
            continue
        start = time.time()
        try:
            gap = difference(query(spark, folder), con, sql[name]) if name in sql else "no oracle"
        except Exception as e:  # noqa: BLE001
            gap = f"{type(e).__name__}: {str(e)[:500]}"
        bad += gap is not None
        print(f"{'ok  ' if gap is None else 'DIFF'} {name:34s} {time.time() - start:6.2f}s {gap or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
