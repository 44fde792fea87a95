"""Runs queries against their SQL in DuckDB and compares the rows as multisets. ``python -m tests.compare [-d DIR] NAME...``"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return con


def cell(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return x


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], collections.Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str:
    """'' if equal, else what differs."""
    got_cols, got = bag(df.columns, df.collect())
    res = con.execute(sql)
    want_cols, want = bag([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    if got != want:
        return f"{got.total()} rows / {want.total()}; only ours {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""


if __name__ == "__main__":
    from quillspan.session import build_session
    import __spark_entry__ as entry

    args, d = sys.argv[1:], "/root/testdata/sf0.01"
    if args[:1] == ["-d"]:
        d, args = args[1], args[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(d), entry.queries(), entry.oracle_sql()
    for name in args or q:
        t0 = time.time()
        try:
            df = q[name](spark, d)
            said = compare(con, df, o[name]) if name in o else f"no SQL, {df.count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name:28s} {time.time() - t0:6.1f} s  {said or 'ok'}", flush=True)
