"""Runs queries and their SQL side by side, as the driver does. `python tests/compare.py SF NAME...`"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(x):
    import datetime
    import decimal

    if isinstance(x, float):
        return f"{x:.6g}" if x else "0"
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(str(plain(v)) for v in x) + "]"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(plain(r[i]) for i in order) for r in data)


def connection(d: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{src}')")
    return con


def compare(spark, con, d, query, sql):
    """(equal, rows by Spark, rows by SQL, a few differences)."""
    df = query(spark, d)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(mine[1]), None, []
    rel = con.sql(sql)
    theirs = rows(rel.columns, rel.fetchall())
    a, b = set(mine[1]), set(theirs[1])
    return mine == theirs, len(mine[1]), len(theirs[1]), [mine[0], theirs[0]] * (mine[0] != theirs[0]) + sorted(a - b)[:3] + ["--"] + sorted(b - a)[:3]


def main() -> None:
    import __spark_entry__ as e
    from scanfold.session import get_session

    sf, names = sys.argv[1], sys.argv[2:]
    d = f"/root/testdata/{sf}"
    spark = get_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connection(d), e.queries(), e.oracle_sql()
    for n in names or qs:
        began = time.time()
        try:
            ok, x, y, diff = compare(spark, con, d, qs[n], sqls.get(n))
            print(f"{n}: {'rows only' if ok is None else 'equal' if ok else 'DIFFERENT'} {x} {y} {time.time() - began:.1f}s", *([] if ok or ok is None else diff), flush=True)
        except Exception as x:
            print(f"{n}: ERROR {str(x)[:600]}", flush=True)


if __name__ == "__main__":
    main()
