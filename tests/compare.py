"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf, name, query, sql):
    """None when equal, else a text saying what differs."""
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if not got:
        return "no rows"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows vs {len(want)}; only here {extra}; only in SQL {missing}"
    if [type(x) for x in got[0]] != [type(x) for x in want[0]]:
        return f"types {[type(x).__name__ for x in got[0]]} vs {[type(x).__name__ for x in want[0]]}"
    return None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    bad = 0
    for name, q in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf, name, q, e.oracle_sql().get(name))
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
