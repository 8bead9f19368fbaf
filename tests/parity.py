"""Runs queries beside their SQL in DuckDB and compares the rows as multisets of values."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    ours, theirs = df.collect(), con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b).items())[:3]}, only theirs {list((b - a).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from glossoloom.session import get_spark

    sf, only = sys.argv[1], sys.argv[2:]
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), entry.oracle_sql(), 0
    for name, q in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, q, sqls[name]) if name in sqls else f"{q(spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"failed: {str(e)[:600]}"
        fine = not said or "no SQL" in said
        bad += not fine
        print(f"{'ok ' if fine else 'BAD'} {name} {time.time() - t:.1f}s {said}", flush=True)
    print("bad", bad)
