"""Runs registered queries in Spark and their SQL in DuckDB and compares names, row counts and values.

``python tests/compare.py [sf_dir] [query ...]`` checks the named queries (all without a name).
"""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A comparable form of one cell that keeps the difference between types of number and text."""
    if value is None:
        return ("0", "null")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, float):
        return ("num", "nan") if math.isnan(value) else ("float", f"{value:.9g}" if value else "0")
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, dt.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", str([plain(v) for v in value]))
    if isinstance(value, dict):
        return ("struct", str([(k, plain(v)) for k, v in value.items()]))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return (type(value).__name__, str(value))


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    names, mine = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    other_names, theirs = table_of([d[0] for d in cur.description], cur.fetchall())
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"row {a}\n    != {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from skyfold.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                found = difference(df, con, oracles[name])
                note = "ok" if found is None else f"DIFF {found}"
            else:
                found, note = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            causes = [x for x in str(e).splitlines() if x.startswith("Caused by")]
            found, note = "error", f"ERROR {type(e).__name__}: {str(e)[:600]} {' '.join(causes)[:1500]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - began:6.2f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
