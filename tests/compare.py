"""Runs registered queries beside their oracle SQL and reports differences.

    python -m tests.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(frame, con, sql: str) -> str | None:
    """None when both results hold the same columns and rows; else what differs."""
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    for mine, other in zip(got, want):
        if mine != other:
            return f"{mine} != {other}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidemark.session import session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.perf_counter()
        try:
            frame = query(spark, sf_dir)
            if name in oracle:
                wrong = difference(frame, con, oracle[name])
            else:
                wrong = None if frame.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        bad += wrong is not None
        print(f"{'ok  ' if wrong is None else 'BAD '} {name:32s} {time.perf_counter() - start:6.2f}s {wrong or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
