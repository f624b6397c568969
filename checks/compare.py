"""Run queries next to their SQL in DuckDB: python -m checks.compare [sf] [key ...]"""

from __future__ import annotations

import importlib
import sys
import time

import duckdb

from tessarine.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return None if value != value else value
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return str(value) if value.__class__.__name__ in ("datetime", "date", "Decimal") else value


def compare(spark, entry, connection, sf: str, keys: list[str]) -> int:
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for key in keys or list(queries):
        started = time.time()
        try:
            df = queries[key](spark, sf)
            got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
        except Exception as error:  # noqa: BLE001
            bad += 1
            print("ERROR", key, str(error)[:1500], flush=True)
            continue
        spent = time.time() - started
        if key not in sql:
            print(f"rows  {key} {len(got)} {spent:.2f}s", flush=True)
            continue
        started = time.time()
        try:
            cursor = connection.execute(sql[key])
            names = [d[0] for d in cursor.description]
            index = [names.index(c) for c in sorted(df.columns)] if sorted(names) == sorted(df.columns) else None
            rows = cursor.fetchall()
        except Exception as error:  # noqa: BLE001
            bad += 1
            print("SQLERR", key, str(error)[:1200], flush=True)
            continue
        if index is None:
            bad += 1
            print("NAMES", key, sorted(names), sorted(df.columns), flush=True)
            continue
        want = [tuple(r[i] for i in index) for r in rows]
        a = sorted([tuple(normal(v) for v in r) for r in got], key=repr)
        b = sorted([tuple(normal(v) for v in r) for r in want], key=repr)
        kinds = [
            {type(v).__name__ for v in column if v is not None} for column in (zip(*a) if a else [])
        ]
        other = [
            {type(v).__name__ for v in column if v is not None} for column in (zip(*b) if b else [])
        ]
        if a == b and kinds == other:
            print(f"ok    {key} {len(a)} rows {spent:.2f}s (sql {time.time() - started:.2f}s)", flush=True)
        else:
            bad += 1
            sa, sb = set(map(repr, a)), set(map(repr, b))
            print(f"DIFF  {key} {len(a)} vs {len(b)} types {kinds} {other}", flush=True)
            for row in sorted(sa - sb)[:3]:
                print("   spark", row[:500])
            for row in sorted(sb - sa)[:3]:
                print("   sql  ", row[:500])
    return bad


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entry = importlib.import_module("__spark_entry__")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = compare(local_session("compare"), entry, connection, sf, sys.argv[2:])
    print("failed:", bad)


if __name__ == "__main__":
    main()
