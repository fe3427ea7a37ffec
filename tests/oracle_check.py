"""Run registered queries against their check SQL: python tests/oracle_check.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from metrospect.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value: object) -> object:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value else 0.0
    return value


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=lambda r: tuple(map(repr, r)))


def compare(spark, con, sf_dir: str, name: str, sql: str | None) -> str:
    frame = queries()[name](spark, sf_dir)
    columns, rows = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows only ({len(rows)})" if rows else "EMPTY"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = normal(names, result.fetchall())
    if columns != want_columns:
        return f"COLUMNS {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"ROWS {len(rows)} != {len(want)}"
    differ = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"VALUES {len(differ)} of {len(rows)}: {differ[:2]}" if differ else f"ok ({len(rows)})"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con, sql = local_session(8), duck(sf_dir), oracle_sql()
    for name in sys.argv[2:] or list(queries()):
        began = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, sql.get(name))
        except Exception as failure:
            verdict = f"FAILED {str(failure)[:600]}"
        print(f"{name:24s} {time.time() - began:6.2f}s {verdict[:900]}", flush=True)


if __name__ == "__main__":
    main()
