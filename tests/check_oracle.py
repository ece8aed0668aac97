"""Runs registered queries beside their SQL in DuckDB and compares the rows.

    python tests/check_oracle.py [--sf 0.01] [--only name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _cell(value: object) -> object:
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan") if math.isnan(value) else (2, repr(value + 0.0))
    if isinstance(value, int):
        return (3, str(value))
    if isinstance(value, (date, datetime)):
        return (4, value.isoformat())
    return (5, str(value))


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, run, sql: str) -> tuple[int, list[str]]:
    df = run(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} / {sorted(columns)}")
    if len(mine) != len(theirs):
        problems.append(f"rows {len(mine)} / {len(theirs)}")
    if not problems and mine != theirs:
        i = next(i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b)
        problems.append(f"row {i}: {mine[i]} / {theirs[i]}")
    return len(mine), problems


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from salesengine.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    spark = build_session("check", "local[8]", extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    texts = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if options.only and not any(name.startswith(o) for o in options.only):
            continue
        began = time.time()
        try:
            if name in texts:
                rows, problems = compare(spark, connection, sf_dir, run, texts[name])
            else:
                rows, problems = run(spark, sf_dir).count(), []
        except Exception as error:  # the check goes on with the next query
            rows, problems = -1, [str(error)[:1500]]
        kind = "" if name in texts else " (rows only)"
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok':4} {name}{kind}: {rows} rows, "
              f"{time.time() - began:.2f}s {' '.join(problems)}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
