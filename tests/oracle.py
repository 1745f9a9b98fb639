"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, db, run, sql: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    frame = run(spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    middle = time.time()
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    times = f"spark {middle - started:.2f}s sql {time.time() - middle:.2f}s rows {len(got)}"
    if sorted(frame.columns) != sorted(names):
        return False, f"columns {sorted(frame.columns)} != {sorted(names)}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"{times}; rows {len(got)} vs {len(want)}; spark only {only_got}; sql only {only_want}"
    return True, times


def main() -> None:
    from mediamatch import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    sql, failed = oracle_sql(), []
    for name, run in queries().items():
        if name not in sql or wanted and name not in wanted:
            continue
        try:
            ok, note = compare(spark, db, run, sql[name], sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
