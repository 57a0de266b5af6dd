"""Run registered queries next to their oracles and compare whole results.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import signal
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None where both results are equal, else what differs."""
    got_columns, got = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns, want = _table([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        mine, theirs = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return f"rows {len(got)} vs {len(want)}; only here {len(mine)} {mine[:2]}; only oracle {len(theirs)} {theirs[:2]}"
    return None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SECONDS_PER_QUERY = 300


def _too_slow(*_) -> None:
    raise TimeoutError(f"more than {SECONDS_PER_QUERY} s")


def main() -> None:
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(folder)
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        signal.signal(signal.SIGALRM, _too_slow)
        signal.alarm(SECONDS_PER_QUERY)
        try:
            df = fn(spark, folder)
            if name in oracles:
                verdict = compare(df, con, oracles[name]) or f"ok {df.count() if wanted else ''}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += verdict.startswith(("rows ", "columns", "ERROR")) and not verdict.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s {verdict[:900]}", flush=True)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
