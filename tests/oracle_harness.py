"""Run registered queries and their SQL side by side and compare the results by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """Problem text, or an empty string if the results agree."""
    frame = query(spark, sf_dir)
    got = normalized(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    wanted = normalized([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != wanted[0]:
        return f"columns {got[0]} instead of {wanted[0]}"
    if len(got[1]) != len(wanted[1]):
        return f"{len(got[1])} rows instead of {len(wanted[1])}"
    wrong = [(g, w) for g, w in zip(got[1], wanted[1]) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got[1])} rows differ, first: {str(wrong[0])[:600]}"
    return ""


def main(sf: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from pricemill.catalog import CATALOG

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    failures = 0
    for name, query in CATALOG.queries.items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            if name in CATALOG.sql:
                problem = compare(spark, con, name, query, CATALOG.sql[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failures += bool(problem)
        kind = "sql " if name in CATALOG.sql else "rows"
        print(f"{'FAIL' if problem else 'ok'} {kind} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
