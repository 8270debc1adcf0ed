"""Run registered queries next to their SQL and compare the results.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks import oracles, queries
from checks.inputs import TABLES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tabgauge")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [
        tuple(0.0 if isinstance(row[i], float) and row[i] == 0 else row[i] for i in order)
        for row in rows
    ]
    return [names[i] for i in order], sorted(tidy, key=repr)


def difference(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    """What differs between both sides, or None."""
    found = query(spark, folder)
    ours = _normal([tuple(r) for r in found.collect()], found.columns)
    answer = con.execute(sql)
    theirs = _normal(answer.fetchall(), [d[0] for d in answer.description])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows / {len(theirs[1])} rows; e.g. {ours[1][:2]} / {theirs[1][:2]}"
    for a, b in zip(ours[1], theirs[1]):
        if repr(a) != repr(b):
            return f"{a}\n      / {b}"
    return None


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark, con = session(), database(folder)
    registered, sqls = queries.queries(), oracles.oracle_sql()
    chosen = arguments[1:] or list(registered)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            if name in sqls:
                problem = difference(spark, con, folder, name, registered[name], sqls[name])
            else:
                rows = len(registered[name](spark, folder).collect())
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'OK ' if problem is None else 'BAD'} {kind:4} {time.time() - start:6.2f}s {name}", flush=True)
        if problem:
            print("      " + problem, flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    sys.exit(main(sys.argv[1:]))
