"""Compare every registered query with its oracle: ``python -m harness.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .catalogue import registered
from .oracle import statements

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

# Spark type -> DuckDB type
TYPES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[str, int]:
    df = query(spark, sf_dir)
    got = _rows(df.collect(), df.columns)
    relation = con.sql(sql)
    want = _rows(relation.fetchall(), relation.columns)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(set(df.columns) ^ set(relation.columns))}", len(got)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    off = {c: (t, theirs[c]) for c, t in df.dtypes if TYPES.get(t) != theirs[c]}
    if off:
        return f"types {off}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} values, e.g. {bad[0]}" if bad else "ok"), len(got)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = registered(), statements()
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in argv[1:] or queries:
        started = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, name, queries[name], oracles[name])
        except Exception as error:
            verdict, n = "error " + str(error)[:1500], -1
        failed += verdict != "ok"
        print(f"{name:28s} {n:8d} rows {time.time() - started:6.1f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
