"""Command line: ingest CSV feeds, build the tables, export the marts.

    python -m tallyline ingest --input-dir CSV --output-dir data/olist
    python -m tallyline build  --raw-dir data/olist --warehouse-dir data/warehouse
    python -m tallyline export --warehouse-dir data/warehouse --output-dir data/csv

Also the entry point for ``spark-submit``; the session comes from there.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import TABLES, build
from .sources import FEEDS, USUAL_NULLS, export_csv, ingest


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tallyline")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("ingest", help="CSV feeds to Parquet")
    command.add_argument("--input-dir", required=True)
    command.add_argument("--output-dir", default="data/olist")
    command.add_argument(
        "--usual-nulls", action="store_true", help='take "NA", "n/a", "NULL" and the like for NULL'
    )
    command = commands.add_parser("build", help="rebuild every table")
    command.add_argument("--raw-dir", default="data/olist")
    command.add_argument("--warehouse-dir", default="data/warehouse")
    command = commands.add_parser("export", help="marts to CSV")
    command.add_argument("--warehouse-dir", default="data/warehouse")
    command.add_argument("--output-dir", default="data/csv")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tallyline").getOrCreate()
    if args.command == "ingest":
        paths = {name: f"{args.input_dir}/{feed.csv_name}" for name, feed in FEEDS.items()}
        nulls = {name: {"*": USUAL_NULLS} for name in paths} if args.usual_nulls else None
        for name, rows in ingest(spark, paths, args.output_dir, nulls).items():
            print(f"{name}: {rows} rows")
        return 0
    if args.command == "build":
        for name, df in build(spark, args.raw_dir, args.warehouse_dir).items():
            print(f"{TABLES[name].layer}.{name}: {len(df.columns)} columns")
        return 0
    marts = {
        name: spark.read.parquet(f"{args.warehouse_dir}/marts/{name}")
        for name, table in TABLES.items()
        if table.layer == "marts"
    }
    status = export_csv(spark, marts, args.output_dir).collect()
    for row in status:
        print(f"{row.table}: {row.status} {row.message or row.rows}")
    return int(any(row.status != "ok" for row in status))


if __name__ == "__main__":
    sys.exit(main())
