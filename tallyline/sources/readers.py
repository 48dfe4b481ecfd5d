"""Reading feeds and single files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import FEEDS

FILE_FORMATS = ("parquet", "csv", "json")


def feed_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_feed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One ingested feed, with the column types its Parquet files declare.

    The types are the file's own (a feed written elsewhere may hold numbers where
    ours holds text) and staging casts either; a missing column fails here rather
    than in some later model.
    """
    if name not in FEEDS:
        raise KeyError(f"unknown feed {name!r}; expected one of {sorted(FEEDS)}")
    df = spark.read.parquet(feed_path(root, name))
    missing = [c for c in FEEDS[name].columns if c not in df.columns]
    if missing:
        raise ValueError(f"feed {name!r} lacks columns {missing}")
    return df.select(FEEDS[name].columns)


def read_file(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """A Parquet, CSV or JSON file or directory, by path.

    Pass ``schema`` for large CSV and JSON input: without it Spark reads the
    files once more to infer one. CSV fields may hold quoted line breaks, so a CSV
    file is read by one task; give a large table as many files, or convert it once.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FILE_FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FILE_FORMATS}")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.format(fmt).load(path)
