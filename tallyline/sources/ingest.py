"""CSV feeds to Parquet, one table per feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import put_in_place
from .readers import feed_path
from .schemas import FEEDS

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}

#: The texts that data frames' CSV readers usually take for a missing value.
USUAL_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_csv_feed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """CSV rows of one feed with Spark's reader: declared schema, no inference pass.

    Quoted line breaks need ``multiLine``, which gives each file to a single task; it
    is switched on only for the feed with free text.
    """
    feed = FEEDS[name]
    return (
        spark.read.schema(feed.schema)
        .options(**CSV_OPTIONS)
        .option("header", True)
        .option("multiLine", feed.free_text)
        .option("enforceSchema", False)
        .csv(path)
    )


def _store(df: DataFrame, path: str) -> int:
    """Writes beside ``path`` and moves it there: what fails leaves the old table."""
    seen, beside = Observation(), f"{path}.incoming"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(beside)
    put_in_place(df.sparkSession, beside, path)
    return seen.get["rows"]


def nulls_for(df: DataFrame, spellings: Mapping[str, Sequence[str]]) -> DataFrame:
    """NULL for the listed texts, column by column; a list under "*" goes for all text columns."""
    every = tuple(spellings.get("*", ()))
    unknown = sorted(set(spellings) - {"*", *df.columns})
    if unknown:
        raise KeyError(f"null spellings for unknown columns {unknown}")
    columns = []
    for f in df.schema:
        listed = [*every, *spellings.get(f.name, ())] if isinstance(f.dataType, StringType) else []
        value = F.col(f"`{f.name}`")
        columns.append(F.when(~value.isin(*listed), value).alias(f.name) if listed else value)
    return df.select(*columns)


def ingest(
    spark: SparkSession,
    csv_paths: dict[str, str],
    output_dir: str = "data/olist",
    null_spellings: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
) -> dict[str, int]:
    """Write every named feed to ``output_dir/{name}.parquet``, replacing it.

    ``csv_paths`` maps a feed name to a file, directory or glob. Returns the row
    count per feed, observed during the write itself. The first failure ends the
    run and leaves the feed's old table. Of a feed with free text, a file is read by one
    task, as its records may span lines; the other feeds' files are split.

    An empty field is NULL. ``null_spellings`` names more texts that stand for NULL, per
    feed and column (``{"olist_orders": {"*": USUAL_NULLS}}`` for all columns of a feed).
    They are replaced after parsing, whether the field was quoted or not, and only where
    the whole field is equal. By default there are none, so that "n/a" in a number column
    arrives as text and ``operators.cast_loss`` can count it.
    """
    spellings = null_spellings or {}
    unknown = sorted({*csv_paths, *spellings} - set(FEEDS))
    if unknown:
        raise KeyError(f"unknown feeds {unknown}")
    counts = {}
    for name, path in csv_paths.items():
        rows = nulls_for(read_csv_feed(spark, path, name), spellings.get(name, {}))
        counts[name] = _store(rows, feed_path(output_dir, name))
    return counts
