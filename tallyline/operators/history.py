"""How a metric developed over time."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENTIFIER = re.compile(r"[A-Za-z0-9_.]+")
_LONGEST = 365


def metric_history(
    df: DataFrame,
    metric: str,
    date_col: str,
    as_of: date | str | Column | None = None,
    days: int = 30,
    grain: str | None = "day",
) -> DataFrame:
    """Row count, sum, mean, minimum and maximum of ``metric`` per date.

    The window opens ``days`` days (1 to 365) before ``as_of``, today by default,
    and has no upper end. ``grain`` is a ``date_trunc`` unit; None groups by the
    value as stored, which for a timestamp means one row per instant.
    """
    for name in (metric, date_col):
        if not _IDENTIFIER.fullmatch(name or ""):
            raise ValueError(f"{name!r} can't be a column's name")
    if not 1 <= days <= _LONGEST:
        raise ValueError(f"a history has 1 to {_LONGEST} days, not {days}")
    if as_of is None:
        as_of = F.current_date()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of).cast("date")
    bucket = F.col(date_col)
    if grain == "day":
        bucket = F.to_date(bucket)
    elif grain is not None:
        bucket = F.date_trunc(grain, bucket)
    return (
        df.filter(F.col(date_col) >= F.date_sub(as_of, days))
        .groupBy(bucket.alias("metric_date"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(metric).alias("metric_value"),
            F.avg(metric).alias("metric_average"),
            F.min(metric).alias("metric_min"),
            F.max(metric).alias("metric_max"),
        )
        .orderBy(F.col("metric_date").asc_nulls_last())
    )


def table_metric_history(
    spark: SparkSession, table: str, metric: str, date_col: str, days: int = 30, **options
) -> DataFrame:
    """``metric_history`` of a catalog table."""
    if not _IDENTIFIER.fullmatch(table or ""):
        raise ValueError(f"{table!r} can't be a table's name")
    return metric_history(spark.table(table), metric, date_col, days=days, **options)
