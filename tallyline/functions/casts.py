"""Lenient casts for staging: a value that cannot be read becomes NULL.

Each helper returns a SQL expression, so the same text serves a DataFrame
(``selectExpr``) and a stored view (``CREATE VIEW``). ``dtype`` is the Spark type
name of the raw column (``df.schema[c].dataType.simpleString()``); the raw type
decides how fractions round, so it has to be known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Java reads "1d" and "2F" as numbers; as input data they are not numbers.
_SUFFIXED_NUMBER = "[0-9.][dDfF] *$"

# A full calendar date, alone or followed by a time of day. Without this Spark
# would read a bare "2018" or "2018-01" as the first instant of that period.
_DASHED = "^ *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}($|[ T][0-9]{1,2}:[0-9]{1,2})"
_SLASHED = _DASHED.replace("}-[", "}/[")


def _quote(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def as_double(column: str, dtype: str) -> str:
    c = _quote(column)
    if dtype == "string":
        return f"CASE WHEN NOT {c} RLIKE '{_SUFFIXED_NUMBER}' THEN try_cast({c} AS DOUBLE) END"
    return f"try_cast({c} AS DOUBLE)"


def as_int(column: str, dtype: str) -> str:
    """32-bit integer. Text rounds half away from zero ('2.5' -> 3), floating
    values round half to even (2.5 -> 2); out of range is NULL."""
    if dtype == "string":
        return f"try_cast(round({as_double(column, dtype)}) AS INT)"
    if dtype in ("float", "double"):
        return f"try_cast(rint({_quote(column)}) AS INT)"
    return f"try_cast({_quote(column)} AS INT)"


def as_timestamp(column: str, dtype: str) -> str:
    """Timestamp without zone; a zone offset in the text is dropped."""
    c = _quote(column)
    if dtype == "string":
        return (
            f"CASE WHEN {c} RLIKE '{_DASHED}' THEN try_cast({c} AS TIMESTAMP_NTZ)"
            f" WHEN {c} RLIKE '{_SLASHED}'"
            f" THEN try_cast(replace({c}, '/', '-') AS TIMESTAMP_NTZ) END"
        )
    return f"try_cast({c} AS TIMESTAMP_NTZ)"


CASTS = {"int": as_int, "double": as_double, "timestamp": as_timestamp}


def cast_expr(df: DataFrame, column: str, kind: str) -> str:
    """Cast expression for ``df[column]``; ``kind`` is a key of ``CASTS``."""
    return CASTS[kind](column, df.schema[column].dataType.simpleString())
