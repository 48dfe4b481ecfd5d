"""Ad-hoc, read-only SQL with a capped result, over tables and over files by path."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT = 100

#: String literals and comments, and calls that reach beyond the data.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""", re.S)
_REFLECTIVE = re.compile(r"\b(?:java_method|reflect|try_reflect|identifier)\s*\(", re.I)

#: How files are read unless a query or caller says otherwise: CSV with a header, quotes
#: doubled inside quotes, line breaks in quoted texts, and types taken from the values.
FILE_OPTIONS = {
    "parquet": {},
    "csv": {"header": "true", "escape": '"', "multiLine": "true", "inferSchema": "true"},
    "json": {},
}

#: A file's path where a table is expected; anything else that is quoted is passed over.
_FROM_FILE = re.compile(
    r"""(?P<word>\b(?:FROM|JOIN)\s+)'(?P<path>[^'\\\n]+\.(?P<kind>parquet|csv|json)/?)'"""
    r"""|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""",
    re.S | re.I,
)

_LISTING = ("show ", "describe ", "desc ", "explain ")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def relation(path: str, fmt: str | None = None, **options: str) -> str:
    """A file or directory as SQL text for a FROM clause, with the options to read it.

    The format follows from the ending unless given; ``options`` are those of Spark's
    reader and replace FILE_OPTIONS one by one. A CSV file is read by one task, as its
    texts may hold line breaks (``multiLine="false"`` splits it), and once more for its
    types (``inferSchema="false"`` leaves all columns text); a directory has a task per
    file. JSON has one object per line; ``multiLine="true"`` reads arrays and objects over
    several lines.
    """
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt not in FILE_OPTIONS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {tuple(FILE_OPTIONS)}")
    given = FILE_OPTIONS[fmt] | options
    listed = ", ".join(f"{_quoted(k)} = {_quoted(str(v))}" for k, v in given.items())
    name = path.replace("`", "``")
    return f"{fmt}.`{name}`" + (f" WITH ({listed})" if listed else "")


def files_in(query: str) -> str:
    """``query`` with each ``FROM 'path.csv'`` (or .json, .parquet, or JOIN) as a relation."""

    def replaced(found: re.Match) -> str:
        if found["path"] is None:
            return found[0]
        return found["word"] + relation(found["path"], found["kind"])

    return _FROM_FILE.sub(replaced, query)


def explore(spark: SparkSession, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """At most ``limit`` rows of ``query``; the cap is part of the plan.

    Only a query can stand where a table is expected, so it is first analyzed
    there: anything that would change data or the catalog fails to parse and is
    never run. SHOW, DESCRIBE and EXPLAIN change nothing and pass as they are. Calls
    of Java methods, and names put together by ``identifier``, are refused.

    A table may be a file: ``FROM 'landing/reviews.csv'`` reads it by FILE_OPTIONS, and
    Spark's own form takes options of one's choice, as ``relation`` writes them:
    ``FROM csv.`landing/reviews.csv` WITH ('header' = 'true')``.
    """
    if _REFLECTIVE.search(_QUOTED.sub(" ", query).replace("`", " ")):
        raise ValueError("the query calls a function that is not allowed here")
    text = files_in(query.strip().rstrip(";").strip())
    if not text.lower().startswith(_LISTING):
        spark.sql(f"SELECT * FROM (\n{text}\n)")
    return spark.sql(text).limit(limit)


@dataclass(frozen=True)
class Answer:
    """Outcome of an exploratory query: 'ok', 'empty' or 'error'."""

    status: str
    message: str
    rows: list


def answer(spark: SparkSession, query: str, limit: int = DEFAULT_LIMIT) -> Answer:
    """Run ``query`` now; no rows and errors come back as values."""
    try:
        rows = explore(spark, query, limit).collect()
    except Exception as error:
        return Answer("error", str(error).splitlines()[0], [])
    if not rows:
        return Answer("empty", "the query ran and returned no rows", [])
    return Answer("ok", f"{len(rows)} rows", rows)
