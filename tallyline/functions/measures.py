"""Column expressions shared by the star schema and the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate_key(natural_key: str | Column) -> Column:
    return F.md5(natural_key)


def line_key(parent: str | Column, position: str | Column) -> Column:
    """MD5 of ``parent-position``; NULL when either part is NULL."""
    position = F.col(position) if isinstance(position, str) else position
    return F.md5(F.concat(parent, F.lit("-"), position.cast("string")))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Signed number of midnights crossed from ``start`` to ``end``."""
    return F.datediff(end, start).cast("long")


def is_late(due: str, done: str) -> Column:
    """True only when ``done`` is known and after ``due``; never NULL."""
    return F.coalesce(F.col(done) > F.col(due), F.lit(False))


def count_where(condition: Column) -> Column:
    """Rows for which ``condition`` holds, as a summable 0/1 measure."""
    return F.sum(F.when(condition, 1).otherwise(0))


def ratio(part: Column, whole: Column) -> Column:
    """Floating division; NULL when ``whole`` is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def unclustered(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with the text ``keys`` as computed columns.

    Use it on the side of a join that is an aggregate or a join over the same keys,
    when a key of the other side may be hot. Spark splits a hot partition only if
    both inputs of the join come straight from a shuffle, and would skip the
    shuffle of a side it knows to be clustered already. A computed key hides that;
    the side, one row per key, is shuffled once more and the hot one can be split.
    """
    return df.withColumns({k: F.concat(k) for k in keys})


# Set behind a text that could be taken for a packed digest, or has the mark already.
_TEXT_MARK = bytes(17)


def packed(key: str | Column) -> Column:
    """A key as bytes for the way through a shuffle: 16 for MD5 in hex, which no codec of
    ours shrinks, and the text for anything else, with a mark behind it if it has 16 bytes
    or ends like the mark, so that equal bytes mean equal keys. NULL stays NULL. ``unhex``
    gives NULL for what is no hex; a regular expression would take longer than the rest."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.unhex(F.when((F.octet_length(c) == 32) & (c == F.lower(c)), c))
    text, mark = c.cast("binary"), F.lit(_TEXT_MARK)
    odd = (F.octet_length(c) == 16) | F.endswith(text, mark)
    whole = F.coalesce(digest, F.when(odd, F.concat(text, mark)).otherwise(text))
    return whole.alias(key) if isinstance(key, str) else whole


def unpacked(key: str) -> Column:
    """The text that ``packed`` was given."""
    c, n = F.col(key), F.octet_length(key)
    bare = F.substring(c, F.lit(1), n - len(_TEXT_MARK))
    text = F.when(F.endswith(c, F.lit(_TEXT_MARK)), bare).otherwise(c).cast("string")
    return F.when(n == 16, F.lower(F.hex(key))).otherwise(text).alias(key)


def unless_made(key: str, made: Column) -> Column:
    """``key`` where it is not what ``made`` computes from other columns, else NULL: what has
    to be carried along for ``made_or_kept``."""
    return F.when(~F.col(key).eqNullSafe(made), F.struct(F.col(key).alias("is"))).alias(f"odd_{key}")


def made_or_kept(key: str, made: Column) -> Column:
    odd = F.col(f"odd_{key}")
    return F.when(odd.isNull(), made).otherwise(odd["is"]).alias(key)
