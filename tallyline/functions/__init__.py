from .casts import CASTS, as_double, as_int, as_timestamp, cast_expr
from .measures import (
    count_where,
    days_between,
    is_late,
    line_key,
    made_or_kept,
    packed,
    ratio,
    surrogate_key,
    unclustered,
    unless_made,
    unpacked,
)

__all__ = [
    "CASTS",
    "as_double",
    "as_int",
    "as_timestamp",
    "cast_expr",
    "count_where",
    "days_between",
    "is_late",
    "line_key",
    "made_or_kept",
    "packed",
    "ratio",
    "surrogate_key",
    "unclustered",
    "unless_made",
    "unpacked",
]
