"""Values that staging's lenient casts would silently drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cast_expr, ratio


def cast_loss(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column, values present in ``raw`` that its cast turns into NULL.

    ``types`` maps a column to 'int', 'double' or 'timestamp', read exactly as
    staging reads them. All columns are counted in one pass.
    """

    def facts(column: str, kind: str):
        present = F.col(column).isNotNull()
        unread = present & F.expr(cast_expr(raw, column, kind)).isNull()
        return F.struct(
            F.lit(column).alias("column"),
            F.lit(kind).alias("type"),
            F.count(F.when(present, 1)).alias("present"),
            F.count(F.when(unread, 1)).alias("lost"),
        )

    return (
        raw.agg(F.array(*[facts(c, k) for c, k in types.items()]).alias("facts"))
        .select(F.inline("facts"))
        .withColumn("loss_rate", ratio(F.col("lost"), F.col("present")))
    )
