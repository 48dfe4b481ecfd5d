"""Ready-made reports over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seller_classification(
    mart_obt_sellers: DataFrame, min_orders: int = 50, top: int = 15
) -> DataFrame:
    """Best-selling established sellers with a verdict on score and punctuality.

    Equal revenue and score are ordered by seller id, so the cut at ``top`` is
    always the same one. A seller without a score can only be flagged for delays.
    """
    score, late = F.col("avg_review_score"), F.col("delay_rate_pct")
    # Thresholds and labels of the established report.
    verdict = (
        F.when((score >= 4.5) & (late <= 5), "Super Seller (Excellent Score & Delivery)")
        .when((score <= 3.0) | (late >= 25), "High Risk / Rogue (Bad Score or Extreme Delays)")
        .otherwise("Standard Seller")
    )
    return (
        mart_obt_sellers.filter(F.col("total_orders") >= min_orders)
        .select(
            "seller_id",
            F.col("state").alias("seller_state"),
            "total_orders",
            F.round("total_revenue_usd", 2).alias("total_revenue_usd"),
            F.round(late, 1).alias("delay_rate_pct"),
            F.round(score, 2).alias("avg_review_score"),
            "total_negative_reviews",
            verdict.alias("seller_classification"),
        )
        .orderBy(
            F.col("total_revenue_usd").desc_nulls_last(),
            F.col("avg_review_score").asc_nulls_last(),
            "seller_id",
        )
        .limit(top)
    )


def customers_per_state(
    spark: SparkSession, path: str, state: str = "customer_state", top: int = 5
) -> DataFrame:
    """States with most customers, straight from a raw Parquet file."""
    return spark.sql(
        f"""
        SELECT `{state}` AS customer_state, count(*) AS total_customers
        FROM parquet.`{path}`
        GROUP BY 1
        ORDER BY 2 DESC, 1
        LIMIT {int(top)}
        """
    )
