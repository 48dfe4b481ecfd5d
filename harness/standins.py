"""The driver's tables, reshaped into the raw order feeds.

Ids become text, as they are in the feeds; times arrive as text, one of them as a
bare date; some numbers arrive as text and some as numbers, so that every staging
cast has work to do. Undelivered orders carry an empty delivery time and reviews of
'error' events an unreadable score. ``oracle.FEEDS`` states the same mapping in SQL.
"""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.plans import Lazy
from tallyline.session import tune

# Categories with an English name; the others fall back to their own.
TRANSLATED = ("ECONOMY", "LARGE", "MEDIUM", "PROMO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _days(column: str, n: int) -> Column:
    return F.col(column) + F.expr(f"INTERVAL '{n}' DAY")


def feeds(spark: SparkSession, sf_dir: str) -> Lazy:
    """Every table of the pipeline over the driver's data, lazily."""
    tune(spark, sf_dir)
    open_table = cache(partial(table, spark, sf_dir))
    return Lazy({name: partial(make, open_table) for name, make in FEEDS.items()})


def _orders(t) -> DataFrame:
    # Matched by key and by key as a struct: the sums are clustered by the struct alone,
    # so Spark shuffles both sides and can split an order key that repeats, yet still
    # drops the join where no delivery time is used.
    shipped = (
        t("lineitem")
        .groupBy(F.struct("l_orderkey").alias("key"))
        .agg(F.max("l_shipdate").alias("shipped"))
    )
    same_order = (F.col("o_orderkey") == F.col("key.l_orderkey")) & (
        F.struct(F.col("o_orderkey").alias("l_orderkey")) == F.col("key")
    )
    delivered = F.when(F.col("o_orderstatus") == "F", F.col("shipped"))
    return (
        t("orders")
        .join(shipped, same_order, "left")
        .select(
            _text("o_orderkey").alias("order_id"),
            _text("o_custkey").alias("customer_id"),
            F.when(F.col("o_orderstatus") == "F", "delivered")
            .when(F.col("o_orderstatus") == "O", "shipped")
            .otherwise("canceled")
            .alias("order_status"),
            _text("o_orderdate").alias("order_purchase_timestamp"),
            _text(_days("o_orderdate", 1)).alias("order_approved_at"),
            _text((delivered - F.expr("INTERVAL '2' DAY")).cast("date")).alias(
                "order_delivered_carrier_date"
            ),
            F.coalesce(_text(delivered), F.lit("")).alias("order_delivered_customer_date"),
            _text(_days("o_orderdate", 60)).alias("order_estimated_delivery_date"),
        )
    )


def _order_items(t) -> DataFrame:
    return t("lineitem").select(
        _text("l_orderkey").alias("order_id"),
        _text("l_linenumber").alias("order_item_id"),
        _text("l_partkey").alias("product_id"),
        _text("l_suppkey").alias("seller_id"),
        _text("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        _text("l_quantity").alias("freight_value"),
    )


def _order_payments(t) -> DataFrame:
    return t("lineitem").select(
        _text("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        _text(F.col("l_quantity") % 12).alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )


def _order_reviews(t) -> DataFrame:
    return t("events").select(
        _text("event_id").alias("review_id"),
        _text(F.col("event_id") - F.col("event_id") % 2).alias("order_id"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(_text(1 + F.col("event_id") % 5))
        .alias("review_score"),
        F.col("event_type").alias("review_comment_title"),
        F.col("props").alias("review_comment_message"),
        _text("ts").alias("review_creation_date"),
        _text(_days("ts", 1)).alias("review_answer_timestamp"),
    )


def _nation_name(t, key: str) -> Column:
    """Name of a nation, NULL if unknown. The table has a fixed 25 rows and is read as
    one map: after a join Spark could no longer tell how small a dimension is."""
    entry = F.struct("n_nationkey", "n_name")
    names = t("nation").agg(F.map_from_entries(F.collect_list(entry))).scalar()
    return F.element_at(names, F.col(key))


def _customers(t) -> DataFrame:
    return (
        t("customer")
        .select(
            _text("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            _text("c_nationkey").alias("customer_zip_code_prefix"),
            F.col("c_mktsegment").alias("customer_city"),
            _nation_name(t, "c_nationkey").alias("customer_state"),
        )
        .filter(F.col("customer_state").isNotNull())
    )


def _sellers(t) -> DataFrame:
    return (
        t("supplier")
        .select(
            _text("s_suppkey").alias("seller_id"),
            _text("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("s_name").alias("seller_city"),
            _nation_name(t, "s_nationkey").alias("seller_state"),
        )
        .filter(F.col("seller_state").isNotNull())
    )


def _products(t) -> DataFrame:
    size = F.col("p_size")
    return t("part").select(
        _text("p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit("STANDARD")).alias("product_category_name"),
        _text(size * F.lit(1.5)).alias("product_name_lenght"),
        (size * F.lit(2.5)).alias("product_description_lenght"),
        (size % 7).cast("long").alias("product_photos_qty"),
        _text(size).alias("product_weight_g"),
        F.col("p_retailprice").alias("product_length_cm"),
        (size * 2).alias("product_height_cm"),
        F.when(size > 10, size.cast("double")).alias("product_width_cm"),
    )


def _geolocation(t) -> DataFrame:
    return t("customer").select(
        _text("c_nationkey").alias("geolocation_zip_code_prefix"),
        F.col("c_acctbal").alias("geolocation_lat"),
        (F.col("c_acctbal") * 2).alias("geolocation_lng"),
        F.col("c_name").alias("geolocation_city"),
        F.col("c_mktsegment").alias("geolocation_state"),
    )


def _translation(t) -> DataFrame:
    return (
        t("part")
        .filter(F.col("p_type").isin(*TRANSLATED))
        .select(
            F.col("p_type").alias("product_category_name"),
            F.lower("p_type").alias("product_category_name_english"),
        )
        .distinct()
    )


FEEDS = {
    "olist_orders": _orders,
    "olist_order_items": _order_items,
    "olist_order_payments": _order_payments,
    "olist_order_reviews": _order_reviews,
    "olist_customers": _customers,
    "olist_sellers": _sellers,
    "olist_products": _products,
    "olist_geolocation": _geolocation,
    "product_category_name_translation": _translation,
}
