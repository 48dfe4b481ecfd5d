"""Star schema: four dimensions, three facts and the per-order review totals.

Each function takes its parent tables and returns the lazy DataFrame; parameter
names are table names, which is how the pipeline finds the parents.

Joins carry no hints. Which side is small is not known here: Spark broadcasts a
side whose size it has checked against ``spark.sql.autoBroadcastJoinThreshold``
and otherwise shuffles, splitting hot keys at run time (``session.tune``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    count_where,
    days_between,
    is_late,
    line_key,
    packed,
    surrogate_key,
    unclustered,
)

ORDER_TIMES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def _place(df: DataFrame, prefix: str) -> list:
    """The address columns of a customer or seller, without the prefix."""
    return [
        F.col(f"{prefix}_{c}").alias(c) for c in ("zip_code_prefix", "city", "state")
    ]


def dim_customers(stg_olist_customers: DataFrame) -> DataFrame:
    return stg_olist_customers.select(
        surrogate_key("customer_id").alias("customer_sk"),
        "customer_id",
        "customer_unique_id",
        *_place(stg_olist_customers, "customer"),
    )


def dim_sellers(stg_olist_sellers: DataFrame) -> DataFrame:
    return stg_olist_sellers.select(
        surrogate_key("seller_id").alias("seller_sk"),
        "seller_id",
        *_place(stg_olist_sellers, "seller"),
    )


def dim_products(
    stg_olist_products: DataFrame, stg_olist_category_translation: DataFrame
) -> DataFrame:
    """Products with an English category, else the native one, else 'unknown'."""
    described = ("product_id", "product_category_name")
    measures = [c for c in stg_olist_products.columns if c not in described]
    return stg_olist_products.join(
        stg_olist_category_translation, "product_category_name", "left"
    ).select(
        surrogate_key("product_id").alias("product_sk"),
        "product_id",
        "product_category_name",
        F.coalesce(
            "product_category_name_english", "product_category_name", F.lit("unknown")
        ).alias("product_category_english"),
        *measures,
    )


def dim_locations(stg_olist_geolocation: DataFrame) -> DataFrame:
    """One row per zip code. City and state are maxima taken independently, so a
    pair need not occur in the data."""
    return stg_olist_geolocation.groupBy(
        F.col("geolocation_zip_code_prefix").alias("zip_code_prefix")
    ).agg(
        F.max("geolocation_city").alias("city"),
        F.max("geolocation_state").alias("state"),
        F.avg("geolocation_lat").alias("latitude"),
        F.avg("geolocation_lng").alias("longitude"),
    )


def fct_order_items(
    stg_olist_order_items: DataFrame, stg_olist_orders: DataFrame
) -> DataFrame:
    """One row per item whose order exists. An order without a delivery date is
    not late, however old it is.

    Keys are hashed after the join, so the wider hashes are not shuffled.
    """
    orders = stg_olist_orders.select(
        "order_id",
        "customer_id",
        "order_status",
        *ORDER_TIMES,
    )
    purchased, due, delivered = (
        "order_purchase_timestamp",
        "order_estimated_delivery_date",
        "order_delivered_customer_date",
    )
    return stg_olist_order_items.join(orders, "order_id").select(
        line_key("order_id", "order_item_id").alias("order_item_sk"),
        "order_id",
        "order_item_id",
        surrogate_key("customer_id").alias("customer_sk"),
        surrogate_key("product_id").alias("product_sk"),
        surrogate_key("seller_id").alias("seller_sk"),
        "order_status",
        F.col("price").alias("item_price_usd"),
        F.col("freight_value").alias("freight_value_usd"),
        (F.col("price") + F.col("freight_value")).alias("total_item_cost_usd"),
        *ORDER_TIMES,
        "shipping_limit_date",
        days_between(purchased, delivered).alias("actual_delivery_duration_days"),
        days_between(purchased, due).alias("estimated_delivery_duration_days"),
        days_between(due, delivered).alias("delivery_delay_days"),
        is_late(due, delivered).alias("is_delivery_delayed"),
    )


def fct_order_payments(
    stg_olist_order_payments: DataFrame, stg_olist_orders: DataFrame
) -> DataFrame:
    """One row per payment whose order exists."""
    orders = stg_olist_orders.select(
        "order_id", "customer_id", "order_purchase_timestamp", "order_status"
    )
    return stg_olist_order_payments.join(orders, "order_id").select(
        line_key("order_id", "payment_sequential").alias("payment_sk"),
        "order_id",
        surrogate_key("customer_id").alias("customer_sk"),
        "payment_sequential",
        "payment_type",
        "payment_installments",
        F.col("payment_value").alias("payment_value_usd"),
        "order_purchase_timestamp",
        "order_status",
    )


def fct_orders(
    stg_olist_orders: DataFrame,
    stg_olist_order_items: DataFrame,
    stg_olist_order_payments: DataFrame,
) -> DataFrame:
    """One row per order, with item and payment totals (0 where there are none).

    Items and payments are stacked and summed per order in one aggregation, so
    neither can multiply the other, a hot order shrinks in the map tasks, and the
    orders need a single join. They match by key and by key as a struct: the totals
    are clustered by the struct alone, so Spark shuffles both sides and can split a
    hot key, yet still drops the join for a mart that uses no totals.
    """
    lines = stg_olist_order_items.select(
        "order_id", "order_item_id", "price", "freight_value"
    ).unionByName(
        stg_olist_order_payments.select("order_id", "payment_value"), allowMissingColumns=True
    )
    totals = lines.groupBy(F.struct("order_id").alias("key")).agg(
        F.count("order_item_id").alias("total_items"),
        F.sum("price").alias("total_items_value_usd"),
        F.sum("freight_value").alias("total_freight_value_usd"),
        F.sum("payment_value").alias("total_payment_value_usd"),
    )
    same_order = (F.col("order_id") == F.col("key.order_id")) & (
        F.struct("order_id") == F.col("key")
    )
    return stg_olist_orders.join(totals, same_order, "left").select(
        "order_id",
        surrogate_key("customer_id").alias("customer_sk"),
        "order_status",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in totals.columns if c != "key"],
        *ORDER_TIMES,
        days_between("order_purchase_timestamp", "order_delivered_customer_date").alias(
            "actual_delivery_duration_days"
        ),
        is_late("order_estimated_delivery_date", "order_delivered_customer_date").alias(
            "is_delivery_delayed"
        ),
    )


def review_totals(stg_olist_order_reviews: DataFrame) -> DataFrame:
    """Everything the marts need to know about an order's reviews, one row per order.

    Five marts relate orders or items to reviews only to count and average them.
    Joining these totals gives the same sums as joining the reviews themselves,
    without ever producing the item x review rows.
    """
    score = F.col("review_score")
    totals = stg_olist_order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("review_id").alias("n_review_ids"),
        F.count(score).alias("n_scored"),
        F.sum(score).alias("score_sum"),
        count_where(score == 1).alias("n_one_star"),
        count_where(score <= 2).alias("n_negative"),
        F.max(score).alias("max_score"),
        F.max("review_creation_date").alias("last_created"),
    )
    return unclustered(totals, "order_id")


def reviewed_items(fct_order_items: DataFrame, review_totals: DataFrame) -> DataFrame:
    """Items with their order's review totals, for the marts that count items by seller
    or product. Stored once, it spares each of them the join of the largest fact.

    ``copies`` is the number of rows an item has after a left join to the reviews: one
    per review, at least one. Of an item's own key the marts ask only whether there is one,
    ``has_key``; the others are packed, as the marts compare and shuffle them.
    """
    items = fct_order_items.select(
        F.col("order_item_sk").isNotNull().alias("has_key"),
        "order_id",
        packed("seller_sk"),
        packed("product_sk"),
        "item_price_usd",
        "freight_value_usd",
        "actual_delivery_duration_days",
        "is_delivery_delayed",
    )
    totals = review_totals.drop("n_review_ids", "max_score", "last_created")
    return items.join(totals, "order_id", "left").withColumn(
        "copies", F.coalesce("n_reviews", F.lit(1))
    )
