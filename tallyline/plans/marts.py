"""Marts: aggregates and wide tables over the star schema.

Quirks of the established definitions are kept, and named where they occur:
rates divide late *items* by distinct *orders*, and two marts count an item once
per review of its order.

Surrogate keys are hex digests and most of a narrow row. They go through the shuffles
as bytes, and those that follow from columns carried anyway are computed at the end;
a row whose key is another carries it (``unless_made``), so results are the same for
any keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import (
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
from .star import ORDER_TIMES


def _or_zero(*columns: str) -> list[Column]:
    return [F.coalesce(c, F.lit(0)).alias(c) for c in columns]


def mart_customer_reviews(
    fct_order_items: DataFrame, stg_olist_order_reviews: DataFrame, dim_customers: DataFrame
) -> DataFrame:
    """One row per item and review of its order: the pairs are the mart's grain.

    An unreadable score becomes 0; an order without a review has no row. The
    narrow item rows meet their customer first and the reviews, with their long
    texts and their fan-out, last, so the widened rows are never shuffled.
    """
    customer_sk = surrogate_key("customer_id")
    customers = dim_customers.select(
        packed("customer_sk"),
        unless_made("customer_sk", customer_sk),
        "customer_id",
        "customer_unique_id",
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    items = fct_order_items.select(
        "order_id",
        "order_item_id",
        packed("customer_sk"),
        packed("product_sk"),
        packed("seller_sk"),
        "is_delivery_delayed",
        "delivery_delay_days",
        "actual_delivery_duration_days",
        "estimated_delivery_duration_days",
        "item_price_usd",
        "freight_value_usd",
    )
    return (
        items.join(customers, "customer_sk")
        .join(stg_olist_order_reviews, "order_id")
        .select(
            "order_id",
            "order_item_id",
            made_or_kept("customer_sk", customer_sk),
            "customer_unique_id",
            "customer_city",
            "customer_state",
            "review_id",
            *_or_zero("review_score"),
            "review_comment_title",
            "review_comment_message",
            "review_creation_date",
            unpacked("product_sk"),
            unpacked("seller_sk"),
            "is_delivery_delayed",
            "delivery_delay_days",
            "actual_delivery_duration_days",
            "estimated_delivery_duration_days",
            "item_price_usd",
            "freight_value_usd",
        )
    )


def mart_logistics_network(
    fct_order_items: DataFrame, dim_customers: DataFrame, dim_sellers: DataFrame
) -> DataFrame:
    """Routes from seller state to customer state. ``total_delayed_orders`` counts
    items, and the rate divides it by distinct orders, in percent."""
    origins = dim_sellers.select(packed("seller_sk"), F.col("state").alias("origin_state"))
    destinations = dim_customers.select(
        packed("customer_sk"), F.col("state").alias("destination_state")
    )
    return (
        fct_order_items.withColumns({k: packed(k) for k in ("seller_sk", "customer_sk")})
        .join(origins, "seller_sk")
        .join(destinations, "customer_sk")
        .groupBy("origin_state", "destination_state")
        .agg(
            F.count_distinct("order_id").alias("total_orders_routed"),
            F.sum("freight_value_usd").alias("total_route_freight_usd"),
            F.avg("freight_value_usd").alias("avg_freight_per_item_usd"),
            F.avg("actual_delivery_duration_days").alias("avg_delivery_duration_days"),
            F.avg("estimated_delivery_duration_days").alias("avg_estimated_duration_days"),
            count_where(F.col("is_delivery_delayed")).alias("total_delayed_orders"),
        )
        .withColumn(
            "delay_rate_pct",
            ratio(F.col("total_delayed_orders") * 100.0, F.col("total_orders_routed")),
        )
    )


def mart_obt_customers(
    dim_customers: DataFrame, fct_orders: DataFrame, review_totals: DataFrame
) -> DataFrame:
    """One row per customer id, buyers or not. Dates and the average score stay
    NULL where there is nothing to report; counts and sums are 0.

    Orders and reviews reach the customer in a single aggregation: the review
    totals join at order grain first.
    """
    sums = ["total_items_value_usd", "total_freight_value_usd", "total_payment_value_usd"]
    activity = (
        fct_orders.join(review_totals, "order_id", "left")
        .groupBy("customer_sk")
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            *[F.sum(c).alias(c) for c in sums],
            F.min("order_purchase_timestamp").alias("first_order_date"),
            F.max("order_purchase_timestamp").alias("last_order_date"),
            ratio(F.sum("score_sum"), F.sum("n_scored")).alias("avg_review_score"),
            F.sum("n_review_ids").alias("total_reviews"),
        )
    )
    return dim_customers.join(activity, "customer_sk", "left").select(
        *dim_customers.columns,
        *_or_zero("total_orders", *sums),
        "first_order_date",
        "last_order_date",
        "avg_review_score",
        *_or_zero("total_reviews"),
    )


def mart_obt_orders(
    fct_order_items: DataFrame,
    fct_orders: DataFrame,
    dim_customers: DataFrame,
    dim_sellers: DataFrame,
    dim_products: DataFrame,
    review_totals: DataFrame,
) -> DataFrame:
    """One row per item with its order, customer, seller and product.

    Customer columns attach to the order, of which there are fewer than items; the
    item picks up product and seller while still narrow, the seller second, as it is the
    wider and more often the one that is broadcast. Orders and review totals
    join last and on the same key, so the widened rows are not shuffled again.
    """
    item_sk = line_key("order_id", "order_item_id")
    cost = F.col("item_price_usd") + F.col("freight_value_usd")
    days = days_between("order_purchase_timestamp", "order_delivered_customer_date")
    late = is_late("order_estimated_delivery_date", "order_delivered_customer_date")
    made = {
        "customer_sk": surrogate_key("customer_id"),
        "seller_sk": surrogate_key("seller_id"),
        "product_sk": surrogate_key("product_id"),
    }
    customers = dim_customers.select(
        packed("customer_sk"),
        unless_made("customer_sk", made["customer_sk"]),
        "customer_id",
        "customer_unique_id",
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )
    ordered = fct_orders.withColumn("customer_sk", packed("customer_sk"))
    orders = ordered.join(customers, "customer_sk").select(
        "order_id",
        "odd_customer_sk",
        "customer_id",
        "order_status",
        *ORDER_TIMES,
        F.col("total_payment_value_usd").alias("order_total_payment_usd"),
        "customer_unique_id",
        "customer_city",
        "customer_state",
        unless_made("actual_delivery_duration_days", days),
        unless_made("is_delivery_delayed", late),
    )
    reviews = review_totals.select(
        "order_id",
        F.col("max_score").alias("review_score"),
        F.col("last_created").alias("review_creation_date"),
    )
    sellers = dim_sellers.select(
        packed("seller_sk"),
        unless_made("seller_sk", made["seller_sk"]),
        "seller_id",
        F.col("city").alias("seller_city"),
        F.col("state").alias("seller_state"),
    )
    products = dim_products.select(
        packed("product_sk"),
        unless_made("product_sk", made["product_sk"]),
        "product_id",
        F.col("product_category_english").alias("product_category"),
        "product_weight_g",
    )
    items = fct_order_items.select(
        unless_made("order_item_sk", item_sk),
        "order_id",
        "order_item_id",
        packed("seller_sk"),
        packed("product_sk"),
        "item_price_usd",
        "freight_value_usd",
        unless_made("total_item_cost_usd", cost),
    )
    return (
        items.join(products, "product_sk")
        .join(sellers, "seller_sk")
        .join(unclustered(orders, "order_id"), "order_id")
        .join(reviews, "order_id", "left")
        .select(
            made_or_kept("order_item_sk", item_sk),
            "order_id",
            "order_item_id",
            *[made_or_kept(key, value) for key, value in made.items()],
            "order_status",
            *ORDER_TIMES,
            "item_price_usd",
            "freight_value_usd",
            made_or_kept("total_item_cost_usd", cost),
            "order_total_payment_usd",
            "customer_unique_id",
            "customer_city",
            "customer_state",
            "seller_id",
            "seller_city",
            "seller_state",
            "product_id",
            "product_category",
            "product_weight_g",
            made_or_kept("actual_delivery_duration_days", days),
            made_or_kept("is_delivery_delayed", late),
            "review_score",
            "review_creation_date",
        )
    )


def mart_obt_sellers(dim_sellers: DataFrame, reviewed_items: DataFrame) -> DataFrame:
    """One row per seller. Without sales ``total_delayed_orders`` and the averages
    are NULL while the other totals are 0. Scores weigh in once per item sold."""
    activity = (
        reviewed_items.groupBy("seller_sk").agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.count(F.when(F.col("has_key"), 1)).alias("total_items_sold"),
            F.sum("item_price_usd").alias("total_revenue_usd"),
            F.sum("freight_value_usd").alias("total_freight_charged_usd"),
            F.avg("actual_delivery_duration_days").alias("avg_delivery_duration_days"),
            count_where(F.col("is_delivery_delayed")).alias("total_delayed_orders"),
            ratio(F.sum("score_sum"), F.sum("n_scored")).alias("avg_review_score"),
            F.sum("n_negative").alias("total_negative_reviews"),
        )
    )
    late_pct = ratio(F.col("total_delayed_orders") * 100.0, F.col("total_orders"))
    sellers = dim_sellers.withColumn("seller_sk", packed("seller_sk"))
    return sellers.join(activity, "seller_sk", "left").select(
        *[unpacked(c) if c == "seller_sk" else c for c in dim_sellers.columns],
        *_or_zero(
            "total_orders",
            "total_items_sold",
            "total_revenue_usd",
            "total_freight_charged_usd",
        ),
        "avg_delivery_duration_days",
        "total_delayed_orders",
        F.coalesce(late_pct, F.lit(0.0)).alias("delay_rate_pct"),
        "avg_review_score",
        *_or_zero("total_negative_reviews"),
    )


def mart_payment_profiles(fct_order_payments: DataFrame, fct_orders: DataFrame) -> DataFrame:
    """Payment type and instalments. ``total_canceled_orders`` counts payments."""
    status = fct_orders.select("order_id", F.col("order_status").alias("status"))
    payments = fct_order_payments.select(
        "order_id",
        "payment_type",
        "payment_installments",
        "payment_value_usd",
        F.col("payment_sk").isNotNull().alias("has_key"),
    )
    return (
        payments.join(unclustered(status, "order_id"), "order_id")
        .groupBy("payment_type", "payment_installments")
        .agg(
            F.count(F.when(F.col("has_key"), 1)).alias("total_transactions"),
            F.count_distinct("order_id").alias("total_unique_orders"),
            F.sum("payment_value_usd").alias("total_revenue_usd"),
            F.avg("payment_value_usd").alias("avg_transaction_value_usd"),
            count_where(F.col("status") == "canceled").alias("total_canceled_orders"),
        )
    )


def _fan_out_sum(measure: str) -> Column:
    return F.sum(F.col(measure) * F.col("copies"))


def _fan_out_count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("copies")).otherwise(0))


def mart_product_performance(reviewed_items: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Sold products. Units, revenue and freight count an item once per review of
    its order.

    Sales are summed per product before the dimension joins, so a best seller
    reaches the join as one row.
    """
    sums = [
        "total_units_sold",
        "total_revenue_usd",
        "total_freight_generated_usd",
        "score_sum",
        "n_scored",
        "total_negative_reviews",
    ]
    sales = (
        reviewed_items.groupBy("product_sk").agg(
            _fan_out_count(F.col("has_key")).alias("total_units_sold"),
            _fan_out_sum("item_price_usd").alias("total_revenue_usd"),
            _fan_out_sum("freight_value_usd").alias("total_freight_generated_usd"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("n_scored").alias("n_scored"),
            F.coalesce(F.sum("n_negative"), F.lit(0)).alias("total_negative_reviews"),
        )
    )
    keys = [
        "product_sk",
        "product_id",
        "product_category",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ]
    # The second grouping only merges rows if the dimension repeats a product.
    products = dim_products.withColumn("product_sk", packed("product_sk"))
    return (
        sales.join(
            products.withColumnRenamed("product_category_english", "product_category"),
            "product_sk",
        )
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select(
            unpacked("product_sk"),
            *keys[1:],
            "total_units_sold",
            "total_revenue_usd",
            "total_freight_generated_usd",
            ratio(F.col("score_sum"), F.col("n_scored")).alias("avg_product_review_score"),
            "total_negative_reviews",
        )
    )


def mart_seller_sales(reviewed_items: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    """Sellers with sales, counting an item once per review of its order (orders
    stay distinct). ``delay_rate_pct`` is a fraction here, not a percentage."""
    sales = (
        reviewed_items.groupBy("seller_sk").agg(
            F.count_distinct("order_id").alias("total_orders"),
            _fan_out_count(F.col("has_key")).alias("total_items_sold"),
            _fan_out_sum("item_price_usd").alias("total_revenue_usd"),
            _fan_out_sum("freight_value_usd").alias("total_freight_charged_usd"),
            _fan_out_sum("actual_delivery_duration_days").alias("days_sum"),
            _fan_out_count(F.col("actual_delivery_duration_days").isNotNull()).alias("n_days"),
            _fan_out_count(F.col("is_delivery_delayed")).alias("total_delayed_orders"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("n_scored").alias("n_scored"),
            F.coalesce(F.sum("n_one_star"), F.lit(0)).alias("total_1_star_reviews"),
        )
    )
    keys = ["seller_sk", "seller_id", "seller_city", "seller_state"]
    sums = [c for c in sales.columns if c not in ("seller_sk", "total_orders")]
    # As for products: regrouping merges rows only for a repeated seller.
    sellers = dim_sellers.withColumn("seller_sk", packed("seller_sk"))
    return (
        sales.join(
            sellers.withColumnsRenamed({"city": "seller_city", "state": "seller_state"}),
            "seller_sk",
        )
        .groupBy(*keys)
        .agg(F.max("total_orders").alias("total_orders"), *[F.sum(c).alias(c) for c in sums])
        .select(
            unpacked("seller_sk"),
            *keys[1:],
            "total_orders",
            "total_items_sold",
            "total_revenue_usd",
            "total_freight_charged_usd",
            ratio(F.col("days_sum"), F.col("n_days")).alias("avg_delivery_duration_days"),
            "total_delayed_orders",
            ratio(F.col("total_delayed_orders"), F.col("total_orders")).alias("delay_rate_pct"),
            ratio(F.col("score_sum"), F.col("n_scored")).alias("avg_review_score"),
            "total_1_star_reviews",
        )
    )
