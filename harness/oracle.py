"""The same queries in DuckDB SQL, stated independently of the Spark plans.

Tables are named subqueries; ``sql`` puts a query together with just those it
needs. The marts join the reviews row by row here, so the totals the Spark plans
use instead are checked against the plain definition.
"""

from __future__ import annotations

import re

from tallyline.plans import PUBLISHED, TABLES

from .catalogue import AS_OF, MODELS, PERIODS
from .standins import TRANSLATED

FEEDS = {
    "olist_orders": """
        SELECT o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                    ELSE 'canceled' END AS order_status,
               o_orderdate::VARCHAR AS order_purchase_timestamp,
               (o_orderdate + INTERVAL 1 DAY)::VARCHAR AS order_approved_at,
               (CASE o_orderstatus WHEN 'F' THEN shipped END - INTERVAL 2 DAY)::DATE::VARCHAR
                    AS order_delivered_carrier_date,
               coalesce(CASE o_orderstatus WHEN 'F' THEN shipped END::VARCHAR, '')
                    AS order_delivered_customer_date,
               (o_orderdate + INTERVAL 60 DAY)::VARCHAR AS order_estimated_delivery_date
        FROM orders
        LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY ALL)
          ON l_orderkey = o_orderkey""",
    "olist_order_items": """
        SELECT l_orderkey::VARCHAR AS order_id, l_linenumber::VARCHAR AS order_item_id,
               l_partkey::VARCHAR AS product_id, l_suppkey::VARCHAR AS seller_id,
               l_shipdate::VARCHAR AS shipping_limit_date, l_extendedprice AS price,
               l_quantity::VARCHAR AS freight_value
        FROM lineitem""",
    "olist_order_payments": """
        SELECT l_orderkey::VARCHAR AS order_id, l_linenumber::BIGINT AS payment_sequential,
               l_returnflag AS payment_type, (l_quantity % 12)::VARCHAR AS payment_installments,
               l_extendedprice AS payment_value
        FROM lineitem""",
    "olist_order_reviews": """
        SELECT event_id::VARCHAR AS review_id,
               (event_id - event_id % 2)::VARCHAR AS order_id,
               CASE event_type WHEN 'error' THEN 'n/a' ELSE (1 + event_id % 5)::VARCHAR END
                    AS review_score,
               event_type AS review_comment_title, props AS review_comment_message,
               ts::VARCHAR AS review_creation_date,
               (ts + INTERVAL 1 DAY)::VARCHAR AS review_answer_timestamp
        FROM events""",
    "olist_customers": """
        SELECT c_custkey::VARCHAR AS customer_id, c_name AS customer_unique_id,
               c_nationkey::VARCHAR AS customer_zip_code_prefix,
               c_mktsegment AS customer_city, n_name AS customer_state
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "olist_sellers": """
        SELECT s_suppkey::VARCHAR AS seller_id,
               s_nationkey::VARCHAR AS seller_zip_code_prefix,
               s_name AS seller_city, n_name AS seller_state
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "olist_products": """
        SELECT p_partkey::VARCHAR AS product_id,
               nullif(p_type, 'STANDARD') AS product_category_name,
               (p_size * 1.5::DOUBLE)::VARCHAR AS product_name_lenght,
               p_size * 2.5::DOUBLE AS product_description_lenght,
               (p_size % 7)::BIGINT AS product_photos_qty, p_size::VARCHAR AS product_weight_g,
               p_retailprice AS product_length_cm, p_size * 2 AS product_height_cm,
               CASE WHEN p_size > 10 THEN p_size::DOUBLE END AS product_width_cm
        FROM part""",
    "olist_geolocation": """
        SELECT c_nationkey::VARCHAR AS geolocation_zip_code_prefix,
               c_acctbal AS geolocation_lat, c_acctbal * 2 AS geolocation_lng,
               c_name AS geolocation_city, c_mktsegment AS geolocation_state
        FROM customer""",
    "product_category_name_translation": f"""
        SELECT DISTINCT p_type AS product_category_name,
               lower(p_type) AS product_category_name_english
        FROM part WHERE p_type IN {TRANSLATED}""",
}

_STAMPS = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def _casts(kind: str, *columns: str) -> str:
    return ", ".join(f"TRY_CAST({c} AS {kind}) AS {c}" for c in columns)


STAGING = {
    "stg_olist_orders": f"""
        SELECT * REPLACE ({_casts("TIMESTAMP", *_STAMPS)}) FROM olist_orders""",
    "stg_olist_order_items": f"""
        SELECT * REPLACE ({_casts("INTEGER", "order_item_id")},
                          {_casts("TIMESTAMP", "shipping_limit_date")},
                          {_casts("DOUBLE", "price", "freight_value")})
        FROM olist_order_items""",
    "stg_olist_order_payments": f"""
        SELECT * REPLACE ({_casts("INTEGER", "payment_sequential", "payment_installments")},
                          {_casts("DOUBLE", "payment_value")})
        FROM olist_order_payments""",
    "stg_olist_order_reviews": f"""
        SELECT * REPLACE ({_casts("INTEGER", "review_score")},
                          {_casts("TIMESTAMP", "review_creation_date", "review_answer_timestamp")})
        FROM olist_order_reviews""",
    "stg_olist_products": """
        SELECT product_id, product_category_name,
               TRY_CAST(product_name_lenght AS INTEGER) AS product_name_length,
               TRY_CAST(product_description_lenght AS INTEGER) AS product_description_length,
               TRY_CAST(product_photos_qty AS INTEGER) AS product_photos_qty,
               TRY_CAST(product_weight_g AS DOUBLE) AS product_weight_g,
               TRY_CAST(product_length_cm AS DOUBLE) AS product_length_cm,
               TRY_CAST(product_height_cm AS DOUBLE) AS product_height_cm,
               TRY_CAST(product_width_cm AS DOUBLE) AS product_width_cm
        FROM olist_products""",
    "stg_olist_customers": "SELECT * FROM olist_customers",
    "stg_olist_sellers": "SELECT * FROM olist_sellers",
    "stg_olist_geolocation": "SELECT * FROM olist_geolocation",
    "stg_olist_category_translation": "SELECT * FROM product_category_name_translation",
}

_LATE = "coalesce(order_delivered_customer_date > order_estimated_delivery_date, false)"

STAR = {
    "dim_customers": """
        SELECT md5(customer_id) AS customer_sk, customer_id, customer_unique_id,
               customer_zip_code_prefix AS zip_code_prefix, customer_city AS city,
               customer_state AS state
        FROM stg_olist_customers""",
    "dim_sellers": """
        SELECT md5(seller_id) AS seller_sk, seller_id,
               seller_zip_code_prefix AS zip_code_prefix, seller_city AS city,
               seller_state AS state
        FROM stg_olist_sellers""",
    "dim_products": """
        SELECT md5(product_id) AS product_sk, p.* EXCLUDE (product_category_name),
               p.product_category_name,
               coalesce(product_category_name_english, p.product_category_name, 'unknown')
                   AS product_category_english
        FROM stg_olist_products p
        LEFT JOIN stg_olist_category_translation t
          ON t.product_category_name = p.product_category_name""",
    "dim_locations": """
        SELECT geolocation_zip_code_prefix AS zip_code_prefix, max(geolocation_city) AS city,
               max(geolocation_state) AS state, avg(geolocation_lat) AS latitude,
               avg(geolocation_lng) AS longitude
        FROM stg_olist_geolocation GROUP BY ALL""",
    "fct_order_items": f"""
        SELECT md5(order_id || '-' || order_item_id) AS order_item_sk, order_id, order_item_id,
               md5(customer_id) AS customer_sk, md5(product_id) AS product_sk,
               md5(seller_id) AS seller_sk, order_status, price AS item_price_usd,
               freight_value AS freight_value_usd,
               price + freight_value AS total_item_cost_usd, {", ".join(_STAMPS)},
               shipping_limit_date,
               order_delivered_customer_date::DATE - order_purchase_timestamp::DATE
                   AS actual_delivery_duration_days,
               order_estimated_delivery_date::DATE - order_purchase_timestamp::DATE
                   AS estimated_delivery_duration_days,
               order_delivered_customer_date::DATE - order_estimated_delivery_date::DATE
                   AS delivery_delay_days,
               {_LATE} AS is_delivery_delayed
        FROM stg_olist_order_items JOIN stg_olist_orders USING (order_id)""",
    "fct_order_payments": """
        SELECT md5(order_id || '-' || payment_sequential) AS payment_sk, order_id,
               md5(customer_id) AS customer_sk, payment_sequential, payment_type,
               payment_installments, payment_value AS payment_value_usd,
               order_purchase_timestamp, order_status
        FROM stg_olist_order_payments JOIN stg_olist_orders USING (order_id)""",
    "fct_orders": f"""
        SELECT o.order_id, md5(customer_id) AS customer_sk, order_status,
               coalesce(n, 0) AS total_items,
               coalesce(value, 0) AS total_items_value_usd,
               coalesce(freight, 0) AS total_freight_value_usd,
               coalesce(paid, 0) AS total_payment_value_usd, {", ".join(_STAMPS)},
               order_delivered_customer_date::DATE - order_purchase_timestamp::DATE
                   AS actual_delivery_duration_days,
               {_LATE} AS is_delivery_delayed
        FROM stg_olist_orders o
        LEFT JOIN (SELECT order_id, count(order_item_id) AS n, sum(price) AS value,
                          sum(freight_value) AS freight
                   FROM stg_olist_order_items GROUP BY ALL) i ON i.order_id = o.order_id
        LEFT JOIN (SELECT order_id, sum(payment_value) AS paid
                   FROM stg_olist_order_payments GROUP BY ALL) p ON p.order_id = o.order_id""",
}

MARTS = {
    "mart_customer_reviews": """
        SELECT order_id, order_item_id, customer_sk, customer_unique_id,
               c.city AS customer_city, c.state AS customer_state, review_id,
               coalesce(review_score, 0) AS review_score, review_comment_title,
               review_comment_message, review_creation_date, product_sk, seller_sk,
               is_delivery_delayed, delivery_delay_days, actual_delivery_duration_days,
               estimated_delivery_duration_days, item_price_usd, freight_value_usd
        FROM fct_order_items
        JOIN dim_customers c USING (customer_sk)
        JOIN stg_olist_order_reviews USING (order_id)""",
    "mart_logistics_network": """
        SELECT s.state AS origin_state, c.state AS destination_state,
               count(DISTINCT order_id) AS total_orders_routed,
               sum(freight_value_usd) AS total_route_freight_usd,
               avg(freight_value_usd) AS avg_freight_per_item_usd,
               avg(actual_delivery_duration_days) AS avg_delivery_duration_days,
               avg(estimated_delivery_duration_days) AS avg_estimated_duration_days,
               count(*) FILTER (WHERE is_delivery_delayed) AS total_delayed_orders,
               100.0::DOUBLE * count(*) FILTER (WHERE is_delivery_delayed)
                   / count(DISTINCT order_id) AS delay_rate_pct
        FROM fct_order_items
        JOIN dim_sellers s USING (seller_sk)
        JOIN dim_customers c USING (customer_sk)
        GROUP BY ALL""",
    "mart_obt_customers": """
        SELECT c.*, coalesce(bought.total_orders, 0) AS total_orders,
               coalesce(bought.items_value, 0) AS total_items_value_usd,
               coalesce(bought.freight, 0) AS total_freight_value_usd,
               coalesce(bought.paid, 0) AS total_payment_value_usd,
               first_order_date, last_order_date, avg_review_score,
               coalesce(judged.total_reviews, 0) AS total_reviews
        FROM dim_customers c
        LEFT JOIN (SELECT customer_sk, count(DISTINCT order_id) AS total_orders,
                          sum(total_items_value_usd) AS items_value,
                          sum(total_freight_value_usd) AS freight,
                          sum(total_payment_value_usd) AS paid,
                          min(order_purchase_timestamp) AS first_order_date,
                          max(order_purchase_timestamp) AS last_order_date
                   FROM fct_orders GROUP BY ALL) bought USING (customer_sk)
        LEFT JOIN (SELECT customer_sk, avg(review_score) AS avg_review_score,
                          count(review_id) AS total_reviews
                   FROM fct_orders JOIN stg_olist_order_reviews USING (order_id)
                   GROUP BY ALL) judged USING (customer_sk)""",
    "mart_obt_orders": f"""
        SELECT i.order_item_sk, i.order_id, i.order_item_id, o.customer_sk, i.seller_sk,
               i.product_sk, o.order_status, {", ".join("o." + c for c in _STAMPS)},
               i.item_price_usd, i.freight_value_usd, i.total_item_cost_usd,
               o.total_payment_value_usd AS order_total_payment_usd,
               c.customer_unique_id, c.city AS customer_city, c.state AS customer_state,
               s.seller_id, s.city AS seller_city, s.state AS seller_state, p.product_id,
               p.product_category_english AS product_category, p.product_weight_g,
               o.actual_delivery_duration_days, o.is_delivery_delayed,
               r.score AS review_score, r.created AS review_creation_date
        FROM fct_order_items i
        JOIN fct_orders o USING (order_id)
        JOIN dim_customers c ON c.customer_sk = o.customer_sk
        JOIN dim_sellers s ON s.seller_sk = i.seller_sk
        JOIN dim_products p ON p.product_sk = i.product_sk
        LEFT JOIN (SELECT order_id, max(review_score) AS score,
                          max(review_creation_date) AS created
                   FROM stg_olist_order_reviews GROUP BY ALL) r ON r.order_id = i.order_id""",
    "mart_obt_sellers": """
        SELECT s.*, coalesce(sold.orders, 0) AS total_orders,
               coalesce(sold.items, 0) AS total_items_sold,
               coalesce(sold.revenue, 0) AS total_revenue_usd,
               coalesce(sold.freight, 0) AS total_freight_charged_usd,
               sold.days AS avg_delivery_duration_days, sold.late AS total_delayed_orders,
               CASE WHEN sold.orders > 0 THEN 100.0::DOUBLE * sold.late / sold.orders ELSE 0 END
                   AS delay_rate_pct,
               judged.score AS avg_review_score,
               coalesce(judged.bad, 0) AS total_negative_reviews
        FROM dim_sellers s
        LEFT JOIN (SELECT seller_sk, count(DISTINCT order_id) AS orders,
                          count(order_item_sk) AS items, sum(item_price_usd) AS revenue,
                          sum(freight_value_usd) AS freight,
                          avg(actual_delivery_duration_days) AS days,
                          count(*) FILTER (WHERE is_delivery_delayed) AS late
                   FROM fct_order_items GROUP BY ALL) sold USING (seller_sk)
        LEFT JOIN (SELECT seller_sk, avg(review_score) AS score,
                          count(*) FILTER (WHERE review_score <= 2) AS bad
                   FROM fct_order_items JOIN stg_olist_order_reviews USING (order_id)
                   GROUP BY ALL) judged USING (seller_sk)""",
    "mart_payment_profiles": """
        SELECT p.payment_type, p.payment_installments, count(p.payment_sk) AS total_transactions,
               count(DISTINCT order_id) AS total_unique_orders,
               sum(p.payment_value_usd) AS total_revenue_usd,
               avg(p.payment_value_usd) AS avg_transaction_value_usd,
               count(*) FILTER (WHERE o.order_status = 'canceled') AS total_canceled_orders
        FROM fct_order_payments p JOIN fct_orders o USING (order_id)
        GROUP BY ALL""",
    "mart_product_performance": """
        SELECT product_sk, p.product_id, p.product_category_english AS product_category,
               p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
               count(order_item_sk) AS total_units_sold,
               sum(item_price_usd) AS total_revenue_usd,
               sum(freight_value_usd) AS total_freight_generated_usd,
               avg(review_score) AS avg_product_review_score,
               count(*) FILTER (WHERE review_score <= 2) AS total_negative_reviews
        FROM fct_order_items
        JOIN dim_products p USING (product_sk)
        LEFT JOIN stg_olist_order_reviews USING (order_id)
        GROUP BY ALL""",
    "mart_seller_sales": """
        SELECT seller_sk, s.seller_id, s.city AS seller_city, s.state AS seller_state,
               count(DISTINCT order_id) AS total_orders,
               count(order_item_sk) AS total_items_sold,
               sum(item_price_usd) AS total_revenue_usd,
               sum(freight_value_usd) AS total_freight_charged_usd,
               avg(actual_delivery_duration_days) AS avg_delivery_duration_days,
               count(*) FILTER (WHERE is_delivery_delayed) AS total_delayed_orders,
               count(*) FILTER (WHERE is_delivery_delayed) / count(DISTINCT order_id)
                   AS delay_rate_pct,
               avg(review_score) AS avg_review_score,
               count(*) FILTER (WHERE review_score = 1) AS total_1_star_reviews
        FROM fct_order_items
        JOIN dim_sellers s USING (seller_sk)
        LEFT JOIN stg_olist_order_reviews USING (order_id)
        GROUP BY ALL""",
}

RELATIONS = {**FEEDS, **STAGING, **STAR, **MARTS}


# Published width of every table.
N_COLUMNS = {
    "stg_olist_customers": 5,
    "stg_olist_geolocation": 5,
    "stg_olist_order_items": 7,
    "stg_olist_order_payments": 5,
    "stg_olist_order_reviews": 7,
    "stg_olist_orders": 8,
    "stg_olist_products": 9,
    "stg_olist_sellers": 4,
    "stg_olist_category_translation": 2,
    "dim_customers": 6,
    "dim_sellers": 5,
    "dim_products": 11,
    "dim_locations": 5,
    "fct_order_items": 20,
    "fct_order_payments": 9,
    "fct_orders": 14,
    "mart_customer_reviews": 19,
    "mart_logistics_network": 9,
    "mart_obt_customers": 14,
    "mart_obt_orders": 29,
    "mart_obt_sellers": 14,
    "mart_payment_profiles": 7,
    "mart_product_performance": 12,
    "mart_seller_sales": 13,
}


def _needed(text: str) -> list[str]:
    """Relations ``text`` refers to, directly or not, in definition order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        new = (words & set(RELATIONS)) - found
        found |= new
        todo += [RELATIONS[name] for name in new]
    return [name for name in RELATIONS if name in found]


def sql(query: str, doubles: tuple[str, ...] = ()) -> str:
    """``query`` with the relations it needs, ``doubles`` rounded to 4 places."""
    ctes = ",\n".join(f"{name} AS ({RELATIONS[name]})" for name in _needed(query))
    rounding = ", ".join(f'round("{c}", 4) + 0.0::DOUBLE AS "{c}"' for c in doubles)
    replace = f" REPLACE ({rounding})" if rounding else ""
    head = f"WITH {ctes}\n" if ctes else ""
    return f"{head}SELECT *{replace} FROM ({query}\n)"


# Floating columns of each table.
_DOUBLES = {
    "stg_olist_order_items": "price freight_value",
    "stg_olist_order_payments": "payment_value",
    "stg_olist_products": "product_weight_g product_length_cm product_height_cm product_width_cm",
    "stg_olist_geolocation": "geolocation_lat geolocation_lng",
    "dim_products": "product_weight_g product_length_cm product_height_cm product_width_cm",
    "dim_locations": "latitude longitude",
    "fct_order_items": "item_price_usd freight_value_usd total_item_cost_usd",
    "fct_order_payments": "payment_value_usd",
    "fct_orders": "total_items_value_usd total_freight_value_usd total_payment_value_usd",
    "mart_customer_reviews": "item_price_usd freight_value_usd",
    "mart_logistics_network": "total_route_freight_usd avg_freight_per_item_usd"
    " avg_delivery_duration_days avg_estimated_duration_days delay_rate_pct",
    "mart_obt_customers": "total_items_value_usd total_freight_value_usd"
    " total_payment_value_usd avg_review_score",
    "mart_obt_orders": "item_price_usd freight_value_usd total_item_cost_usd"
    " order_total_payment_usd product_weight_g",
    "mart_obt_sellers": "total_revenue_usd total_freight_charged_usd"
    " avg_delivery_duration_days delay_rate_pct avg_review_score",
    "mart_payment_profiles": "total_revenue_usd avg_transaction_value_usd",
    "mart_product_performance": "product_weight_g product_length_cm product_height_cm"
    " product_width_cm total_revenue_usd total_freight_generated_usd avg_product_review_score",
    "mart_seller_sales": "total_revenue_usd total_freight_charged_usd"
    " avg_delivery_duration_days delay_rate_pct avg_review_score",
}


# Every step of the pipeline: parent, child, key columns (parent=child where they differ),
# and after a slash the columns whose totals should agree.
_LINEAGE = """
olist_customers stg_olist_customers customer_id
olist_geolocation stg_olist_geolocation geolocation_zip_code_prefix
olist_order_items stg_olist_order_items order_id
olist_order_payments stg_olist_order_payments order_id
olist_order_reviews stg_olist_order_reviews review_id
olist_orders stg_olist_orders order_id
olist_products stg_olist_products product_id
olist_sellers stg_olist_sellers seller_id
product_category_name_translation stg_olist_category_translation product_category_name
stg_olist_customers dim_customers customer_id
stg_olist_sellers dim_sellers seller_id
stg_olist_geolocation dim_locations geolocation_zip_code_prefix=zip_code_prefix
stg_olist_products dim_products product_id
stg_olist_category_translation dim_products product_category_name_english=product_category_english
stg_olist_order_items fct_order_items order_id order_item_id / price=item_price_usd
stg_olist_orders fct_order_items order_id
stg_olist_order_payments fct_order_payments order_id payment_sequential / payment_value=payment_value_usd
stg_olist_orders fct_order_payments order_id
stg_olist_orders fct_orders order_id
stg_olist_order_items fct_orders order_id / price=total_items_value_usd
stg_olist_order_payments fct_orders order_id / payment_value=total_payment_value_usd
fct_order_items mart_customer_reviews order_id order_item_id / item_price_usd
stg_olist_order_reviews mart_customer_reviews review_id
dim_customers mart_customer_reviews customer_sk
fct_order_items mart_logistics_network / freight_value_usd=total_route_freight_usd
dim_sellers mart_logistics_network state=origin_state
dim_customers mart_logistics_network state=destination_state
dim_customers mart_obt_customers customer_sk
fct_orders mart_obt_customers customer_sk / total_payment_value_usd
stg_olist_order_reviews mart_obt_customers
fct_order_items mart_obt_orders order_item_sk / item_price_usd
fct_orders mart_obt_orders order_id
dim_customers mart_obt_orders customer_sk
dim_sellers mart_obt_orders seller_sk
dim_products mart_obt_orders product_sk
stg_olist_order_reviews mart_obt_orders order_id
dim_sellers mart_obt_sellers seller_sk
fct_order_items mart_obt_sellers seller_sk / item_price_usd=total_revenue_usd
stg_olist_order_reviews mart_obt_sellers
fct_order_payments mart_payment_profiles payment_type payment_installments / payment_value_usd=total_revenue_usd
fct_orders mart_payment_profiles / total_payment_value_usd=total_revenue_usd
fct_order_items mart_product_performance product_sk / item_price_usd=total_revenue_usd
dim_products mart_product_performance product_sk
stg_olist_order_reviews mart_product_performance
fct_order_items mart_seller_sales seller_sk / item_price_usd=total_revenue_usd
dim_sellers mart_seller_sales seller_sk
stg_olist_order_reviews mart_seller_sales
"""


def _edge(line: str) -> str:
    step, _, measure = line.partition(" /")
    parent, child, *pairs = step.split()
    columns = [(p, c or p) for p, _, c in (pair.partition("=") for pair in pairs)]
    of_parent, _, of_child = measure.strip().partition("=")
    keys = [f"k{i}" for i in range(len(columns))] or ["k0"]

    def side(name: str, at: int, total: str) -> str:
        picked = ", ".join(f"{c[at]} AS {k}" for c, k in zip(columns, keys)) or "0 AS k0"
        total = f"sum({total})" if total else "NULL::DOUBLE"
        return f"(SELECT {picked}, count(*) AS n, {total} AS m FROM {name} GROUP BY {', '.join(keys)})"

    p, c = side(parent, 0, of_parent), side(child, 1, of_child or of_parent)
    # IS NOT DISTINCT FROM cannot drive a full join here; NULL keys get a marker.
    on = " AND ".join(
        f"coalesce(p.{k}::VARCHAR, '<null>') = coalesce(c.{k}::VARCHAR, '<null>')" for k in keys
    )
    return f"""
        SELECT '{parent}' AS parent, '{child}' AS child,
               sum(p.n)::BIGINT AS parent_rows, sum(c.n)::BIGINT AS child_rows,
               count(p.n) AS parent_keys, count(c.n) AS child_keys,
               count(*) FILTER (WHERE c.n IS NULL) AS keys_lost,
               count(*) FILTER (WHERE p.n IS NULL) AS keys_gained,
               round(sum(p.m), 2) AS parent_measure, round(sum(c.m), 2) AS child_measure,
               round(sum(c.m) - sum(p.m), 2) AS measure_drift
        FROM {p} p FULL JOIN {c} c ON {on}"""


_EVENT_DAYS = """
    SELECT event_type, ts::DATE AS day, count(*) AS row_count FROM events
    WHERE ts IS NOT NULL GROUP BY ALL"""


def _between(period: tuple[str, str]) -> str:
    return f"ts::DATE BETWEEN DATE '{period[0]}' AND DATE '{period[1]}'"


_CURRENT, _PREVIOUS = _between(PERIODS["current"]), _between(PERIODS["previous"])

_ORDER_COLUMNS = ("order_id", "customer_id", "order_status", *_STAMPS)


def _profile(position: int, column: str) -> str:
    kind = "timestamp_ntz" if column in _STAMPS else "string"
    return f"""
        SELECT {position} AS ordinal, '{column}' AS column_name, '{kind}' AS data_type,
               {column != 'order_status'} AS nullable, count(*) AS row_count,
               count(*) - count({column}) AS null_count,
               100.0::DOUBLE * (count(*) - count({column})) / count(*) AS null_pct,
               count(DISTINCT {column}) AS distinct_count,
               min({column})::VARCHAR AS min_value, max({column})::VARCHAR AS max_value
        FROM stg_olist_orders"""


def _loss(column: str, kind: str) -> str:
    target = {"int": "INTEGER", "double": "DOUBLE", "timestamp": "TIMESTAMP"}[kind]
    lost = f"count({column}) - count(TRY_CAST({column} AS {target}))"
    return f"""
        SELECT '{column}' AS "column", '{kind}' AS type, count({column}) AS present,
               {lost} AS lost, ({lost})::DOUBLE / count({column}) AS loss_rate
        FROM olist_order_reviews"""


_SELLER_MEASURES = (
    ("total_revenue_usd", "item_price_usd"),
    ("total_freight_charged_usd", "freight_value_usd"),
)


def _reconciled(measure: str, source: str) -> str:
    return f"""
        SELECT coalesce(f.seller_sk, m.seller_sk) AS seller_sk, '{measure}' AS measure,
               f.expected, m.observed, m.observed - f.expected AS difference,
               CASE WHEN m.seller_sk IS NULL THEN 'missing_in_mart'
                    WHEN f.seller_sk IS NULL THEN 'not_in_fact'
                    WHEN abs(m.observed - f.expected) <= 0.01 THEN 'ok'
                    ELSE 'mismatch' END AS status
        FROM (SELECT seller_sk, sum({source}) AS expected FROM fct_order_items GROUP BY ALL) f
        FULL JOIN (SELECT seller_sk, {measure} AS observed FROM mart_seller_sales) m
          ON m.seller_sk = f.seller_sk"""


def _null_rates(column: str) -> str:
    return f"""
        SELECT review_creation_date::DATE AS day, '{column}' AS "column",
               (count(*) - count({column}))::DOUBLE / count(*) AS null_rate
        FROM stg_olist_order_reviews WHERE review_creation_date IS NOT NULL GROUP BY 1"""


def _union(parts) -> str:
    return "\n        UNION ALL".join(parts)


_RAW: dict[str, tuple[str, str]] = {
    **{name: (f"SELECT * FROM {t}", _DOUBLES.get(t, "")) for name, t in MODELS.items()},
    "try_cast_mix": (
        """
        SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS label_int,
               TRY_CAST(o_orderpriority[1] AS INTEGER) AS digit_int,
               TRY_CAST(o_orderpriority[1] || '.5' AS INTEGER) AS half_int,
               TRY_CAST(o_totalprice::VARCHAR AS INTEGER) AS price_int,
               TRY_CAST(o_totalprice::VARCHAR AS DOUBLE) AS price_double,
               TRY_CAST(o_orderpriority AS DOUBLE) AS label_double,
               TRY_CAST(o_orderdate::DATE::VARCHAR AS TIMESTAMP) AS day_ts,
               TRY_CAST((o_orderdate::VARCHAR)[1:7] AS TIMESTAMP) AS month_ts
        FROM orders""",
        "price_double label_double",
    ),
    "seller_classification": (
        """
        SELECT seller_id, state AS seller_state, total_orders,
               round(total_revenue_usd, 2) AS total_revenue_usd,
               round(delay_rate_pct, 1) AS delay_rate_pct,
               round(avg_review_score, 2) AS avg_review_score, total_negative_reviews,
               CASE WHEN avg_review_score >= 4.5 AND delay_rate_pct <= 5
                    THEN 'Super Seller (Excellent Score & Delivery)'
                    WHEN avg_review_score <= 3 OR delay_rate_pct >= 25
                    THEN 'High Risk / Rogue (Bad Score or Extreme Delays)'
                    ELSE 'Standard Seller' END AS seller_classification
        FROM mart_obt_sellers WHERE total_orders >= 50
        ORDER BY round(total_revenue_usd, 2) DESC NULLS LAST,
                 round(avg_review_score, 2) NULLS LAST, seller_id
        LIMIT 15""",
        "total_revenue_usd delay_rate_pct avg_review_score",
    ),
    "customers_per_state_topk": (
        """
        SELECT c_nationkey AS customer_state, count(*) AS total_customers
        FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
        "",
    ),
    "explore_capped": (
        """
        SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS last_order
        FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
        "",
    ),
    "metric_history": (
        f"""
        SELECT ts::DATE AS metric_date, count(*) AS row_count, sum(value) AS metric_value,
               avg(value) AS metric_average, min(value) AS metric_min, max(value) AS metric_max
        FROM events WHERE ts >= DATE '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1""",
        "metric_value metric_average metric_min metric_max",
    ),
    "metric_history_raw": (
        """
        SELECT l_shipdate AS metric_date, count(*) AS row_count,
               sum(l_extendedprice) AS metric_value, avg(l_extendedprice) AS metric_average,
               min(l_extendedprice) AS metric_min, max(l_extendedprice) AS metric_max
        FROM lineitem WHERE l_shipdate >= DATE '2001-06-30' - INTERVAL 365 DAY GROUP BY 1""",
        "metric_value metric_average metric_min metric_max",
    ),
    "table_inventory": (
        _union(
            f"""
        SELECT '{TABLES[t].layer}' AS layer, '{t}' AS "table",
               '{"view" if TABLES[t].layer == "staging" else "table"}' AS kind,
               (SELECT count(*) FROM {t}) AS row_count,
               {N_COLUMNS[t]}::INTEGER AS n_columns"""
            for t in PUBLISHED
        ),
        "",
    ),
    "column_profile": (
        _union(_profile(i + 1, c) for i, c in enumerate(_ORDER_COLUMNS)),
        "null_pct",
    ),
    "lineage_reconcile": (
        _union(_edge(e) for e in _LINEAGE.strip().splitlines()),
        "parent_measure child_measure measure_drift",
    ),
    "duplicates": (
        """
        SELECT order_id, order_item_id, count(*) AS n_rows
        FROM stg_olist_order_items GROUP BY ALL HAVING count(*) > 1""",
        "",
    ),
    "null_drift": (
        f"""
        SELECT *, coalesce(null_rate - baseline > 0.02, false) AS drifted
        FROM (SELECT *, avg(null_rate) OVER (PARTITION BY "column" ORDER BY day
                     RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
                     AS baseline
              FROM ({_null_rates("review_score")}
                    UNION ALL {_null_rates("review_answer_timestamp")}))""",
        "null_rate baseline",
    ),
    "orphans": (
        """
        SELECT count(*) AS child_rows, count(*) FILTER (WHERE order_id IS NULL) AS null_key_rows,
               count(*) FILTER (WHERE lost) AS orphan_rows,
               count(DISTINCT order_id) FILTER (WHERE lost) AS orphan_keys,
               (count(*) FILTER (WHERE lost))::DOUBLE / count(*) AS orphan_rate
        FROM (SELECT order_id, order_id NOT IN
                     (SELECT order_id FROM stg_olist_orders WHERE order_status = 'delivered')
                     AS lost
              FROM stg_olist_order_items)""",
        "orphan_rate",
    ),
    "orphan_keys": (
        """
        SELECT order_id, count(*) AS n_rows FROM stg_olist_order_reviews r
        WHERE NOT EXISTS (FROM stg_olist_orders o
                          WHERE o.order_id = r.order_id AND order_status = 'delivered')
        GROUP BY ALL""",
        "",
    ),
    "join_cardinality": (
        """
        SELECT (SELECT count(*) FROM stg_olist_order_items) AS left_rows,
               (SELECT count(*) FROM stg_olist_order_reviews) AS right_rows,
               (SELECT count(DISTINCT order_id) FROM stg_olist_order_items) AS left_keys,
               (SELECT count(DISTINCT order_id) FROM stg_olist_order_reviews) AS right_keys,
               count(DISTINCT i.order_id) FILTER (r.order_id IS NOT NULL) AS matched_keys,
               (SELECT count(*) FROM
                   (SELECT order_id FROM stg_olist_order_items GROUP BY 1 HAVING count(*) > 1)
                   SEMI JOIN
                   (SELECT order_id FROM stg_olist_order_reviews GROUP BY 1 HAVING count(*) > 1)
                   USING (order_id)) AS many_to_many_keys,
               count(r.order_id) AS inner_join_rows, count(*) AS left_join_rows,
               count(r.order_id)::DOUBLE / (SELECT count(*) FROM stg_olist_order_items
                SEMI JOIN stg_olist_order_reviews USING (order_id)) AS fan_out
        FROM stg_olist_order_items i
        LEFT JOIN stg_olist_order_reviews r ON r.order_id = i.order_id""",
        "fan_out",
    ),
    "retention": (
        """
        SELECT order_status, count(*) AS upstream_rows, count(*) FILTER (WHERE kept) AS kept_rows,
               count(*) FILTER (WHERE NOT kept) AS lost_rows,
               100.0::DOUBLE * count(*) FILTER (WHERE kept) / count(*) AS retained_pct
        FROM (SELECT order_status,
                     order_id IN (SELECT order_id FROM stg_olist_order_reviews) AS kept
              FROM stg_olist_orders)
        GROUP BY ALL""",
        "retained_pct",
    ),
    "calendar_gaps": (
        """
        SELECT order_status, day::DATE AS day
        FROM (SELECT order_status,
                     unnest(generate_series(first, last, INTERVAL 1 DAY)) AS day
              FROM (SELECT order_status, min(order_purchase_timestamp)::DATE AS first,
                           max(order_purchase_timestamp)::DATE AS last
                    FROM stg_olist_orders GROUP BY order_status)) c
        WHERE NOT EXISTS (FROM stg_olist_orders o WHERE o.order_status = c.order_status
                          AND o.order_purchase_timestamp::DATE = c.day)""",
        "",
    ),
    "volume_anomalies": (
        f"""
        SELECT *, (row_count - baseline) / nullif(spread, 0) AS z_score,
               coalesce(CASE WHEN spread = 0 THEN row_count <> baseline
                             ELSE abs((row_count - baseline) / spread) > 2 END, false) AS anomalous
        FROM (SELECT *, avg(row_count) OVER past AS baseline,
                     stddev_samp(row_count) OVER past AS spread
              FROM (SELECT event_type, day, coalesce(row_count, 0) AS row_count
                    FROM (SELECT event_type, unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE
                                 AS day
                          FROM (SELECT event_type, min(day) AS first FROM ({_EVENT_DAYS}) GROUP BY ALL),
                               (SELECT max(day) AS last FROM ({_EVENT_DAYS})))
                    LEFT JOIN ({_EVENT_DAYS}) USING (event_type, day))
              WINDOW past AS (PARTITION BY event_type ORDER BY day
                              RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))""",
        "baseline spread z_score",
    ),
    "reconcile_measure": (
        _union(_reconciled(m, source) for m, source in _SELLER_MEASURES),
        "expected observed difference",
    ),
    "cast_loss": (
        _union(
            _loss(c, kind)
            for c, kind in (
                ("review_id", "int"),
                ("review_score", "int"),
                ("review_comment_message", "double"),
                ("review_creation_date", "timestamp"),
                ("review_comment_title", "timestamp"),
            )
        ),
        "loss_rate",
    ),
    "domain_violations": (
        """
        SELECT review_score AS value, count(*) AS n_rows FROM stg_olist_order_reviews
        WHERE review_score IS NULL OR review_score NOT BETWEEN 2 AND 4 GROUP BY ALL""",
        "",
    ),
    "domain_allowed": (
        """
        SELECT order_status AS value, count(*) AS n_rows FROM stg_olist_orders
        WHERE order_status NOT IN ('delivered', 'shipped') GROUP BY ALL""",
        "",
    ),
    "kpi_change": (
        f"""
        SELECT *, 100 * change / nullif(previous, 0) AS change_pct,
               100 * change / nullif(sum(change) OVER (), 0) AS share_of_change_pct
        FROM (SELECT event_type, coalesce(sum(value) FILTER ({_PREVIOUS}), 0) AS previous,
                     coalesce(sum(value) FILTER ({_CURRENT}), 0) AS current,
                     current - previous AS change
              FROM events WHERE {_CURRENT} OR {_PREVIOUS} GROUP BY ALL)""",
        "previous current change change_pct share_of_change_pct",
    ),
    "csv_ingest_roundtrip": (
        """
        SELECT * REPLACE (review_comment_message || chr(10) || review_comment_title
                          AS review_comment_message)
        FROM olist_order_reviews""",
        "",
    ),
    "marts_export": (
        _union(
            f"""
        SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS "rows",
               (SELECT count(*) FROM {t}) AS csv_rows, true AS same_contents,
               'ok' AS status"""
            for t in PUBLISHED
            if TABLES[t].layer == "marts"
        ),
        "",
    ),
}


def _outcome(source, check, table, column, observed, threshold, where="true") -> str:
    return f"""
        SELECT '{check}' AS "check", '{table}' AS "table", '{column}' AS "column",
               coalesce(({observed})::DOUBLE, 0) AS observed, {threshold}::DOUBLE AS threshold,
               coalesce(({observed})::DOUBLE, 0) > {threshold} AS failed
        FROM ({_RAW[source][0]}) WHERE {where}"""


_RAW["quality_report"] = (
    _union(
        [
            _outcome(
                "duplicates",
                "duplicates",
                "stg_olist_order_items",
                "order_id,order_item_id",
                "count(*)",
                0,
            ),
            _outcome(
                "orphans",
                "orphans",
                "stg_olist_order_items",
                "order_id",
                "max(orphan_rate)",
                0.5,
            ),
            _outcome(
                "join_cardinality",
                "many_to_many",
                "stg_olist_order_items",
                "order_id",
                "max(many_to_many_keys)",
                0,
            ),
            _outcome(
                "cast_loss",
                "cast_loss",
                "olist_order_reviews",
                "review_score",
                "max(loss_rate)",
                0.05,
                "\"column\" = 'review_score'",
            ),
            _outcome(
                "null_drift",
                "null_drift",
                "stg_olist_order_reviews",
                "review_score",
                "count(*) FILTER (drifted)",
                0,
            ),
            _outcome(
                "volume_anomalies",
                "volume_anomalies",
                "events",
                "ts",
                "count(*) FILTER (anomalous)",
                5,
            ),
            _outcome(
                "calendar_gaps",
                "calendar_gaps",
                "stg_olist_orders",
                "order_purchase_timestamp",
                "count(*)",
                0,
            ),
            _outcome(
                "retention",
                "retention",
                "stg_olist_orders",
                "order_id",
                "100 - min(retained_pct)",
                50,
            ),
            _outcome(
                "reconcile_measure",
                "reconcile_measure",
                "mart_seller_sales",
                "total_revenue_usd,total_freight_charged_usd",
                "count(*)",
                0,
                "status <> 'ok'",
            ),
            _outcome(
                "domain_violations",
                "domain_violations",
                "stg_olist_order_reviews",
                "review_score",
                "sum(n_rows)",
                0,
            ),
        ]
    ),
    "observed threshold",
)


# Walking back from a mart; a step's keys are counted once, whatever the number of ways.
_RAW["lineage_upstream"] = (
    f"""
        WITH RECURSIVE counts AS ({_union(_edge(e) for e in _LINEAGE.strip().splitlines())}),
        ways AS (
          SELECT 1 AS depth, parent, child, [child, parent] AS path FROM counts
          WHERE child = 'mart_seller_sales'
          UNION ALL
          SELECT depth + 1, c.parent, c.child, list_append(path, c.parent)
          FROM ways w JOIN counts c ON c.child = w.parent),
        steps AS (SELECT * FROM ways JOIN counts USING (parent, child))
        SELECT depth, parent, child, array_to_string(path, ' < ') AS path,
               coalesce(parent_rows, 0)::BIGINT AS parent_rows,
               coalesce(child_rows, 0)::BIGINT AS child_rows,
               parent_keys, child_keys, keys_lost, keys_gained,
               keys_lost > 0 AND NOT EXISTS (
                 FROM steps n WHERE n.keys_lost > 0 AND len(n.path) < len(s.path)
                  AND n.path = s.path[1 : len(n.path)]) AS first_loss
        FROM steps s""",
    "",
)

_RAW["kpi_change_sets"] = (
    f"""
        SELECT concat_ws(',', CASE WHEN grouping(event_type) = 0 THEN 'event_type' END,
                         CASE WHEN grouping(user_group) = 0 THEN 'user_group' END,
                         CASE WHEN grouping(half) = 0 THEN 'half' END) AS grouped_by,
               event_type, user_group, half, sum(p) AS previous, sum(c) AS current,
               sum(c) - sum(p) AS change,
               100.0::DOUBLE * (sum(c) - sum(p)) / nullif(sum(p), 0) AS change_pct,
               100.0::DOUBLE * (sum(c) - sum(p))
                 / nullif((SELECT sum(v) FILTER (now) - sum(v) FILTER (NOT now) FROM (
                     SELECT value AS v, {_CURRENT} AS now FROM events
                     WHERE ({_CURRENT}) OR ({_PREVIOUS}))), 0) AS share_of_change_pct,
               100.0::DOUBLE * sum(p)
                 / nullif((SELECT sum(value) FROM events WHERE {_PREVIOUS}), 0) AS weight_pct
        FROM (SELECT event_type, (user_id % 3)::INTEGER AS user_group,
                     CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half,
                     CASE WHEN {_CURRENT} THEN value ELSE 0 END AS c,
                     CASE WHEN {_PREVIOUS} THEN value ELSE 0 END AS p
              FROM events WHERE ({_CURRENT}) OR ({_PREVIOUS}))
        GROUP BY CUBE (event_type, user_group, half)""",
    "previous current change change_pct share_of_change_pct weight_pct",
)


def _merged(position: int, column: str, kind: str) -> str:
    return f"""
        SELECT '{column}' AS column_name, {position} AS ordinal, '{kind}' AS data_type,
               count(*) AS row_count, count(*) - count({column}) AS null_count,
               min({column})::VARCHAR AS min_value, max({column})::VARCHAR AS max_value,
               count(DISTINCT {column}) AS distinct_exact, true AS within_error
        FROM events"""


_RAW["profile_merged"] = (
    _union(
        _merged(i, *column)
        for i, column in enumerate(
            (
                ("event_id", "bigint"),
                ("user_id", "bigint"),
                ("event_type", "string"),
                ("value", "double"),
                ("ts", "timestamp_ntz"),
            ),
            1,
        )
    ),
    "",
)

_KINDS = """CASE {0} WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int'
            WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DOUBLE' THEN 'double' END"""
_REVIEW_COLUMNS = (
    "review_id order_id review_score review_comment_title review_comment_message"
    " review_creation_date review_answer_timestamp"
).split()


def _type_of(column: str, source: str) -> str:
    return f" SELECT '{column}' AS c, any_value(typeof({column})) AS t FROM {source}"


# The third version is stated by what its definition does to the second.
_RAW["schema_changes"] = (
    f"""
        WITH v1 AS ({_union(_type_of(c, "olist_order_reviews") for c in _REVIEW_COLUMNS)}),
        v2 AS ({_union(_type_of(c, "stg_olist_order_reviews") for c in _REVIEW_COLUMNS)}),
        v3 AS (SELECT c, CASE c WHEN 'review_score' THEN 'DOUBLE' ELSE t END AS t FROM v2
               WHERE c <> 'review_comment_title'
               UNION ALL SELECT 'review_dates', 'struct'
               UNION ALL SELECT 'review_dates.' || c, t FROM v2
                         WHERE c IN ('review_creation_date', 'review_answer_timestamp')),
        steps AS (SELECT 'v2' AS version, * FROM (SELECT c, t AS was FROM v1) FULL JOIN (SELECT c, t AS now FROM v2) USING (c)
                  UNION ALL
                  SELECT 'v3', * FROM (SELECT c, t AS was FROM v2) FULL JOIN (SELECT c, t AS now FROM v3) USING (c))
        SELECT version, c AS column_name,
               CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'missing' ELSE 'type' END AS change,
               coalesce({_KINDS.format("was")}, was) AS was, coalesce({_KINDS.format("now")}, now) AS now
        FROM steps WHERE was IS DISTINCT FROM now""",
    "",
)

_RAW["catalog_inventory"] = _RAW["table_inventory"]

_RAW["adhoc_csv"] = (
    """
        SELECT review_score, count(*) AS n_reviews, count(DISTINCT order_id) AS n_orders,
               max(review_id::INTEGER) AS last_review,
               max(review_creation_date::TIMESTAMP) AS last_created,
               sum(len(concat_ws(chr(10), review_comment_message,
                                 'said "' || review_comment_title || '", twice')))::BIGINT AS n_chars,
               count(*) FILTER (review_comment_message IS NOT NULL AND review_comment_title IS NOT NULL) AS n_broken
        FROM olist_order_reviews GROUP BY review_score""",
    "",
)

_RAW["adhoc_json"] = (
    """
        SELECT CASE WHEN user_id % 7 <> 3 THEN 'team ' || (user_id % 7) END AS name,
               event_type AS kind, count(*) AS n_events, sum(value) AS total
        FROM events GROUP BY ALL""",
    "total",
)


def _spelled(feed: str, column: str, nulls: str) -> str:
    value = f"CASE WHEN coalesce({column}, '') NOT IN ({nulls}) THEN {column} END"
    return f"""
        SELECT '{feed}' AS feed, '{column}' AS column_name, count(*) AS row_count,
               count(*) - count({value}) AS null_count, count(DISTINCT {value}) AS distinct_count
        FROM {feed}"""


_RAW["ingest_null_spellings"] = (
    _union(
        [
            *[
                _spelled(
                    "olist_order_reviews",
                    c,
                    "'', 'n/a', 'NA', 'N/A', 'NULL', 'null', 'None', 'nan', 'NaN'"
                    + (", 'view'" if c == "review_comment_title" else ""),
                )
                for c in _REVIEW_COLUMNS
            ],
            *[
                _spelled("olist_orders", c, "'', 'shipped'" if c == "order_status" else "''")
                for c in _ORDER_COLUMNS
            ],
        ]
    ),
    "",
)


def statements() -> dict[str, str]:
    return {name: sql(query, tuple(doubles.split())) for name, (query, doubles) in _RAW.items()}
