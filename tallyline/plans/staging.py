"""Staging: one typed row per raw row. No row is filtered or merged here.

A staging table is declared as the columns it passes on and, for some, the type
they are read as. ``project`` turns that into SQL expressions, used alike for a
DataFrame and for a stored view.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import cast_expr


@dataclass(frozen=True)
class Staging:
    feed: str
    columns: tuple[str, ...]
    types: dict[str, str] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)


def _typed(**kinds: str) -> dict[str, str]:
    return {column: kind for kind, columns in kinds.items() for column in columns.split()}


STAGING: dict[str, Staging] = {
    "stg_olist_customers": Staging(
        "olist_customers",
        (
            "customer_id",
            "customer_unique_id",
            "customer_zip_code_prefix",
            "customer_city",
            "customer_state",
        ),
    ),
    "stg_olist_sellers": Staging(
        "olist_sellers",
        ("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    ),
    "stg_olist_geolocation": Staging(
        "olist_geolocation",
        (
            "geolocation_zip_code_prefix",
            "geolocation_lat",
            "geolocation_lng",
            "geolocation_city",
            "geolocation_state",
        ),
    ),
    "stg_olist_category_translation": Staging(
        "product_category_name_translation",
        ("product_category_name", "product_category_name_english"),
    ),
    "stg_olist_products": Staging(
        "olist_products",
        (
            "product_id",
            "product_category_name",
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ),
        _typed(
            int="product_name_lenght product_description_lenght product_photos_qty",
            double="product_weight_g product_length_cm product_height_cm product_width_cm",
        ),
        {
            "product_name_lenght": "product_name_length",
            "product_description_lenght": "product_description_length",
        },
    ),
    "stg_olist_orders": Staging(
        "olist_orders",
        (
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
        _typed(
            timestamp="order_purchase_timestamp order_approved_at order_delivered_carrier_date"
            " order_delivered_customer_date order_estimated_delivery_date"
        ),
    ),
    "stg_olist_order_items": Staging(
        "olist_order_items",
        (
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            "price",
            "freight_value",
        ),
        _typed(int="order_item_id", timestamp="shipping_limit_date", double="price freight_value"),
    ),
    "stg_olist_order_payments": Staging(
        "olist_order_payments",
        (
            "order_id",
            "payment_sequential",
            "payment_type",
            "payment_installments",
            "payment_value",
        ),
        _typed(int="payment_sequential payment_installments", double="payment_value"),
    ),
    "stg_olist_order_reviews": Staging(
        "olist_order_reviews",
        (
            "review_id",
            "order_id",
            "review_score",
            "review_comment_title",
            "review_comment_message",
            "review_creation_date",
            "review_answer_timestamp",
        ),
        _typed(int="review_score", timestamp="review_creation_date review_answer_timestamp"),
    ),
}


def project(name: str, raw: DataFrame) -> list[str]:
    """``expression AS column`` for every column of staging table ``name``."""
    spec = STAGING[name]
    return [
        f"{cast_expr(raw, c, spec.types[c]) if c in spec.types else f'`{c}`'}"
        f" AS `{spec.renames.get(c, c)}`"
        for c in spec.columns
    ]


def stage(name: str, raw: DataFrame) -> DataFrame:
    return raw.selectExpr(*project(name, raw))


def view_sql(name: str, raw: DataFrame, database: str, path: str) -> str:
    """Statement that stores the staging table as a view over the feed's files."""
    columns = ",\n  ".join(project(name, raw))
    return (
        f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS\n"
        f"SELECT\n  {columns}\nFROM parquet.`{path}`"
    )
