"""Raw feeds: file names and the columns each one carries.

Names and columns are fixed values: they are the published layout of the order
data set, including the ``lenght`` spelling.
"""

from __future__ import annotations

from dataclasses import dataclass

# Feeds land as text so that an unreadable value survives ingest and can be
# counted later (operators.cast_loss); coordinates are the one exception, as
# staging passes them on without a cast.
_FIELDS = {
    "olist_customers": """
        customer_id string, customer_unique_id string,
        customer_zip_code_prefix string, customer_city string, customer_state string""",
    "olist_geolocation": """
        geolocation_zip_code_prefix string, geolocation_lat double,
        geolocation_lng double, geolocation_city string, geolocation_state string""",
    "olist_order_items": """
        order_id string, order_item_id string, product_id string, seller_id string,
        shipping_limit_date string, price string, freight_value string""",
    "olist_order_payments": """
        order_id string, payment_sequential string, payment_type string,
        payment_installments string, payment_value string""",
    "olist_order_reviews": """
        review_id string, order_id string, review_score string,
        review_comment_title string, review_comment_message string,
        review_creation_date string, review_answer_timestamp string""",
    "olist_orders": """
        order_id string, customer_id string, order_status string,
        order_purchase_timestamp string, order_approved_at string,
        order_delivered_carrier_date string, order_delivered_customer_date string,
        order_estimated_delivery_date string""",
    "olist_products": """
        product_id string, product_category_name string, product_name_lenght string,
        product_description_lenght string, product_photos_qty string,
        product_weight_g string, product_length_cm string, product_height_cm string,
        product_width_cm string""",
    "olist_sellers": """
        seller_id string, seller_zip_code_prefix string, seller_city string,
        seller_state string""",
    "product_category_name_translation": """
        product_category_name string, product_category_name_english string""",
}

# Feeds whose free text may contain line breaks inside quotes.
_FREE_TEXT = {"olist_order_reviews"}


@dataclass(frozen=True)
class Feed:
    name: str
    schema: str  # DDL
    free_text: bool

    @property
    def csv_name(self) -> str:
        """File name of the feed as published (fixed value)."""
        return f"{self.name}_dataset.csv" if self.name.startswith("olist_") else f"{self.name}.csv"

    @property
    def columns(self) -> list[str]:
        return [column.split()[0] for column in self.schema.split(",")]


FEEDS: dict[str, Feed] = {
    name: Feed(name, " ".join(ddl.split()), name in _FREE_TEXT) for name, ddl in _FIELDS.items()
}
