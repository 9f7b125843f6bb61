"""Declared schemas (DDL) of the nine raw tables, as their CSV files have them.

Ids are text.  Reviews hold free text with quoted line breaks (``MULTI_LINE``):
their files are scanned twice, to find where records start in each split.
"""

from __future__ import annotations

from basketry.sources.loaders import LoadSpec

# Column names (with the source's own spelling) and types.
RAW_SCHEMAS = {
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
              "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
              "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
    "order_items": "order_id string, order_item_id bigint, product_id string, seller_id string, "
                   "shipping_limit_date timestamp_ntz, price decimal(18,4), freight_value decimal(18,4)",
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix bigint, customer_city string, "
                 "customer_state string",
    "products": "product_id string, product_category_name string, product_name_lenght bigint, "
                "product_description_lenght bigint, product_photos_qty bigint, product_weight_g decimal(18,3), "
                "product_length_cm decimal(18,3), product_height_cm decimal(18,3), product_width_cm decimal(18,3)",
    "order_payments": "order_id string, payment_sequential bigint, payment_type string, payment_installments bigint, "
                      "payment_value decimal(18,4)",
    "sellers": "seller_id string, seller_zip_code_prefix bigint, seller_city string, seller_state string",
    "order_reviews": "review_id string, order_id string, review_score bigint, review_comment_title string, "
                     "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz",
    "geolocation": "geolocation_zip_code_prefix bigint, geolocation_lat double, geolocation_lng double, "
                   "geolocation_city string, geolocation_state string",
    "category_name_translation": "product_category_name string, product_category_name_english string",
}
MULTI_LINE = frozenset({"order_reviews"})


def load_specs(paths: dict[str, str]) -> list[LoadSpec]:
    """One load for each given table (table name -> CSV file or folder)."""
    return [LoadSpec(t, path, RAW_SCHEMAS[t], t in MULTI_LINE) for t, path in paths.items()]
