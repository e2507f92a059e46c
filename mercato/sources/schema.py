"""Declared schemas of the logical source tables.

Declaring them avoids ``inferSchema`` (a second full scan of every CSV) and
keeps zip codes as strings, so leading zeros survive (SURVEY 1.2, 1.3).
"""

from pyspark.sql.types import (DecimalType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

MONEY = DecimalType(18, 2)


def _s(*cols):
    return StructType([StructField(n, t, True) for n, t in cols])


SCHEMAS = {
    "customers": _s(("customer_id", LongType()), ("customer_unique_id", LongType()),
                    ("customer_zip_code_prefix", StringType()), ("customer_city", StringType()),
                    ("customer_state", StringType())),
    "orders": _s(("order_id", LongType()), ("customer_id", LongType()),
                 ("order_status", StringType()),
                 ("order_purchase_timestamp", TimestampNTZType()),
                 ("order_approved_at", TimestampNTZType()),
                 ("order_delivered_carrier_date", TimestampNTZType()),
                 ("order_delivered_customer_date", TimestampNTZType()),
                 ("order_estimated_delivery_date", TimestampNTZType())),
    "order_items": _s(("order_id", LongType()), ("order_item_id", IntegerType()),
                      ("product_id", LongType()), ("seller_id", LongType()),
                      ("shipping_limit_date", TimestampNTZType()),
                      ("price", MONEY), ("freight_value", MONEY)),
    "payments": _s(("order_id", LongType()), ("payment_sequential", IntegerType()),
                   ("source_row", LongType()), ("payment_type", StringType()),
                   ("payment_installments", IntegerType()), ("payment_value", MONEY)),
    "reviews": _s(("order_id", LongType()), ("review_no", IntegerType()),
                  ("review_score", LongType()), ("review_comment_title", StringType()),
                  ("review_comment_message", StringType()),
                  ("review_creation_date", TimestampNTZType()),
                  ("review_answer_timestamp", TimestampNTZType())),
    "products": _s(("product_id", LongType()), ("product_category_name", StringType()),
                   ("product_name_lenght", DoubleType()), ("product_description_lenght", DoubleType()),
                   ("product_photos_qty", DoubleType()), ("product_weight_g", DoubleType()),
                   ("product_length_cm", DoubleType()), ("product_height_cm", DoubleType()),
                   ("product_width_cm", DoubleType())),
    "sellers": _s(("seller_id", LongType()), ("seller_zip_code_prefix", StringType()),
                  ("seller_state", StringType())),
    "geolocation": _s(("geolocation_zip_code_prefix", StringType()), ("geolocation_lat", DoubleType()),
                      ("geolocation_lng", DoubleType()), ("geolocation_city", StringType()),
                      ("geolocation_state", StringType())),
    "category_translation": _s(("product_category_name", StringType()), ("label", StringType())),
}

# Columns no analytic needs: a file may lack them, and they are NULL then.
OPTIONAL = {"product_name_lenght", "product_description_lenght", "product_photos_qty", "product_length_cm",
            "product_height_cm", "product_width_cm"}
