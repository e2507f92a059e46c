"""The denormalised order-item fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import day_diff
from mercato.operators.clean import DATE_COLS, PRODUCT_NUMERIC, CleanTables, dedupe_by
from mercato.operators.skew import SALT, join_spread

# Column order of the fact as written (SNK1) and returned by ``build_fact``.
FACT_COLUMNS = [
    "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
    "freight_value", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state",
    "product_category_name", "category", *PRODUCT_NUMERIC, "seller_zip_code_prefix", "seller_state",
    "payment_value", "payment_installments", "payment_type", "review_no", "review_score",
    "review_comment_title", "review_comment_message", "review_creation_date", "review_answer_timestamp",
    "purchase_date", "purchase_year", "purchase_month", "purchase_weekday", "delivery_time",
    "estimated_delivery_time", "delivery_delay", "delay_vs_estimated", "item_total", "has_comment",
]


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders that have at least one item (``isin(set)`` as a semi-join)."""
    return orders.join(items.select("order_id"), "order_id", "left_semi")


def calendar_columns() -> dict[str, Column]:
    """The purchase's date, year, month and weekday (Monday 0)."""
    ts = F.col("order_purchase_timestamp")
    return {"purchase_date": F.to_date(ts), "purchase_year": F.year(ts).cast("bigint"),
            "purchase_month": F.date_format(ts, "yyyy-MM"), "purchase_weekday": F.weekday(ts).cast("bigint")}


def day_columns() -> dict[str, Column]:
    """Floored day counts of the estimate and the delay."""
    return {"estimated_delivery_time": day_diff("order_estimated_delivery_date", "order_purchase_timestamp"),
            "delivery_delay": day_diff("order_delivered_customer_date", "order_estimated_delivery_date")}


def has_comment() -> Column:
    """1 for a review with a text; 0 for an empty or missing one."""
    return F.coalesce(F.length("review_comment_message") > 0, F.lit(False)).cast("bigint")


def build_fact(cl: CleanTables) -> DataFrame:
    """Items left-joined to orders, customers, products, sellers, per-order
    payments and reviews.

    Grain = item x review: reviews are not reduced per order, and the order's
    payment total repeats on every row (T10), as in the studied ETL.  Left
    joins whose keys come from the items commute, so the plan is reordered
    for scale: the seller and product dimensions meet the narrow item rows, the narrower one first
    (AQE broadcasts them when their measured size is small, else sort-merge).
    Then the items are shuffled once by order_id; their duplicates are dropped inside
    those partitions, and orders, payments and reviews, each shuffled once by order_id with
    their own duplicates dropped and payments summed inside, meet them there.  Orders that hold more
    rows than one task should get are dealt to salts (operators/skew.py).
    """
    hot = cl.hot_orders
    products = cl.products.select("product_id", "product_category_name", "category", *PRODUCT_NUMERIC)
    sellers = cl.sellers.select("seller_id", "seller_zip_code_prefix", "seller_state")
    orders = cl.orders.select("order_id", "customer_id", "order_status", *DATE_COLS, "delivery_time", "delay_vs_estimated")
    reviews = cl.reviews.select("order_id", "review_no", "review_score", "review_comment_title", "review_comment_message",
                                "review_creation_date", "review_answer_timestamp")

    items = cl.src.order_items.join(sellers, "seller_id", "left").join(products, "product_id", "left")
    f = dedupe_by(items, "order_id", hot, cl.order_partitions)
    for side in (orders.join(cl.customers, "customer_id", "left"), cl.payments_agg, reviews):
        f = join_spread(f, side, "order_id", hot)
    f = f.drop(SALT)

    f = f.withColumns({**calendar_columns(), **day_columns(), "item_total": F.col("price") + F.col("freight_value"),
                       "has_comment": has_comment()})
    return f.select(*FACT_COLUMNS)


def delivered(fact: DataFrame) -> DataFrame:
    """Delivered orders only (a NULL status drops)."""
    return fact.where(F.col("order_status") == "delivered")


def date_range(df: DataFrame, start: dt.date | str | None = None,
               end: dt.date | str | None = None) -> DataFrame:
    """Inclusive purchase-date range.  A missing bound is no filter (the
    dashboard default is [min, max] of the data, which keeps every row).  The
    month bounds are added too, so a fact written with
    ``partitionBy('purchase_month')`` is pruned by partition."""
    cond = None

    def _and(c):
        nonlocal cond
        cond = c if cond is None else cond & c

    if start is not None:
        s = dt.date.fromisoformat(str(start))
        _and(F.col("purchase_date") >= F.lit(s))
        _and(F.col("purchase_month") >= F.lit(s.strftime("%Y-%m")))
    if end is not None:
        e = dt.date.fromisoformat(str(end))
        _and(F.col("purchase_date") <= F.lit(e))
        _and(F.col("purchase_month") <= F.lit(e.strftime("%Y-%m")))
    return df if cond is None else df.where(cond)


def analysis_rows(fact: DataFrame, start=None, end=None) -> DataFrame:
    """P1 then P2: the rows every sales, geography and delivery view starts from."""
    return date_range(delivered(fact), start, end)
