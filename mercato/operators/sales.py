"""Sales performance and the batch parts of sales forecasting (S1-S4, FC1, FC4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import keyed, money, nz_sum, quarter_label
from mercato.operators.fact import analysis_rows, delivered


def revenue_over_time(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Payment revenue per purchase date (date, revenue)."""
    rows = keyed(analysis_rows(fact, start, end), "purchase_date")
    return rows.groupBy(F.col("purchase_date").alias("date")).agg(
        money(nz_sum("payment_value")).alias("revenue"))


def revenue_by_category(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Payment revenue per category label (category, revenue)."""
    rows = keyed(analysis_rows(fact, start, end), "category")
    return rows.groupBy("category").agg(money(nz_sum("payment_value")).alias("revenue"))


def top_categories_revenue(fact: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    """S3: the k categories with most revenue; ties by category name.  The
    sort + limit plans as TakeOrderedAndProject (a per-partition top-k)."""
    return revenue_by_category(fact, start, end).orderBy(F.desc("revenue"), F.asc("category")).limit(k)


def top_categories_volume(fact: DataFrame, k: int = 10, start=None, end=None) -> DataFrame:
    """The k categories with most item rows (count of order_item_id)."""
    rows = keyed(analysis_rows(fact, start, end), "category")
    return (rows.groupBy("category").agg(F.count("order_item_id").alias("quantity_sold"))
            .orderBy(F.desc("quantity_sold"), F.asc("category")).limit(k))


def daily_revenue(fact: DataFrame) -> DataFrame:
    """FC1: (ds, y) daily revenue of delivered orders; days without sales are
    absent, not zero."""
    rows = keyed(delivered(fact), "purchase_date")
    return rows.groupBy(F.col("purchase_date").alias("ds")).agg(money(nz_sum("payment_value")).alias("y"))


def seasonal_segmentation(fact: DataFrame, quarter: str | None = None) -> DataFrame:
    """FC4: item rows per quarter label x category; years are pooled.  With
    ``quarter`` the result is that quarter's slice (the dashboard shows the
    last label by default)."""
    rows = delivered(fact).withColumn("purchase_quarter", quarter_label("purchase_date"))
    out = (keyed(rows, "purchase_quarter", "category")
           .groupBy("purchase_quarter", "category")
           .agg(F.count("order_item_id").alias("sales_volume")))
    if quarter is not None:
        out = out.where(F.col("purchase_quarter") == quarter)
    return out.orderBy("purchase_quarter", F.desc("sales_volume"), "category")


def last_quarter_view(fact: DataFrame) -> DataFrame:
    """FC4 default view: the slice of the greatest quarter label present."""
    seg = seasonal_segmentation(fact)
    last = seg.agg(F.max("purchase_quarter").alias("purchase_quarter"))
    return seg.join(F.broadcast(last), "purchase_quarter", "left_semi").orderBy(F.desc("sales_volume"), "category")
