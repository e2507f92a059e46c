"""Delivery performance and freight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.rules import bin_counts, exact_mean, half_even_pct, keyed, money, nz_sum, share_true
from mercato.operators.fact import analysis_rows

# The histogram edges and labels of the studied dashboard.
# Bins are (lo, hi]; the lowest edge is excluded (pd.cut, T2).
DELIVERY_EDGES = [0, 7, 14, 21, 28, 35, 100]
DELIVERY_LABELS = ["0-7 days", "8-14 days", "15-21 days", "22-28 days", "29-35 days", "35+ days"]
DELAY_EDGES = [-100, 0, 7, 14, 30, 100]
DELAY_LABELS = ["On Time", "1-7 days late", "8-14 days late", "15-30 days late", "30+ days late"]


def delivery_kpis(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Mean delivery time, mean delay, on-time % and late % (a NULL delay
    is neither, but stays in the denominator: T3)."""
    rows = analysis_rows(fact, start, end)
    return rows.agg(
        F.avg("delivery_time").alias("avg_delivery_time"),
        F.avg("delivery_delay").alias("avg_delay"),
        (share_true(F.col("delivery_delay") <= 0) * 100).alias("on_time_pct"),
        (share_true(F.col("delivery_delay") > 0) * 100).alias("late_pct"),
    )


def delivery_time_histogram(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Rows per delivery-time bin, empty bins as 0; 0 days and > 100 days
    fall outside every bin."""
    return bin_counts(analysis_rows(fact, start, end), "delivery_time", DELIVERY_EDGES,
                      DELIVERY_LABELS, "time_range", "row_count")


def monthly_delay(fact: DataFrame, start=None, end=None) -> DataFrame:
    """D3: per purchase month: mean delay, mean delivery time, row count."""
    rows = keyed(analysis_rows(fact, start, end), "purchase_month")
    return rows.groupBy(F.col("purchase_month").alias("month")).agg(
        F.avg("delivery_delay").alias("avg_delay"),
        F.avg("delivery_time").alias("avg_delivery_time"),
        F.count("order_id").alias("order_count"))


def delay_categories(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Rows per delay category and their share of the binned rows,
    rounded half-to-even to 2 places (T12).  The total is a window over the
    five-row result."""
    counts = bin_counts(analysis_rows(fact, start, end), "delivery_delay", DELAY_EDGES,
                        DELAY_LABELS, "category", "row_count")
    total = F.sum("row_count").over(Window.partitionBy())
    return counts.withColumn("percentage", half_even_pct(F.col("row_count"), total, 2))


def delivery_by_state(fact: DataFrame, k: int = 15, start=None, end=None) -> DataFrame:
    """Per customer state: mean delivery time, mean delay, row count; the
    k states with most rows."""
    rows = keyed(analysis_rows(fact, start, end), "customer_state")
    return (rows.groupBy("customer_state").agg(
        F.avg("delivery_time").alias("avg_delivery_time"),
        F.avg("delivery_delay").alias("avg_delay"),
        F.count("order_id").alias("orders"))
        .orderBy(F.desc("orders"), "customer_state").limit(k))


def freight_kpis(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Mean and total freight, and the mean of freight/price in percent.
    Deviation (T6): a zero price is skipped; pandas would make the mean
    infinite."""
    rows = analysis_rows(fact, start, end)
    ratio = F.try_divide(F.col("freight_value").cast("double"), F.col("price").cast("double"))
    return rows.agg(
        exact_mean("freight_value").alias("avg_freight"),
        money(nz_sum("freight_value")).alias("total_freight"),
        F.round(F.avg(ratio) * 100, 6).alias("freight_ratio_pct"))


def freight_by_category(fact: DataFrame, k: int = 15, start=None, end=None) -> DataFrame:
    """Per category: mean and total freight, row count; the k categories
    with most freight."""
    rows = keyed(analysis_rows(fact, start, end), "category")
    return (rows.groupBy("category").agg(
        exact_mean("freight_value").alias("avg_freight"),
        money(nz_sum("freight_value")).alias("total_freight"),
        F.count("order_id").alias("orders"))
        .orderBy(F.desc("total_freight"), "category").limit(k))
