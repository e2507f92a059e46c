"""Customer behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import keyed, money, nz_sum
from mercato.operators.fact import delivered


def orders_per_customer(fact: DataFrame) -> DataFrame:
    rows = keyed(delivered(fact), "customer_unique_id")
    return rows.groupBy("customer_unique_id").agg(F.count_distinct("order_id").alias("order_count"))


def customer_loyalty(fact: DataFrame) -> DataFrame:
    """B1: customers, repeat (> 1 distinct order), single, repeat % (0 when no
    customer).  Two aggregates: a per-customer distinct count, then one row."""
    per = orders_per_customer(fact)
    tot = per.agg(F.count(F.lit(1)).alias("total_customers"),
                  F.coalesce(F.sum(F.when(F.col("order_count") > 1, 1).otherwise(0)), F.lit(0))
                   .cast("bigint").alias("repeat_customers"))
    return tot.select(
        "total_customers", "repeat_customers",
        (F.col("total_customers") - F.col("repeat_customers")).alias("single_customers"),
        F.when(F.col("total_customers") > 0,
               F.col("repeat_customers").cast("double") / F.col("total_customers") * 100)
         .otherwise(F.lit(0.0)).alias("repeat_rate"))


def payment_analysis(fact: DataFrame) -> DataFrame:
    """B2: revenue and distinct orders per payment type."""
    rows = keyed(delivered(fact), "payment_type")
    return rows.groupBy("payment_type").agg(
        money(nz_sum("payment_value")).alias("total_revenue"),
        F.count_distinct("order_id").alias("order_volume")).orderBy(F.desc("total_revenue"), "payment_type")


def orders_by_review_score(fact: DataFrame) -> DataFrame:
    """Distinct orders per review score; an order with two scores counts
    under both."""
    rows = keyed(delivered(fact), "review_score")
    return rows.groupBy(F.col("review_score").cast("bigint").alias("review_score")).agg(
        F.count_distinct("order_id").alias("total_orders"))
