"""Geographic insight.

Distinct counts run on rows first reduced to order grain: one partial
aggregate per (key, order, customer) shrinks item x review rows to orders
before the shuffle, and what remains needs at most two distinct aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.rules import keyed, money, nz_sum
from mercato.operators.fact import analysis_rows


def _order_grain(fact: DataFrame, keys: list[str], start, end, extra=()) -> DataFrame:
    rows = keyed(analysis_rows(fact, start, end), *keys)
    return rows.groupBy(*keys, "order_id", "customer_id").agg(
        nz_sum("payment_value").alias("rev"), *extra)


def sales_by_state(fact: DataFrame, start=None, end=None) -> DataFrame:
    """G1: revenue, distinct orders, distinct customer ids, mean order value."""
    og = _order_grain(fact, ["customer_state"], start, end)
    return og.groupBy("customer_state").agg(
        money(F.sum("rev")).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        F.count_distinct("customer_id").alias("unique_customers"),
    ).withColumn("avg_order_value", F.col("total_revenue") / F.col("total_orders")).orderBy(
        F.desc("total_revenue"), "customer_state")


#: 2^14 registers a sketch: a standard error of 0.8 %.
SKETCH_LG = 14


def state_sketches(fact: DataFrame) -> DataFrame:
    """A4 (approximate form): per purchase day and state the revenue and mergeable sketches of the order
    and customer ids.  Stored once (``Context.sketches``), any date range merges a few small rows."""
    rows = keyed(analysis_rows(fact), "customer_state", "purchase_date")
    return rows.groupBy("purchase_date", "customer_state").agg(
        nz_sum("payment_value").alias("revenue"),
        F.hll_sketch_agg("order_id", F.lit(SKETCH_LG)).alias("orders"),
        F.hll_sketch_agg("customer_id", F.lit(SKETCH_LG)).alias("customers"))


def sales_by_state_approx(sketches: DataFrame, start=None, end=None) -> DataFrame:
    """G1 from stored sketches: the revenue is exact, the distinct counts are estimates (``sales_by_state``
    is exact and the default)."""
    days = sketches
    if start is not None:
        days = days.where(F.col("purchase_date") >= F.lit(str(start)).cast("date"))
    if end is not None:
        days = days.where(F.col("purchase_date") <= F.lit(str(end)).cast("date"))
    return days.groupBy("customer_state").agg(
        money(F.sum("revenue")).alias("total_revenue"),
        F.hll_sketch_estimate(F.hll_union_agg("orders")).alias("total_orders"),
        F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("unique_customers"),
    ).withColumn("avg_order_value", F.try_divide(F.col("total_revenue"), F.col("total_orders"))).orderBy(F.desc("total_revenue"), "customer_state")


def top_states(fact: DataFrame, k: int = 15, start=None, end=None) -> DataFrame:
    return sales_by_state(fact, start, end).orderBy(F.desc("total_revenue"), "customer_state").limit(k)


def sales_by_state_kpis(fact: DataFrame, start=None, end=None) -> DataFrame:
    """G1k: number of states, top state by revenue (ties: name), its revenue."""
    s = sales_by_state(fact, start, end)
    return s.agg(
        F.count(F.lit(1)).alias("total_states"),
        F.min_by("customer_state", F.struct(-F.col("total_revenue"), F.col("customer_state"))).alias("top_state"),
        F.max("total_revenue").alias("top_state_revenue"))


def customer_distribution(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct customer ids, orders, revenue and the two ratios per state."""
    s = sales_by_state(fact, start, end)
    return s.select(
        "customer_state", "unique_customers", "total_orders", "total_revenue",
        (F.col("total_orders") / F.col("unique_customers")).alias("orders_per_customer"),
        (F.col("total_revenue") / F.col("unique_customers")).alias("revenue_per_customer")).orderBy(
        F.desc("unique_customers"), "customer_state")


def top_customer_states(fact: DataFrame, k: int = 15, start=None, end=None) -> DataFrame:
    return (customer_distribution(fact, start, end)
            .orderBy(F.desc("unique_customers"), "customer_state").limit(k))


def seller_performance(fact: DataFrame, start=None, end=None) -> DataFrame:
    """Sellers, orders, revenue, product value and per-seller ratios per
    seller state."""
    rows = keyed(analysis_rows(fact, start, end), "seller_state")
    og = rows.groupBy("seller_state", "seller_id", "order_id").agg(
        nz_sum("payment_value").alias("rev"), nz_sum("price").alias("pv"))
    return og.groupBy("seller_state").agg(
        F.count_distinct("seller_id").alias("unique_sellers"),
        F.count_distinct("order_id").alias("total_orders"),
        money(F.sum("rev")).alias("total_revenue"),
        money(F.sum("pv")).alias("product_value"),
    ).withColumns({
        "avg_orders_per_seller": F.col("total_orders") / F.col("unique_sellers"),
        "avg_revenue_per_seller": F.col("total_revenue") / F.col("unique_sellers"),
    }).orderBy(F.desc("total_revenue"), "seller_state")


def top_seller_states(fact: DataFrame, k: int = 15, start=None, end=None) -> DataFrame:
    return seller_performance(fact, start, end).orderBy(F.desc("total_revenue"), "seller_state").limit(k)


def seller_kpis(fact: DataFrame, start=None, end=None) -> DataFrame:
    """G3k: seller states, active sellers, and the *unweighted* mean over
    states of orders per seller (rounded to 6 places: a float mean)."""
    s = seller_performance(fact, start, end)
    return s.agg(F.count(F.lit(1)).alias("total_seller_states"),
                 F.sum("unique_sellers").alias("total_active_sellers"),
                 F.round(F.avg("avg_orders_per_seller"), 6).alias("avg_orders_per_seller"))


def city_analysis(fact: DataFrame, k: int = 20, start=None, end=None) -> DataFrame:
    """Per (city, state): customer ids, orders, revenue, mean review score
    over rows, mean order value; the k cities with most revenue."""
    og = _order_grain(fact, ["customer_city", "customer_state"], start, end,
                      extra=(F.sum("review_score").alias("rs_sum"), F.count("review_score").alias("rs_n")))
    out = og.groupBy("customer_city", "customer_state").agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count(F.lit(1)).alias("orders"),
        money(F.sum("rev")).alias("revenue"),
        F.try_divide(F.sum("rs_sum").cast("double"), F.sum("rs_n").cast("double")).alias("avg_review_score"),
    ).withColumn("avg_order_value", F.col("revenue") / F.col("orders"))
    return out.orderBy(F.desc("revenue"), "customer_city", "customer_state").limit(k)


def _state_category(fact: DataFrame, start, end) -> DataFrame:
    rows = keyed(analysis_rows(fact, start, end), "customer_state", "category")
    og = rows.groupBy("customer_state", "category", "order_id").agg(nz_sum("payment_value").alias("rev"))
    return og.groupBy("customer_state", "category").agg(
        F.sum("rev").alias("revenue_dec"), F.count(F.lit(1)).alias("orders"))


def _ranked(sc: DataFrame) -> DataFrame:
    w = Window.partitionBy("customer_state").orderBy(F.desc("revenue_dec"), F.asc("category"))
    return sc.withColumn("revenue_rank", F.row_number().over(w).cast("bigint"))


def state_top_categories(fact: DataFrame, state: str | None = None, k: int = 10,
                         start=None, end=None) -> DataFrame:
    """Each state's k categories with most revenue, with distinct orders.
    Computed for every state in one job (the rank window's groups are one
    state's categories); ``state`` selects one."""
    sc = _state_category(fact, start, end)
    if state is not None:
        sc = sc.where(F.col("customer_state") == state)
    return (_ranked(sc).where(F.col("revenue_rank") <= k)
            .select("customer_state", "revenue_rank", "category", money("revenue_dec").alias("revenue"), "orders"))


def state_vs_national(fact: DataFrame, state: str | None = None, k: int = 10,
                      start=None, end=None) -> DataFrame:
    """For each state's top-k categories: share of the state's revenue,
    share of national revenue, and the difference (percent).  Denominators
    cover non-null categories only; the national one also covers rows without
    a state.  One (state, category) aggregate feeds the rank and the state totals
    (a window over the same state partitioning); orders are not needed here, so
    rows are reduced to states x categories before the shuffle."""
    sc = keyed(analysis_rows(fact, start, end), "customer_state", "category").groupBy(
        "customer_state", "category").agg(nz_sum("payment_value").alias("revenue_dec"))
    state_tot = Window.partitionBy("customer_state")
    ranked = _ranked(sc).withColumn(
        "state_pct", F.col("revenue_dec").cast("double") / F.sum("revenue_dec").over(state_tot).cast("double") * 100)
    national = keyed(analysis_rows(fact, start, end), "category")  # rows without a state count nationally
    nat = national.groupBy("category").agg(nz_sum("payment_value").alias("nat_rev"))
    nat = nat.withColumn("national_pct", F.col("nat_rev").cast("double")
                         / F.sum("nat_rev").over(Window.partitionBy()).cast("double") * 100)
    top = ranked.where(F.col("revenue_rank") <= k)
    if state is not None:
        top = top.where(F.col("customer_state") == state)
    out = top.join(nat.select("category", "national_pct"), "category", "left")
    sp, npct = F.coalesce("state_pct", F.lit(0.0)), F.coalesce("national_pct", F.lit(0.0))
    return out.select("customer_state", "revenue_rank", "category", sp.alias("state_pct"),
                      npct.alias("national_pct"), (sp - npct).alias("difference"))


def distinct_states(fact: DataFrame, start=None, end=None) -> DataFrame:
    """The sorted state list behind the state selector."""
    return (keyed(analysis_rows(fact, start, end), "customer_state")
            .select("customer_state").distinct().orderBy("customer_state"))
