"""Churn label and customer features (CH1-CH3, A16, W2, W5).

Plan: the delivered rows are read once and reduced by a partial aggregate
to (customer, order) grain; label, features, payment mode and gaps all
derive from that table, so no distinct aggregate and no per-customer row
window is needed.  That table is checkpointed to the shared folder, so the
fact is scanned once although the branches use different columns of it.  The purchase gaps (W2) use a
window over each customer's *distinct purchase dates*, whose number is
bounded by the calendar, not by the rows.  The global end date is a scalar
subquery (one value, computed once), never a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.rules import day_diff, keyed, money
from mercato.operators.fact import delivered
from mercato.session import checkpoint_root

CHURN_WINDOW_DAYS = 90
RECENT_WINDOWS = (30, 60, 90)
CUST = "customer_unique_id"

FEATURE_COLUMNS = [
    "num_orders", "total_spent", "avg_order_value", "avg_review", "avg_delivery_days", "avg_delay",
    "total_items", "recency", "tenure_days", "avg_days_between", "std_days_between",
    "orders_last_30d", "orders_last_60d", "orders_last_90d", "pct_late",
]


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n), F.lit(0), F.lit(0), F.lit(0))


def churn_rows(fact: DataFrame) -> DataFrame:
    """Delivered rows with the purchase *date at midnight* as the purchase
    time (so delivery days differ from P9, which starts at the timestamp)."""
    return delivered(fact).select(
        CUST, "order_id", "order_item_id", "payment_type", "review_score", "item_total",
        F.col("purchase_date").cast("timestamp_ntz").alias("purchase_ts"),
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ).withColumns({
        "delivery_days": day_diff("order_delivered_customer_date", "purchase_ts"),
        "delay_days": day_diff("order_delivered_customer_date", "order_estimated_delivery_date"),
    })


def order_grain(fact: DataFrame, materialize: bool = True) -> DataFrame:
    """The one scan of the fact every churn output derives from: delivered
    rows reduced to (customer, order) by a partial aggregate.  Purchase time,
    delays and payment type are order-level attributes of the fact (payments
    are aggregated per order, A15), so nothing is lost; the sums and counts
    keep every row-level mean exact.

    The label, the features, the payment mode, the gaps and the end date each
    use different columns of this table, so Catalyst would prune it
    differently per branch and scan the fact once per branch.  It is
    therefore checkpointed (reliably, to the shared checkpoint folder): one
    fact scan, and the small order-grain table is what the branches read."""
    og = churn_rows(fact).groupBy(CUST, "order_id").agg(
        F.max("purchase_ts").alias("order_ts"),
        F.max("payment_type").alias("payment_type"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("order_item_id").alias("n_items"),
        F.sum("item_total").alias("it_sum"), F.count("item_total").alias("it_n"),
        F.sum("review_score").alias("rs_sum"), F.count("review_score").alias("rs_n"),
        F.sum("delivery_days").alias("dd_sum"), F.count("delivery_days").alias("dd_n"),
        F.sum("delay_days").alias("dl_sum"), F.count("delay_days").alias("dl_n"),
    )
    if materialize:
        checkpoint_root(fact.sparkSession)
        og = og.checkpoint(eager=True)
    return og


def global_end(og: DataFrame) -> Column:
    """Latest delivered purchase time (rows without a customer included), as
    a scalar subquery column."""
    return og.agg(F.max("order_ts")).scalar()


def _label(og: DataFrame, end: Column) -> DataFrame:
    last = keyed(og, CUST).groupBy(CUST).agg(F.max("order_ts").alias("last_ts"))
    return last.select(
        CUST, day_diff(end, "last_ts").alias("days_since_last"),
        (day_diff(end, "last_ts") > CHURN_WINDOW_DAYS).cast("bigint").alias("churn"))


def churn_label(fact: DataFrame) -> DataFrame:
    """CH1: churn = last purchase more than 90 days before the data's end."""
    og = order_grain(fact)
    return _label(og, global_end(og))


def _feature_orders(og: DataFrame):
    cutoff = global_end(og) - _days(CHURN_WINDOW_DAYS)
    return keyed(og, CUST).where(F.col("order_ts") <= cutoff), cutoff


def _gaps(fog: DataFrame) -> DataFrame:
    """W2 on the feature-period orders: rows are counted per (customer, date);
    the gaps between distinct dates plus (rows - dates) zeros are the whole
    multiset of row-to-row gaps.  The lag window's groups are one customer's
    distinct dates, bounded by the calendar."""
    per_day = fog.groupBy(CUST, F.col("order_ts").alias("d")).agg(F.sum("n_rows").alias("c"))
    w = Window.partitionBy(CUST).orderBy("d")
    gaps = per_day.withColumn("g", day_diff("d", F.lag("d").over(w)))
    agg = gaps.groupBy(CUST).agg(F.sum("c").alias("n"),
                                 F.coalesce(F.sum("g"), F.lit(0)).alias("s1"),
                                 F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).alias("s2"))
    k = F.col("n") - 1
    num = (k.cast("decimal(38,0)") * F.col("s2") - F.col("s1").cast("decimal(38,0)") * F.col("s1"))
    return agg.select(
        CUST,
        F.when(k >= 1, F.col("s1").cast("double") / k.cast("double")).alias("avg_days_between"),
        F.when(k >= 2, F.sqrt(num.cast("double") / (k * (k - 1)).cast("double"))).alias("std_days_between"))


def purchase_gaps(fact: DataFrame) -> DataFrame:
    """Mean and sample std of the day gaps between consecutive purchase
    rows per customer (same-day rows give gap 0; one row -> NULL, two rows ->
    std NULL)."""
    fog, _ = _feature_orders(order_grain(fact))
    return _gaps(fog)


def _preferred_payment(fog: DataFrame) -> DataFrame:
    """A7 over rows: the type with most rows; ties -> the smallest; none ->
    NULL here, 'unknown' after the caller's left join."""
    counts = fog.where(F.col("payment_type").isNotNull()).groupBy(CUST, "payment_type").agg(
        F.sum("n_rows").alias("n"))
    return counts.groupBy(CUST).agg(
        F.min_by("payment_type", F.struct(-F.col("n"), F.col("payment_type"))).alias("preferred_payment"))


def preferred_payment(rows: DataFrame) -> DataFrame:
    """A7 on plain rows (customer, payment_type)."""
    return _preferred_payment(rows.withColumn("n_rows", F.lit(1)))


def _features(fog: DataFrame, cutoff: Column) -> DataFrame:
    def ratio(s, n):
        return F.try_divide(F.sum(s).cast("double"), F.sum(n).cast("double"))

    late = F.when(F.try_divide(F.col("dl_sum").cast("double"), F.col("dl_n").cast("double")) > 0, 1).otherwise(0)
    recent = {f"orders_last_{d}d": F.sum(F.when(F.col("order_ts") >= cutoff - _days(d), 1).otherwise(0))
              .cast("bigint") for d in RECENT_WINDOWS}
    cf = fog.groupBy(CUST).agg(
        F.count(F.lit(1)).alias("num_orders"),
        money(F.coalesce(F.sum("it_sum"), F.lit(0))).alias("total_spent"),
        ratio("it_sum", "it_n").alias("avg_order_value"),
        ratio("rs_sum", "rs_n").alias("avg_review"),
        ratio("dd_sum", "dd_n").alias("avg_delivery_days"),
        ratio("dl_sum", "dl_n").alias("avg_delay"),
        F.sum("n_items").alias("total_items"),
        F.max("order_ts").alias("last_ts"),
        F.min("order_ts").alias("first_ts"),
        F.avg(late).alias("pct_late"),
        *[v.alias(k) for k, v in recent.items()],
    )
    return cf.withColumns({
        "recency": day_diff(cutoff, "last_ts"),
        "tenure_days": day_diff(cutoff, "first_ts") + 1,
    }).drop("last_ts")


def _customer_features(fact: DataFrame) -> DataFrame:
    fog, cutoff = _feature_orders(order_grain(fact))
    return _features(fog, cutoff)


def recent_orders(fact: DataFrame) -> DataFrame:
    """Distinct orders in the 30/60/90 days up to the cutoff (inclusive)."""
    return _customer_features(fact).select(CUST, *[f"orders_last_{d}d" for d in RECENT_WINDOWS])


def pct_late_by_customer(fact: DataFrame) -> DataFrame:
    """Share of a customer's orders whose mean delay is > 0 (a NULL
    delay is not late)."""
    return _customer_features(fact).select(CUST, "pct_late")


_RATIO_FEATURES = ("avg_order_value", "avg_review", "avg_delivery_days", "avg_delay", "avg_days_between",
                   "std_days_between", "pct_late", "total_spent")


def churn_features(fact: DataFrame) -> DataFrame:
    """CH2: one row per customer with purchases up to the cutoff (end - 90 d):
    the feature columns, first_ts, preferred_payment and the churn label.
    NULL and +/-inf features become 0 (CLN9).  One fact scan: every part
    derives from the (customer, order) grain, whose exchange Spark reuses."""
    og = order_grain(fact)
    end = global_end(og)
    fog, cutoff = _feature_orders(og)
    out = (_features(fog, cutoff)
           .join(_preferred_payment(fog), CUST, "left")
           .join(_gaps(fog), CUST, "left")
           .join(_label(og, end).select(CUST, "churn"), CUST, "left"))
    filled = {}
    for c in FEATURE_COLUMNS:
        col = F.col(c)
        if c in _RATIO_FEATURES:
            col = F.when(F.isnan(col) | col.isin(float("inf"), float("-inf")), F.lit(0.0)).otherwise(col)
            filled[c] = F.coalesce(col, F.lit(0.0)).cast("double")
        else:
            filled[c] = F.coalesce(col, F.lit(0)).cast("bigint")
    return out.select(CUST, *[filled[c].alias(c) for c in FEATURE_COLUMNS], "first_ts",
                      F.coalesce("preferred_payment", F.lit("unknown")).alias("preferred_payment"),
                      F.coalesce("churn", F.lit(0)).cast("bigint").alias("churn"))


def churn_matrix(features: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """CH3: one-hot ``pay_<type>`` columns (sorted vocabulary) replace
    preferred_payment; first_ts is dropped.  Without a given vocabulary the
    distinct types are read with one small aggregate (bounded by the number
    of payment types)."""
    if vocabulary is None:
        vocabulary = sorted(r[0] for r in features.select("preferred_payment").distinct().collect())
    onehot = [(F.col("preferred_payment") == v).cast("bigint").alias(f"pay_{v}") for v in vocabulary]
    return features.select(CUST, *FEATURE_COLUMNS, *onehot, "churn")


def customer_search(features: DataFrame, pattern: str, k: int = 20) -> DataFrame:
    """Customers whose id contains the case-insensitive regex ``pattern``;
    the first k by id."""
    hit = F.col(CUST).cast("string").rlike("(?i)" + pattern)
    return features.where(hit).orderBy(CUST).limit(k)


def customer_card(features: DataFrame, customer_id) -> DataFrame:
    """One customer's feature row (a filter on the scored table)."""
    cid = customer_id if isinstance(customer_id, Column) else F.lit(customer_id)
    return features.where(F.col(CUST) == cid).limit(1)
