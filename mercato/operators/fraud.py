"""First-versus-repeat order anomaly scoring (FR1-FR4).

Reads the whole fact (no delivered or date filter) with the raw category, as
the studied code does.  Rows without a customer leave through the NULL-key
rule (T5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import keyed, money, ne_or_true
from mercato.operators.sequence import sequence_by_time

# Purchase order within a customer.  Spark has no file order (T9), so the
# tie-breakers make it a total order: they identify a fact row.
SEQUENCE_ORDER = ["order_purchase_timestamp", "order_id", "order_item_id", "product_id", "seller_id",
                  "price", "review_no", "freight_value", "shipping_limit_date"]

TOP_COLUMNS = ["order_id", "customer_unique_id", "order_value_current", "order_value_first",
               "value_ratio", "different_zip", "risk_level"]


def _customer_rows(fact: DataFrame) -> DataFrame:
    keep = dict.fromkeys(["customer_unique_id", *SEQUENCE_ORDER, "customer_zip_code_prefix"])
    return keyed(fact, "customer_unique_id").select(*keep, F.col("payment_value").alias("order_value"))


def order_sequence(fact: DataFrame) -> DataFrame:
    """W1 + W3: every customer row numbered by purchase time, with the
    customer's first row's order value and zip."""
    return sequence_by_time(_customer_rows(fact), "customer_unique_id", "order_purchase_timestamp", SEQUENCE_ORDER,
                            name="order_sequence", first_cols=["order_value", "customer_zip_code_prefix"])


def repeat_rows(fact: DataFrame) -> DataFrame:
    """Every row but the customer's first, with the first row's order value and zip, and no number:
    the first row is a partially aggregated minimum per customer, joined back (AQE splits a
    customer with very many rows; the order identifies a row)."""
    rows = _customer_rows(fact).withColumn("__at", F.struct(*SEQUENCE_ORDER))
    first = rows.groupBy("customer_unique_id").agg(
        F.min("__at").alias("__first"),
        F.min_by(F.struct("order_value", "customer_zip_code_prefix"), "__at").alias("__with"))
    return rows.join(first, "customer_unique_id").where(F.col("__at") > F.col("__first")).select(
        *[c for c in rows.columns if c != "__at"], F.col("__with.order_value").alias("first_order_value"),
        F.col("__with.customer_zip_code_prefix").alias("first_customer_zip_code_prefix"))


def _ratios(rows: DataFrame, *more: str) -> DataFrame:
    cur, first = money("order_value"), money("first_order_value")
    return rows.select(
        "customer_unique_id", "order_id", F.col("order_item_id").cast("bigint").alias("order_item_id"),
        "product_id", *more,
        cur.alias("order_value_current"), first.alias("order_value_first"),
        F.col("customer_zip_code_prefix").alias("zip_current"),
        F.col("first_customer_zip_code_prefix").alias("zip_first"),
        (cur / (first + F.lit(1.0))).alias("value_ratio"),
        ne_or_true("customer_zip_code_prefix", "first_customer_zip_code_prefix").alias("different_zip"))


def fraud_pairs(fact: DataFrame) -> DataFrame:
    """FR1: each repeat row (sequence >= 2) against the customer's first row:
    value_ratio = current / (first + 1), different_zip (NULL side = different,
    T7).  No self-join: the first row's values come with the numbering."""
    return _ratios(order_sequence(fact).where(F.col("order_sequence") >= 2), "order_sequence")


def fraud_score(ratio, different_zip):
    """FR2: >= 5 and another zip -> 100; >= 5 -> 75; [3, 5) and another zip ->
    50; else 0 (a NULL ratio scores 0)."""
    r, d = F.col(ratio), F.col(different_zip)
    return (F.when((r >= 5) & d, 100).when(r >= 5, 75).when((r >= 3) & (r < 5) & d, 50)
             .otherwise(0).cast("bigint"))


def risk_level(score):
    """FR3 labels over the bins [0, 80], (80, 99], (99, 100]."""
    s = F.col(score)
    # The three risk labels of the studied dashboard.
    return (F.when((s >= 0) & (s <= 80), "High Risk").when((s > 80) & (s <= 99), "Very High Risk")
             .when((s > 99) & (s <= 100), "Critical Risk"))


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("fraud_score", fraud_score("value_ratio", "different_zip"))


def _cases(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("fraud_score") >= 75).withColumn("risk_level", risk_level("fraud_score"))


def fraud_scored(fact: DataFrame) -> DataFrame:
    return _scored(fraud_pairs(fact))


def fraud_cases(fact: DataFrame) -> DataFrame:
    """FR3: rows scoring 75 or more, with their risk level."""
    return _cases(fraud_scored(fact))


def fraud_count(fact: DataFrame) -> DataFrame:
    """FR4: number of fraud cases; nothing needs a row's number here."""
    return _cases(_scored(_ratios(repeat_rows(fact)))).agg(F.count(F.lit(1)).alias("fraud_cases"))


def fraud_top(fact: DataFrame, k: int = 20) -> DataFrame:
    """FR4: the k cases with the highest ratio; ties keep purchase order
    (customer, then sequence), as ``nlargest(keep='first')`` on the sorted
    frame does: the order within a customer stands for its numbers."""
    rest = [c for c in SEQUENCE_ORDER if c not in ("order_id", "order_item_id", "product_id")]
    cases = _cases(_scored(_ratios(repeat_rows(fact), *rest)))
    return (cases.orderBy(F.desc("value_ratio"), "customer_unique_id", *[F.col(c).asc_nulls_first() for c in SEQUENCE_ORDER])
            .limit(k).select(*TOP_COLUMNS))


def export_fraud_cases(fact: DataFrame, path: str) -> None:
    """SNK4: every fraud case as CSV with a header (written by the executors,
    one file per task, never through the driver)."""
    from mercato.sources.io import write_csv
    write_csv(fraud_cases(fact), path)


def fraud_candidates(fact: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """SNK5: the stored fraud cases, computed and written on first use."""
    from mercato.sources.io import materialize
    return materialize(fact.sparkSession, path, lambda: fraud_cases(fact), overwrite=rebuild)
