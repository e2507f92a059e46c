"""Binding of the driver's TPC-H-like tables to the logical source tables.

The studied system reads eight CSV files of an order dataset; the test data
holds TPC-H-like tables instead.  FIXTURES.md section 3 fixes a deterministic
mapping that plants the nulls, misses, zero prices, double reviews and
multi-row payments the analytics must handle.  Every expression is a built-in
column expression over a scan, so the binding is a projection that Catalyst
folds into each query plan (column pruning reaches the parquet scans).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.rules import hours
from mercato.sources.schema import MONEY
from mercato.sources.tables import SourceTables

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str) -> SourceTables:
    t = {n: read_driver_table(spark, sf_dir, n) for n in DRIVER_TABLES}
    # nation is the fixed 25-row TPC-H dimension: a proven size bound.
    nation = F.broadcast(t["nation"].select("n_nationkey", "n_name"))

    customers = (
        t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("b", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            (F.col("c_custkey") * 10 + F.col("b")).alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            (F.lit(10000) + F.pmod(F.col("c_nationkey") * 37 + F.col("b") * F.pmod("c_custkey", F.lit(5)),
                                   F.lit(90))).cast("string").alias("customer_zip_code_prefix"),
            F.concat_ws("_", "n_name", "c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )

    k = F.col("o_orderkey")
    odate = F.col("o_orderdate")
    orders = t["orders"].select(
        k.alias("order_id"),
        (F.col("o_custkey") * 10 + k % 3).alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
         .when(F.col("o_orderstatus") == "O", "shipped").otherwise("canceled").alias("order_status"),
        odate.alias("order_purchase_timestamp"),
        (odate + hours(k % 24)).alias("order_approved_at"),
        F.when(k % 31 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(odate + hours(k % 72))
         .alias("order_delivered_carrier_date"),
        F.when(k % 97 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(odate + hours(((k * 7) % 125) * 24 + k % 24)).alias("order_delivered_customer_date"),
        (odate + hours(F.when(k % 211 == 0, 150).otherwise(21) * 24)).alias("order_estimated_delivery_date"),
    )

    li = t["lineitem"]
    order_items = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.when(F.col("l_partkey") % 41 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice"))
         .cast(MONEY).alias("price"),
        F.col("l_quantity").cast(MONEY).alias("freight_value"),
    )

    pk = F.col("p_partkey")
    products = t["part"].where(pk % 100 != 0).select(
        pk.alias("product_id"),
        F.when(pk % 50 == 1, F.lit(None).cast("string"))
         .otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("product_category_name"),
        *[F.when(pk % nulls == 0, F.lit(None).cast("double")).otherwise(value.cast("double")).alias(name)
          for name, nulls, value in (
              ("product_name_lenght", 17, 20 + pk % 40), ("product_description_lenght", 19, (pk * 7) % 3000),
              ("product_photos_qty", 23, 1 + pk % 6), ("product_weight_g", 13, F.col("p_size")),
              ("product_length_cm", 11, F.col("p_size") + F.lit(0.5)), ("product_height_cm", 7, (pk * 3) % 97 / F.lit(4.0)),
              ("product_width_cm", 5, (pk * 13) % 61 / F.lit(8.0)))],
    )

    sellers = t["supplier"].join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("seller_id"),
        (F.lit(20000) + F.col("s_nationkey")).cast("string").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_state"),
    )

    payments = li.where(F.col("l_orderkey") % 89 != 0).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_partkey").alias("source_row"),
        F.lower("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        F.col("l_extendedprice").cast(MONEY).alias("payment_value"),
    )

    reviews = (
        t["orders"].withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
        .where((k % 7 != 0) & ((F.col("k") == 0) | (k % 11 == 0)))
        .select(
            k.alias("order_id"),
            F.col("k").alias("review_no"),
            (F.lit(1) + (k + F.col("k")) % 5).alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), k.cast("string")))
             .alias("review_comment_message"),
            (odate + hours(F.lit(24 * 25))).alias("review_creation_date"),
            (odate + hours(F.lit(24 * 27))).alias("review_answer_timestamp"),
        )
    )

    # zip prefixes as numbers, and repeated rows where c_custkey divides by 5
    geolocation = (
        t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("b", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        .select(
            (F.lit(10000) + F.pmod(F.col("c_nationkey") * 37 + F.col("b") * F.pmod("c_custkey", F.lit(5)),
                                   F.lit(90))).alias("geolocation_zip_code_prefix"),
            (F.col("c_custkey") % 180 / F.lit(2.0) - 45).alias("geolocation_lat"),
            (F.col("c_custkey") % 360 / F.lit(2.0) - 90).alias("geolocation_lng"),
            F.concat_ws("_", "n_name", "c_mktsegment").alias("geolocation_city"),
            F.when(F.col("c_custkey") % 29 != 0, F.col("n_name")).alias("geolocation_state"),
        )
    )

    return SourceTables(customers=customers, orders=orders, order_items=order_items,
                        payments=payments, reviews=reviews, products=products,
                        sellers=sellers, geolocation=geolocation, category_translation=None)


def source_paths(sf_dir: str) -> list[str]:
    """The files that ``bind`` reads."""
    return [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in DRIVER_TABLES if n != "region"]


def derived_translation(products_clean: DataFrame) -> DataFrame:
    """Stand-in for the translation service (CLN8): one label per distinct
    category.  brand_1 and brand_2 share a label so that two categories merge
    in later groupings, as two source names with one translation do."""
    cats = products_clean.select("product_category_name").distinct()
    base = F.initcap(F.replace("product_category_name", F.lit("_"), F.lit(" ")))
    return cats.where(F.col("product_category_name").isNotNull()).select(
        "product_category_name",
        F.when(F.col("product_category_name") == "brand_2", F.lit("Brand 1")).otherwise(base).alias("label"),
    )
