"""Cleaning of the source tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import day_diff
from mercato.operators.medians import group_medians
from mercato.operators.skew import SALT, found_hot, hot_keys, partitions, spread
from mercato.sources.tables import SourceTables

DATE_COLS = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
             "order_delivered_customer_date", "order_estimated_delivery_date")
PRODUCT_NUMERIC = ("product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g",
                   "product_length_cm", "product_height_cm", "product_width_cm")
ZIP_COLS = {"customers": "customer_zip_code_prefix", "geolocation": "geolocation_zip_code_prefix",
            "sellers": "seller_zip_code_prefix"}


def dedupe(df: DataFrame) -> DataFrame:
    """CLN1: drop fully duplicate rows of a table whose next step shuffles by another key.

    The rows are hash-partitioned on all columns, so no single key value can
    concentrate the work in one task.  (Deduplicating a dimension under an
    explicit ``repartition(key)`` would save the join's own shuffle, but a
    user repartition is not a shuffle AQE may split, so a hot key on the
    fact side of that join would lose AQE's skew-join handling.)"""
    return df.dropDuplicates()


def dedupe_by(df: DataFrame, key: str, hot: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """CLN1 on the way to a join or aggregate by ``key``: one shuffle by the key (hot keys
    dealt to salts, ``operators.skew``; to ``n`` partitions), duplicates dropped inside the partitions."""
    return spread(df, key, hot, n).dropDuplicates()


def parse_timestamps(df: DataFrame, cols: Sequence[str], fmt: str | None = None) -> DataFrame:
    """CLN2: strict parse; under ANSI a malformed value fails the job."""
    return df.withColumns({c: (F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c))
                           for c in cols})


def coerce_timestamps(df: DataFrame, cols: Sequence[str], fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CLN3: parse, malformed -> NULL (``errors='coerce'``).  The lenient
    parse only tests validity; the value comes from the wall-clock
    (``timestamp_ntz``) parser, so no session time zone can shift it."""
    return df.withColumns({c: F.when(F.try_to_timestamp(F.col(c), F.lit(fmt)).isNotNull(),
                                     F.to_timestamp_ntz(F.col(c), F.lit(fmt)))
                           for c in cols})


def fill_text(df: DataFrame, values: dict) -> DataFrame:
    """CLN5: fill NULL text columns with constants."""
    return df.fillna(values)


def impute_group_median(df: DataFrame, group: str, cols: Sequence[str],
                        medians: DataFrame | None = None) -> DataFrame:
    """CLN6: fill NULLs with the median of the row's group; an all-NULL group
    stays NULL.  The per-group table (one row per group) is joined back,
    broadcast by AQE when it is small."""
    med = medians if medians is not None else group_medians(df, group, cols)
    out = df.join(med, group, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__med_{c}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def zip_to_text(df: DataFrame, col: str) -> DataFrame:
    """CLN7: a zip prefix read as a number becomes text (no leading zeros come back:
    ``sources.schema`` declares the column as text so that none is lost)."""
    return df.withColumn(col, F.col(col).cast("string"))


def label_categories(df: DataFrame, translation: DataFrame | None, src: str = "product_category_name",
                     dst: str = "category") -> DataFrame:
    """CLN8: category label = translation, else ``initcap`` of the name with
    ``_`` as space; NULL stays NULL.  (``initcap`` capitalises only after a
    space, Python's ``title`` after any non-letter: T8.)"""
    fallback = F.initcap(F.replace(F.col(src), F.lit("_"), F.lit(" ")))
    if translation is None:
        return df.withColumn(dst, fallback)
    tr = translation.select(F.col("product_category_name").alias("__tr_key"), F.col("label").alias("__tr_label"))
    return (df.join(tr, F.col(src) == F.col("__tr_key"), "left")
              .withColumn(dst, F.when(F.col(src).isNotNull(), F.coalesce("__tr_label", fallback)))
              .drop("__tr_key", "__tr_label"))


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with a delivery date, plus the order-level day counts
    (P1, CLN4, P9)."""
    return (orders.where((F.col("order_status") == "delivered")
                         & F.col("order_delivered_customer_date").isNotNull())
            .withColumn("delivery_time", day_diff("order_delivered_customer_date", "order_purchase_timestamp"))
            .withColumn("delay_vs_estimated",
                        day_diff("order_delivered_customer_date", "order_estimated_delivery_date")))


def payments_per_order(payments: DataFrame) -> DataFrame:
    """One row per order: total value, most instalments, and the type of
    the first payment row (T9: 'first' = smallest payment_sequential, then the
    source row position, value and type, as Spark has no file order)."""
    return payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.min_by("payment_type", F.struct("payment_sequential", "source_row", "payment_value",
                                          "payment_type")).alias("payment_type"),
    )


def clean_products(products: DataFrame, translation: DataFrame | None = None,
                   translation_builder=None) -> tuple[DataFrame, DataFrame]:
    filled = fill_text(dedupe(products), {"product_category_name": "unknown"})
    cols = [c for c in PRODUCT_NUMERIC if c in filled.columns]
    med = group_medians(filled, "product_category_name", cols)
    imputed = impute_group_median(filled, "product_category_name", cols, medians=med)
    if translation is None and translation_builder is not None:
        # the median table already holds each category once
        translation = translation_builder(med)
    return label_categories(imputed, translation), translation


class CleanTables:
    """The cleaned tables, each made when it is first asked for."""

    def __init__(self, src: SourceTables, translation_builder=None):
        self.src, self.translation_builder = src, translation_builder

    @cached_property
    def hot_orders(self) -> DataFrame | None:
        """Orders with more items, payments or reviews than one task should get; None if there are none."""
        keys = [getattr(self.src, t).select("order_id", F.lit(t).alias("t")) for t in ("order_items", "payments", "reviews")]
        # counted per table: the key pairs an order with the table
        pairs = reduce(DataFrame.union, keys).where("order_id is not null").select(F.struct("order_id", "t").alias("k"))
        hot = hot_keys(pairs, "k").groupBy(F.col("k.order_id").alias("order_id")).agg(F.max("__salts").alias("__salts"))
        return found_hot(hot)

    @cached_property
    def order_partitions(self) -> int | None:
        """Partitions of the shuffles by order, from the number of items; None: the session's."""
        return partitions(self.src.order_items, self.src.order_items.count())

    @cached_property
    def customers(self) -> DataFrame:
        return dedupe(zip_to_text(self.src.customers, ZIP_COLS["customers"]))

    @cached_property
    def orders(self) -> DataFrame:
        """Delivered, with day counts."""
        return delivered_orders(dedupe(self.src.orders))

    @cached_property
    def order_items(self) -> DataFrame:
        return dedupe(self.src.order_items)

    @cached_property
    def _products(self) -> tuple[DataFrame, DataFrame]:
        return clean_products(self.src.products, self.src.category_translation, self.translation_builder)

    @property
    def products(self) -> DataFrame:
        """Filled, imputed, labelled."""
        return self._products[0]

    @property
    def category_translation(self) -> DataFrame:
        return self._products[1]

    @cached_property
    def sellers(self) -> DataFrame:
        return dedupe(zip_to_text(self.src.sellers, ZIP_COLS["sellers"]))

    @cached_property
    def geolocation(self) -> DataFrame:
        return dedupe(zip_to_text(self.src.geolocation, ZIP_COLS["geolocation"]))

    @cached_property
    def payments(self) -> DataFrame:
        return dedupe_by(self.src.payments, "order_id", self.hot_orders, self.order_partitions).drop(SALT)

    @cached_property
    def payments_agg(self) -> DataFrame:
        """One row per order."""
        return payments_per_order(self.payments)

    @cached_property
    def reviews(self) -> DataFrame:
        """Text filled."""
        return fill_text(dedupe_by(self.src.reviews, "order_id", self.hot_orders, self.order_partitions).drop(SALT),
                         {"review_comment_title": "", "review_comment_message": ""})


def clean(src: SourceTables, translation_builder=None) -> CleanTables:
    return CleanTables(src, translation_builder)
