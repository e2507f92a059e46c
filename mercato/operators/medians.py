"""Exact medians of several columns per group, whatever a group's size (CLN6).

Spark's exact ``median`` keeps a map of all values of a group in one buffer.
That is fine while a group has at most ``limit`` values; beyond it the two middle
values are found by counting: the range between a group's least and greatest value
is cut into BINS, rows are counted per bin (partial aggregation), and the bin that
holds the middle rank, from its least to its greatest value, is the next round's
range.  A round reads the column once, keeps at most BINS rows for each
unfinished (group, column, rank), and always narrows the range; bins are cut
evenly and by magnitude in turn, so spread-out values need few rounds too.  NULL and NaN
are not values.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import checkpoint_root

LIMIT, BINS = 100_000, 1024


def _stored(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_root(df.sparkSession)}/medians-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _values(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(g, c, v): one row per value of a column."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    return df.select(F.col(group).alias("g"), F.inline(each)).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _bin(v: Column, lo: Column, hi: Column, by_magnitude: bool) -> Column:
    def scale(x):
        # halves keep the width of a range of both signs finite
        return F.signum(x) * F.log1p(F.abs(x) * 1e6) if by_magnitude else x / 2

    share = F.try_divide(scale(v) - scale(lo), scale(hi) - scale(lo))
    return F.least(F.lit(BINS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"))


def _refined(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(g, c, median) of the (g, c, n, lo, hi) of ``sizes`` by counting."""
    # a group may be the NULL one
    key = F.col("g").eqNullSafe(F.col("h")) & (F.col("c") == F.col("d"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long"))
    state = _stored(sizes.select("g", "c", F.posexplode(ranks).alias("side", "rank"), "lo", "hi"))
    turn = 0
    while state.where("lo < hi").limit(1).count():
        todo = state.where("lo < hi").select(F.col("g").alias("h"), F.col("c").alias("d"), "side", "rank", "lo", "hi")
        inside = values.join(todo, key & F.col("v").between(F.col("lo"), F.col("hi")))
        bins = inside.withColumn("bin", _bin(F.col("v"), F.col("lo"), F.col("hi"), turn % 2 == 1)).groupBy(
            "g", "c", "side", "rank", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("g", "c", "side").orderBy("bin")) - F.col("n")
        found = bins.withColumn("before", before).where("before <= rank and rank < before + n").select(
            "g", "c", "side", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")
        state = _stored(state.where("lo = hi").union(found))
        turn += 1
    both = state.groupBy("g", "c").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    return both.select("g", "c", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(
        F.lit(0.5) * F.col("a") + F.lit(0.5) * F.col("b")).alias("median"))


def group_medians(df: DataFrame, group: str, cols: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """One row per group: ``group`` and ``__med_<column>`` for every column."""
    values = _values(df, group, cols)
    sizes = values.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    large = _stored(sizes.where(F.col("n") > limit))
    plain = [F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]]
    if large.isEmpty():
        out = df.select(*plain).groupBy("g").agg(*[F.median(F.nanvl(f"v{i}", F.lit(None))).alias(f"__med_{c}") for i, c in enumerate(cols)])
        return out.withColumnRenamed("g", group)
    marked = large.select(F.col("g").alias("h"), F.col("c").alias("d"))
    small = values.join(marked, F.col("g").eqNullSafe(F.col("h")) & (F.col("c") == F.col("d")), "left_anti")
    each = small.groupBy("g", "c").agg(F.median("v").alias("median")).union(_refined(values, large))
    wide = each.groupBy("g").agg(*[F.max(F.when(F.col("c") == i, F.col("median"))).alias(f"__med_{c}") for i, c in enumerate(cols)])
    # groups without any value have a row too
    groups = df.select(F.col(group).alias("k")).distinct()
    return groups.join(wide, F.col("k").eqNullSafe(F.col("g")), "left").select(F.col("k").alias(group), *[f"__med_{c}" for c in cols])
