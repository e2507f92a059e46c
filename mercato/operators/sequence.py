"""Row numbering within a group that survives a hot group.

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends each group to a
single task; if one customer holds a third of all rows, one task does a third
of the work.  Here the rows are range-partitioned on (group, order), so a hot
group is cut into several contiguous slices, one per partition:

1. ``repartitionByRange(n, g, o)``; each row learns its slice (partition id).
   The range bounds come from a sample whose outcome depends on the upstream
   physical partitioning, so the tagged rows are checkpointed (reliably, to
   the shared ``spark.checkpoint.dir``) before their two uses below: every
   use, and every retry after a lost executor, sees one slice assignment.
2. Local row numbers per (slice, group) - a window over at most one
   partition's worth of rows.
3. A small table per (slice, group): row count and the slice's first row.
   A window per group over that table (at most n rows per group) gives the
   rows in earlier slices (the offset) and the group's first row.
4. Join back on (slice, group): number = offset + local number.

Two shuffles and one checkpoint write of the rows; no group ever sits in
one task, nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import checkpoint_root


def _asc(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_first()


def sequence_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "seq",
                    first_cols: Sequence[str] = (), first_prefix: str = "first_",
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row in its group by ``order``
    (ascending, NULLs first; make ``order`` a total order for a deterministic
    result) and ``first_prefix + c`` = the group's first row's value of each
    ``first_cols`` column."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    group, order = list(group), list(order)
    sort_cols = [_asc(c) for c in group + order]

    checkpoint_root(spark)  # the cluster's shared folder; a local one only when unset
    ranged = (df.repartitionByRange(n, *sort_cols).withColumn("__slice", F.spark_partition_id())
              .checkpoint(eager=True))
    w_local = Window.partitionBy("__slice", *group).orderBy(*[_asc(c) for c in order])
    local = ranged.withColumn("__lrn", F.row_number().over(w_local))

    firsts = F.struct(*[F.col(c).alias(c) for c in first_cols]) if first_cols else F.lit(None)
    stats = local.groupBy("__slice", *group).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by(firsts, "__lrn").alias("__first"))
    w_grp = Window.partitionBy(*group).orderBy("__slice")
    stats = stats.select(
        "__slice", *group,
        F.coalesce(F.sum("__n").over(w_grp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         .alias("__offset"),
        F.first("__first").over(w_grp.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
         .alias("__gfirst"))

    out = local.join(stats, ["__slice", *group])
    out = out.withColumn(name, (F.col("__offset") + F.col("__lrn")).cast("bigint"))
    for c in first_cols:
        out = out.withColumn(first_prefix + c, F.col("__gfirst")[c])
    return out.drop("__slice", "__lrn", "__offset", "__gfirst")


def _seconds(ts: str) -> Column:
    """Seconds since 1970 of a wall-clock timestamp; NULL comes before all others."""
    t = F.col(ts)
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return F.coalesce(days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t)), F.lit(-2**52)).cast("long")


def sequence_by_time(df: DataFrame, group: str, ts: str, order: Sequence[str], name: str = "seq",
                     first_cols: Sequence[str] = (), first_prefix: str = "first_") -> DataFrame:
    """The numbers of ``sequence_within`` for an ``order`` that starts with the timestamp ``ts``, by counting.

    Rows are counted per (group, second), partially aggregated, and the counts are summed up in two
    steps: over the days of a group, and over the seconds of a day (at most 86,400).  That gives
    every second the number of the group's rows before it.  The rows are shuffled once, by
    (group, second), and numbered inside; no sort of all rows and no checkpoint.  One task holds at most
    the rows of one group within one second.  NULL groups are not expected (T5)."""
    keyed_rows = df.withColumn("__sec", _seconds(ts))
    firsts = F.struct(*[F.col(c).alias(c) for c in first_cols]) if first_cols else F.lit(None)
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    # a minimum of structs takes NULL fields first, as the numbering does
    seconds = keyed_rows.groupBy(group, "__sec").agg(F.count(F.lit(1)).alias("__n"), F.min_by(firsts, place).alias("__first")).withColumn(
        "__day", F.floor(F.col("__sec") / 86400))
    days = seconds.groupBy(group, "__day").agg(F.sum("__n").alias("__n"), F.min_by("__first", "__sec").alias("__first"))
    whole = Window.partitionBy(group).orderBy("__day")
    days = days.select(group, "__day", (F.sum("__n").over(whole) - F.col("__n")).alias("__before"),
                       F.first("__first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__gfirst"))
    within = F.sum("__n").over(Window.partitionBy(group, "__day").orderBy("__sec")) - F.col("__n")
    offsets = seconds.select(group, "__sec", "__day", within.alias("__within")).join(days, [group, "__day"]).select(
        group, "__sec", (F.col("__before") + F.col("__within")).alias("__offset"), "__gfirst")
    local = F.row_number().over(Window.partitionBy(group, "__sec").orderBy(*[_asc(c) for c in order]))
    out = keyed_rows.withColumn("__rn", local).join(offsets, [group, "__sec"])
    out = out.withColumn(name, (F.col("__offset") + F.col("__rn")).cast("bigint"))
    for c in first_cols:
        out = out.withColumn(first_prefix + c, F.col("__gfirst")[c])
    return out.drop("__sec", "__rn", "__offset", "__gfirst")
