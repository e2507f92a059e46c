"""Semantic rules that a naive translation gets wrong.

Every helper returns a built-in Column expression, so it stays inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "day_diff", "hours", "nz_sum", "share_true", "ne_or_true", "exact_mean",
    "money", "as_double", "bin_index", "bin_counts", "half_even_pct",
    "quarter_label", "keyed", "DAY_US",
]

DAY_US = 86_400_000_000.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(end, start) -> Column:
    """Whole days from ``start`` to ``end``, floored (T1: -12 h -> -1, +12 h -> 0).

    ``datediff`` counts midnights and ``timestampdiff(DAY)`` truncates toward
    zero; both differ from a floored timedelta.  Works on timestamp_ntz.
    """
    return F.floor(F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(DAY_US))


def hours(n) -> Column:
    """A day-time interval of ``n`` hours."""
    return F.make_dt_interval(F.lit(0), _c(n).cast("int"), F.lit(0), F.lit(0))


def nz_sum(c) -> Column:
    """Sum whose all-null (or empty) group is 0, not NULL (T4)."""
    return F.coalesce(F.sum(_c(c)), F.lit(0))


def share_true(cond: Column) -> Column:
    """Mean of a boolean mask; NULL comparisons count as False and stay in the
    denominator (T3)."""
    return F.avg(F.when(cond, 1).otherwise(0))


def ne_or_true(a, b) -> Column:
    """``a != b`` where a NULL side compares as different."""
    return F.coalesce(_c(a) != _c(b), F.lit(True))


def as_double(c) -> Column:
    return _c(c).cast("double")


def money(c) -> Column:
    """Money leaves the engine as double; inside it stays decimal."""
    return _c(c).cast("double")


def exact_mean(c) -> Column:
    """Mean of a decimal column: exact decimal sum / count, then one double
    division (order-independent, T11)."""
    return F.try_divide(F.sum(_c(c)).cast("double"), F.count(_c(c)).cast("double"))


def bin_index(c, edges: Sequence[float]) -> Column:
    """Index of the half-open bin ``(edges[i], edges[i+1]]`` holding ``c``;
    NULL when out of range or NULL (pd.cut semantics, T2)."""
    col = _c(c)
    expr = None
    for i in range(len(edges) - 1):
        cond = (col > F.lit(edges[i])) & (col <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def bin_counts(df: DataFrame, c, edges: Sequence[float], labels: Sequence[str],
               label_col: str, count_col: str) -> DataFrame:
    """Counts per fixed bin, with empty bins present as 0.

    The rows are reduced to one count per bin with a partial aggregate; the
    bins dimension (len(labels) rows, a fixed size) is broadcast and left-joined.
    """
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)],
                                "bin_id int, " + label_col + " string")
    counts = (df.select(bin_index(c, edges).alias("bin_id"))
                .where(F.col("bin_id").isNotNull())
                .groupBy("bin_id").agg(F.count(F.lit(1)).alias(count_col)))
    return (F.broadcast(dim).join(counts, "bin_id", "left")
            .select("bin_id", label_col,
                    F.coalesce(F.col(count_col), F.lit(0)).cast("bigint").alias(count_col)))


def half_even_pct(part, total, digits: int = 2) -> Column:
    """``round(part / total * 100, digits)`` with half-to-even rounding (T12),
    computed in exact integer arithmetic so no float rounding leaks in."""
    num = _c(part).cast("bigint") * F.lit(10 ** (digits + 2))
    den = _c(total).cast("bigint")
    r = F.pmod(num, den)
    q = ((num - r).cast("decimal(38,0)") / den.cast("decimal(38,0)")).cast("bigint")
    up = (F.lit(2) * r > den) | ((F.lit(2) * r == den) & (F.pmod(q, F.lit(2)) == 1))
    rounded = q + F.when(up, 1).otherwise(0)
    return F.when(den > 0, rounded.cast("double") / F.lit(float(10 ** digits)))


def quarter_label(ts) -> Column:
    """Month -> quarter label (P12), a when chain over F.quarter, no UDF."""
    q = F.quarter(_c(ts))
    # The four quarter labels shown by the studied dashboard.
    return (F.when(q == 1, "Q1 (Jan-Mar)").when(q == 2, "Q2 (Apr-Jun)")
             .when(q == 3, "Q3 (Jul-Sep)").otherwise("Q4 (Oct-Dec)"))


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows with a NULL grouping key: pandas ``groupby`` does (T5)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond)
