"""Table profiles and previews (SRC4-SRC6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.sources.tables import SourceTables


def table_profile(src: SourceTables) -> DataFrame:
    """SRC4: rows and columns per source table; one partial count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
               .select(F.lit(name).alias("table_name"), "row_count",
                       F.lit(len(df.columns)).cast("bigint").alias("column_count"))
             for name, df in src.items()]
    return reduce(DataFrame.unionByName, parts)


def column_profile(src: SourceTables) -> DataFrame:
    """SRC4: type, rows and non-NULL values of every column by its position in the table: one
    aggregate pass per table, then one row per column."""
    parts = []
    for name, df in src.items():
        wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns])
        each = F.array(*[F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                                  F.col("__rows").alias("row_count"), F.col(c).alias("non_null")) for i, (c, t) in enumerate(df.dtypes, 1)])
        parts.append(wide.select(F.lit(name).alias("table_name"), F.inline(each)))
    return reduce(DataFrame.unionByName, parts)


def head(src: SourceTables, n: int = 5) -> dict[str, DataFrame]:
    """SRC4: the first n rows of every table by its columns in order (top-n; there is no file order)."""
    return {name: preview(df, df.columns, n) for name, df in src.items()}


def null_profile(src: SourceTables) -> DataFrame:
    """SRC5: NULL count of every column of every table, long format
    (table_name, column_name, null_count): one aggregate pass per table, then
    ``unpivot`` of its single row."""
    parts = []
    for name, df in src.items():
        wide = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
        long = wide.unpivot([], df.columns, "column_name", "null_count")
        parts.append(long.select(F.lit(name).alias("table_name"), "column_name",
                                 F.coalesce("null_count", F.lit(0)).cast("bigint").alias("null_count")))
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """SRC6: the first n rows by a key order (a top-n, not a full sort)."""
    return df.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).limit(n)
