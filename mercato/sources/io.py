"""Readers, writers and materialisation (SRC1-SRC3, SNK1-SNK6).

The URI scheme of a path picks the store (``file:``, ``hdfs:``, ``s3a:``,
``gs:``); the calls are the same for all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources.ingest import Ingest, ingest_csv, strict_csv
from mercato.sources.tables import SourceTables

TABLE_NAMES = ("customers", "orders", "order_items", "payments", "reviews", "products", "sellers", "geolocation")
OPEN_FILES, OPEN_MONTHS = "spark.sql.maxConcurrentOutputFileWriters", 120


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """SRC1: a CSV file's columns found by their header names, in any order and
    beside others.  Ids stay text (CLN7); other values are cast to the declared
    types, and a record or value that doesn't fit stops the job with its text
    instead of becoming NULL (``ingest_csv`` sets such records apart instead).
    Tie-breakers that no file has are hashes of the row's own columns."""
    return strict_csv(spark, path, table)


def read_csv_tables(spark: SparkSession, paths: dict[str, str]) -> SourceTables:
    """SRC1 for all source tables: ``paths`` maps table name -> CSV path."""
    tables = {t: read_csv_table(spark, paths[t], t) for t in TABLE_NAMES if t in paths or t != "geolocation"}
    tr = paths.get("category_translation")
    return SourceTables(**tables, category_translation=read_csv_table(spark, tr, "category_translation")
                        if tr else None)


def ingest_csv_tables(spark: SparkSession, paths: dict[str, str]) -> tuple[SourceTables, DataFrame]:
    """SRC1 with rejects: all source tables without the records that don't fit, and those records
    (table, file, line, column, text, reason)."""
    got: dict[str, Ingest] = {t: ingest_csv(spark, p, t) for t, p in paths.items()}
    rejects = reduce(DataFrame.union, [x.rejects.select(F.lit(t).alias("table"), "*") for t, x in got.items()])
    return SourceTables(**{t: x.rows for t, x in got.items()}), rejects


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC2."""
    return spark.read.parquet(path)


def write_fact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: the fact as Parquet partitioned by purchase month, so a date
    range filter (which adds month bounds) prunes whole directories.

    Each task writes its own rows of every month, so the wide rows are not
    shuffled again and no month - however hot - lands in a single task; the
    tasks are those of the fact's join by order (``skew.ROWS_PER_TASK`` rows
    each), and their number bounds the files of a month.  A task keeps the
    files of up to OPEN_MONTHS months open at once; the rows of further ones
    are sorted by month first."""
    conf = df.sparkSession.conf
    before = conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, str(OPEN_MONTHS))
    try:
        df.write.mode(mode).partitionBy("purchase_month").parquet(path)
    finally:
        conf.set(OPEN_FILES, before)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2 / SNK4: CSV with a header, written in parallel (one file per task)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK3: publish a result; the destination URI selects the store."""
    df.write.mode(mode).parquet(path)


def path_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write (its _SUCCESS marker) exists at ``path``."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def materialize(spark: SparkSession, path: str, builder: Callable[[], DataFrame],
                writer: Callable[[DataFrame, str], None] = write_parquet, overwrite: bool = False,
                sources: Sequence[str] | None = None, key: str = "") -> DataFrame:
    """SNK5: read the stored result, or build, store and read it back.

    With ``sources`` (files or folders) the result is rebuilt when one of them has changed
    (``sources.stored``); without, a complete result is reused whatever its sources became.
    A half-written directory has no _SUCCESS marker and is rebuilt.  Reading
    back (rather than returning the built plan) cuts the lineage, so later
    jobs start from files on the shared store and survive lost executors.
    """
    if sources is not None:
        from mercato.sources.stored import file_state, keyed
        # a new key rebuilds
        return keyed(spark, path, builder, lambda: file_state(spark, sources),
                     key + f";{uuid.uuid4().hex}" * overwrite, writer)
    if overwrite or not path_complete(spark, path):
        writer(builder(), path)
    return spark.read.parquet(path)
