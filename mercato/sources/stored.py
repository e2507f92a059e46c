"""Stored results that know their sources (SRC3, SNK5).

A result lives under ``path``: its data in a folder of its own for each build, and
beside it a manifest, one row per source file with name, size and modification
time, plus the result's definition (``key``) and the folder that holds the data.  The
manifest is written last, so a build that was cut short leaves none, and a result is
reused only if definition and files are those of now.  The state of the files is taken
before a build: a file that changes meanwhile shows at the next call.

A changed source gets a new data folder; readers of the old one go on undisturbed.
``drop_old`` removes folders that no manifest names; whoever owns the store calls it
when nothing reads them any more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources.io import path_complete, write_parquet


def file_state(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, bytes, modified) of the files at or below ``paths``: a listing, no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _print_of(state: DataFrame) -> tuple:
    """Count, bytes and an order-free sum of hashes: equal for equal states."""
    got = state.agg(F.count("*"), F.sum("bytes"), F.sum(F.xxhash64("file", "bytes", "modified").cast("decimal(20,0)"))).first()
    return tuple(got)


def keyed(spark: SparkSession, path: str, build: Callable[[], DataFrame], state: Callable[[], DataFrame], key: str = "",
          writer: Callable[[DataFrame, str], None] = write_parquet) -> DataFrame:
    """The stored result at ``path`` if its sources and ``key`` are unchanged, else built, stored and read back."""
    return spark.read.parquet(keyed_folder(spark, path, lambda folder: writer(build(), folder), state, key))


def keyed_folder(spark: SparkSession, path: str, make: Callable[[str], None], state: Callable[[], DataFrame], key: str = "") -> str:
    """As ``keyed`` for results of several tables: ``make`` writes them below the folder it is given; returns that folder."""
    path = path.rstrip("/")
    now = state()
    want = _print_of(now)
    manifest = f"{path}/manifest"
    if path_complete(spark, manifest):
        old = spark.read.parquet(manifest)
        head = old.select("key", "folder").first()
        if head is not None and head["key"] == key and _print_of(old) == want:
            return f"{path}/{head['folder']}"
    folder = f"v-{uuid.uuid4().hex}"
    # the listing as it was before the build
    rows = now.withColumn("key", F.lit(key)).withColumn("folder", F.lit(folder))
    rows.write.parquet(f"{path}/{folder}-sources")
    make(f"{path}/{folder}")
    spark.read.parquet(f"{path}/{folder}-sources").write.mode("overwrite").parquet(manifest)
    return f"{path}/{folder}"


def drop_old(spark: SparkSession, path: str) -> int:
    """Remove the data folders at ``path`` that its manifest doesn't name; returns how many."""
    path = path.rstrip("/")
    if not path_complete(spark, f"{path}/manifest"):
        return 0
    live = spark.read.parquet(f"{path}/manifest").select("folder").first()["folder"]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in ("manifest", live, f"{live}-sources")]
    for p in gone:
        fs.delete(p, True)
    return sum(not p.getName().endswith("-sources") for p in gone)
