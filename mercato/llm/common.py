"""Helpers shared by the operators: stored tables, hashes, components, links."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import checkpoint_root


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written.  Spark then removes a query's shuffle files when the query ends, not when the driver next
#: collects its garbage, and the driver keeps the start of each plan's description only (tables of literals are long).
WRITING = {CLEANUP: "true", "spark.sql.maxPlanStringLength": "200000"}


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the session's shared folder and read it back:
    lineage ends there, so a lost executor costs no earlier stage, and the shuffle files of the write go."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


SLOT_BITS = 26


def slot_of(x: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(13), F.col(x)), 64 - SLOT_BITS)


def likely_in(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose long ``column`` is not in the one column of ``members``, and without nulls.

    The members' hashed slots travel as a bitmap (8 MB of bits at any size of the corpus), so that a join
    which follows shuffles the rows it needs; rows that share a slot with a member stay, and that join drops them."""
    m = members.toDF("m").where("m is not null").select(slot_of("m").alias("s"))
    bits = m.groupBy(F.bitmap_bucket_number("s").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__bits"))
    at = F.bitmap_bit_position(slot_of(column))
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = df.join(F.broadcast(bits), F.bitmap_bucket_number(slot_of(column)) == F.col("__bucket")).where(
        F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found.select(*df.columns)


def in_blocks(batches, column: str = "text", size: int = 4_000_000):
    """Record batches cut into slices of about ``size`` bytes of ``column``, at least one row each."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0)
        block = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            if lo < hi:
                yield b.slice(lo, hi - lo)


def fold(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Memo(dict):
    """A dict that computes missing values and is emptied when it reaches its bound."""

    def __init__(self, fn: Callable, bound: int = 400_000):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node in them.

    Alternating large-star and small-star steps.  Each step is a grouped minimum
    (partial aggregation) and a join on the node that AQE may split, so a node
    with very many neighbours stays spread; the table is stored after each
    round and the loop ends when a round changes nothing.
    """
    def smaller_first(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003),
                      F.sum(F.xxhash64("b", "a") % 999_983)).first()

    e = stored(smaller_first(edges.where("a <> b")), "edges")
    before = state(e)
    while before[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, large.a == low.n).select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = stored(smaller_first(small.where("a <> b")), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """The distinct (key, node, ...) rows whose key has at least two of them, stored."""
    buckets = buckets.distinct()
    several = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stored(buckets.join(several, "key"), "buckets")


def linked_groups(buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], quick: Callable[[], Column],
                  near: Callable[[], Column] | None = None, payload: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 2) -> DataFrame:
    """Components of the links that ``verify`` confirms among nodes sharing a bucket.

    ``buckets``: stored, distinct (key, node, ...).  ``verify`` takes pairs (a, b) and
    keeps the linked ones; ``quick`` rules out hopeless pairs by the other bucket
    columns, named a_* and b_*.  A bucket of m near copies is not expanded to all
    pairs: first its members meet one pivot each round (m pairs), and then only
    pairs of nodes still in different components are listed, which keeps every
    link that can still join two components.  ``payload`` describes the nodes of that
    last list (one row for each), and ``near`` on its columns rules out more pairs.
    """
    spark = buckets.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "node long, component long")

    def side(df, name):
        return df.select("key", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "key"])

    for r in range(rounds + 1):
        now = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        if r:
            split = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            now = now.join(split, "key")
        met = quick() & (F.col("a_comp") != F.col("b_comp"))
        if r < rounds:
            order = F.col("node") if r == 0 else F.xxhash64("node", F.lit(r))
            pivots = now.groupBy("key").agg(F.min_by(F.struct(*now.drop("key").columns), F.struct(order, "node")).alias("p")).select("key", "p.*")
            pairs = side(now, "a").join(side(pivots, "b"), "key").where(met)
        else:
            now = stored(now, "open", compression="zstd")
            if payload is not None:
                now = stored(now.join(payload(now.select("node").distinct()), "node"), "payload")
            cond = met & near() if near else met
            pairs = side(now, "a").join(side(now, "b"), "key").where(cond & (F.col("a_node") < F.col("b_node")))
        pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        found = stored(verify(pairs).select("a", "b"), "links")
        if r == rounds and found.isEmpty():
            break
        edges = edges.union(found)
        comps = stored(components(edges), "components")
    return comps
