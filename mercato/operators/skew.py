"""Shuffles by a key that split hot keys (salting bounded to the hot keys only).

AQE splits a skewed sort-merge join only when both inputs are fresh
shuffles.  The fact's tables arrive at their joins already partitioned by
order_id (that is what saves the second shuffle), so hot orders are found
beforehand: a key is *hot* when it holds more than ``rows_per_salt`` rows, the
rows one task should get.  With the threshold never below total / ``max_hot``
at most ``max_hot`` keys qualify, so their list has a proven size bound.  A hot key
of n rows gets ceil(n / threshold) salts: its rows are dealt to them by a hash of the
whole row (equal rows stay together, so duplicates can be dropped inside), and the
other side's rows of that key are repeated once per salt.  Without hot keys
nothing is salted and the plan holds no trace of it.

Rows are first counted per slot (keys dealt to SLOTS slots by hash): a hot key's slot
holds at least its rows, so single keys are counted only in slots above the threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SALT = 2_000_000
MAX_HOT = 10_000
SLOTS = 1 << 14
#: Rows of one shuffle partition that a task sorts and deduplicates in memory.
ROWS_PER_TASK = 1_000_000
SALT = "__salt"


def hot_keys(keys: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT, max_hot: int = MAX_HOT) -> DataFrame:
    """(key, __salts) of the keys that hold more rows of ``keys`` than one task should get:
    a partial aggregate per slot, one scalar total, and a count per key in the large slots."""
    slotted = keys.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("__slot"))
    slots = slotted.groupBy("__slot").agg(F.count(F.lit(1)).alias("__rows"))
    per = F.greatest(F.lit(float(rows_per_salt)), slots.agg(F.sum("__rows")).scalar() / F.lit(float(max_hot)))
    # at most SLOTS rows: a proven size bound
    large = F.broadcast(slots.where(F.col("__rows") > per).select("__slot"))
    counts = slotted.join(large, "__slot", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > per).select(key, F.ceil(F.col("__n") / per).cast("int").alias("__salts"))


def found_hot(hot: DataFrame) -> DataFrame | None:
    """The hot keys as a table of known size, or None if there are none (at most ``max_hot`` rows)."""
    rows = hot.collect()
    return hot.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def partitions(df: DataFrame, rows: int) -> int | None:
    """How many partitions keep ``rows`` rows at ROWS_PER_TASK each; None if the session's number
    is enough (Spark may merge those)."""
    n = math.ceil(rows / ROWS_PER_TASK)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, key: str, hot: DataFrame | None, n: int | None = None) -> DataFrame:
    """``df`` shuffled once by ``key``, a hot key's rows dealt to its salts (column ``__salt``, only if there are any).
    ``n``: a number of partitions other than the session's."""
    many = () if n is None else (n,)
    if hot is None:
        return df.repartition(*many, key)
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    salted = df.join(F.broadcast(hot), key, "left").withColumn(SALT, F.pmod(row, F.coalesce("__salts", F.lit(1))).cast("int"))
    return salted.select(*df.columns, SALT).repartition(*many, key, SALT)


def repeated(df: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``df`` with the rows of a hot key repeated once per salt."""
    if hot is None:
        return df
    each = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    return df.join(F.broadcast(hot), key, "left").select(*df.columns, F.explode(each).alias(SALT))


def join_spread(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """``big``, which ``spread`` has shuffled, left-joined to ``small``."""
    return big.join(repeated(small, key, hot), key if hot is None else [key, SALT], "left")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT,
                     max_hot: int = MAX_HOT) -> DataFrame:
    """``big`` left-joined to ``small`` on ``key``, with hot keys split."""
    hot = found_hot(hot_keys(big.select(key), key, rows_per_salt, max_hot))
    return join_spread(spread(big, key, hot), small, key, hot).drop(SALT)
