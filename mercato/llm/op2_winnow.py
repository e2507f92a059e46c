"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are words ``[^\\x20\\x09-\\x0D]+``, cut into pieces of at most 32 characters
so that text without spaces has several.  Every run of K tokens gets a rolling
polynomial hash modulo 2^31 - 1, and every window of W such hashes selects its
minimum, the rightmost one on ties.  Selected (hash, position) pairs are the
fingerprint, so two texts that share K + W - 1 tokens in a row share a pair's
hash.  A text with fewer than K tokens has one gram of all its tokens; one with
fewer than W grams has one window.

Defined results: null text is empty and has the empty fingerprint; likeness is
the Jaccard coefficient of the distinct hashes, 1 for two empty fingerprints.
Rows that repeat a doc_id follow each other, ordered by text; a null doc_id
sorts after all others; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import stored

K, W, PIECE = 5, 8, 32
PRIME, BASE = 2_147_483_647, 1_000_003
FINE = 4096


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]{1,%d}" % PIECE), F.lit(0))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<long> of hash * 2^32 + position, in text order."""
    n = F.size("__h")
    df = df.withColumn("__h", F.transform(_tokens(F.col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME))))

    def gram(i, k=K):
        h = F.get("__h", i)
        for j in range(1, k):
            h = (h * BASE + F.get("__h", i + j)) % PRIME
        return h

    # the position counts down below the hash, so that a minimum is rightmost on ties
    low = F.lit(2**32 - 1)
    short = F.aggregate("__h", F.lit(0).cast("long"), lambda a, x: (a * BASE + x + 1) % PRIME)
    df = df.withColumn("__m", F.when(n >= K, F.transform(
        F.sequence(F.lit(0), n - K), lambda i: gram(i) * F.lit(2**32) + (low - i))).when(
        n > 0, F.array(short * F.lit(2**32) + low)).otherwise(F.array().cast("array<long>")))
    def wider(half):
        return F.transform("__m", lambda x, i: F.least(x, F.get("__m", i + half)))

    for half in (1, 2, 4):  # minima of 2, 4, 8 grams from minima of half as many
        df = df.withColumn("__m", wider(half))
    # windows that would reach over the end only repeat the last whole window's choice or lie right of it
    whole = F.slice("__m", 1, F.greatest(F.size("__m") - (W - 1), F.lit(1)))
    picked = F.transform(F.array_distinct(whole), lambda x: (x - x % F.lit(2**32)) + (low - x % F.lit(2**32)))
    return df.withColumn(out, picked).drop("__h", "__m")


def hashes(fp: str | Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def as_text(fp: str) -> Column:
    """``hash@position`` pairs in text order, hashes in hex."""
    return F.array_join(F.transform(fp, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"), (x % F.lit(2**32)).cast("string"))), " ")


def followed(docs: DataFrame, slice_rows: int = 5000) -> DataFrame:
    """doc_id, text and ``next``: the text of the next document in descending
    doc_id, the first one's for the last.

    The id range is cut into FINE buckets whose counts (at most FINE + 1 rows)
    give slices of about ``slice_rows`` rows; a window runs inside each slice, and
    only the last row of a slice takes its successor from the table of first rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lo, hi = d.agg(F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = lo or 0, hi or 0
    fine = F.coalesce(F.floor((F.lit(hi) - F.col("doc_id")) / F.lit(float(hi - lo + 1)) * FINE), F.lit(FINE)).cast("int")
    counts = d.groupBy(fine.alias("fine")).agg(F.count("*").alias("n"))
    cum = F.sum("n").over(Window.orderBy("fine")) - F.col("n")
    slices = stored(counts.select("fine", F.floor(cum / slice_rows).cast("int").alias("slice")), "slices")
    d = d.withColumn("fine", fine).join(F.broadcast(slices), "fine").drop("fine")  # FINE + 1 rows at most
    # one row per slice: its first document, filed at the end of the slice before it
    after = slices.select("slice").distinct()
    after = after.select(F.col("slice").alias("before"), F.coalesce(
        F.lead("slice").over(Window.orderBy("slice")), F.lit(0)).alias("slice"))
    tops = d.groupBy("slice").agg(F.max("doc_id").alias("top"))
    heads = d.join(tops, "slice").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("slice").agg(F.min("text").alias("text"))
    heads = heads.join(after, "slice").select(F.col("before").alias("slice"), F.lit(None).cast("long").alias("doc_id"),
                                              "text", F.lit(True).alias("head"))
    w = Window.partitionBy("slice").orderBy("head", F.col("doc_id").desc_nulls_last(), "text")
    rows = d.select("slice", "doc_id", "text", F.lit(False).alias("head")).union(heads)
    return rows.withColumn("next", F.lead("text").over(w)).where("not head").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, likenesses."""
    d = followed(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half),
                                        F.substring("next", F.lit(1), half)))
    d = with_fingerprint(with_fingerprint(with_fingerprint(d, "text", "fp"), "edited", "fe"), "next", "fn")
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                 as_text("fp").alias("fingerprint"), as_text("fe").alias("edited_fingerprint"),
                 hashes("fp").alias("a"), hashes("fe").alias("b"), hashes("fn").alias("c"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
