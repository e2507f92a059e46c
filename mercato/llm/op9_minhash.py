"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Sketching
places the set into BINS bins in rounds: in round i < BINS every element goes to a
hashed bin with the value i + fraction, in round i >= BINS all go to bin i - BINS,
and a bin keeps its minimum.  So every bin is filled after at most 2 BINS rounds,
usually after one, and equal coordinates estimate Jaccard similarity with
Chernoff-type concentration.  Bands of coordinates give candidates; their number and
rows follow from the threshold, so that a pair at it misses all bands with probability
under 1e-5 (16 bands of 4 at 0.85, 21 of 3 at 0.8).

Documents with equal sets form a class, whose smallest doc_id stands for it, so
copies never meet in a bucket.  Candidates are confirmed on full sets, which are
made again for the documents that share a bucket.  Shingles that no other open member
has can't be shared, which bounds a pair's similarity from above; pairs whose bound
misses the threshold are not listed.

Defined results: null text or text without words has the empty set and links
with nothing; fewer than 5 words make one shingle of the whole sequence; rows that
share a doc_id count as one document in linking and each give a row; a null doc_id
links with nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import Memo, likely_in, linked_groups, mix64, shared_buckets, stored

SHINGLE, BINS = 5, 64


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at the threshold misses all bands with probability under 1e-5."""
    miss = {rows: (1 - (percent / 100) ** rows) ** (BINS // rows) for rows in range(1, BINS + 1)}
    rows = max((r for r, p in miss.items() if p < 1e-5), default=1)
    return BINS // rows, rows


def least_agree(percent: int) -> int:
    """Pairs whose sketches agree in fewer coordinates are not verified; a pair at the threshold does so with probability under 1e-7."""
    j, below = percent / 100, 0.0
    for n in range(BINS + 1):
        below += comb(BINS, n) * j ** n * (1 - j) ** (BINS - n)
        if below >= 1e-7:
            return n
    return BINS


def shingles(texts: list[bytes | None], of: Memo) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [(t or b"").lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((of[w] for w in chain.from_iterable(words)), np.uint64, int(n.sum()))
    base = np.uint64(0x9E3779B97F4A7C15)
    roll = h[:max(0, len(h) - SHINGLE + 1)]
    for j in range(1, SHINGLE):
        roll = roll * base + h[j:len(h) - SHINGLE + 1 + j]
    roll = mix64(roll)
    out, at = [], 0
    for k in n:
        if k >= SHINGLE:
            out.append(np.unique(roll[at:at + k - SHINGLE + 1]))
        elif k:
            x = np.array([k], np.uint64)
            for v in h[at:at + k]:
                x = x * base + v
            out.append(mix64(x))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS coordinates per non-empty set: round in the high bits, fraction below."""
    n = np.array([len(s) for s in sets], np.int64)
    elem, doc = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), n)
    full = np.full(len(sets) * BINS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(2 * BINS):
        if not len(elem):
            break
        x = mix64(elem ^ np.uint64((i + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))
        b = (x >> np.uint64(58)).astype(np.int64) if i < BINS else i - BINS
        np.minimum.at(full, doc * BINS + b, (np.uint64(i) << np.uint64(52)) | (x & np.uint64((1 << 52) - 1)))
        todo = (full.reshape(-1, BINS) == np.iinfo(np.uint64).max).any(1)[doc]
        elem, doc = elem[todo], doc[todo]
    return full.reshape(-1, BINS)


def blocks(batches, size: int = 4_000_000):
    """(doc_ids, texts, rows) of a bounded number of bytes, at least one row."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), [x.as_py() for x in b.column("text").cast(pa.binary())]
        lo, total = 0, 0
        for i, t in enumerate(texts):
            total += len(t or b"")
            if total >= size or i == len(texts) - 1:
                yield ids[lo:i + 1], texts[lo:i + 1], b.slice(lo, i + 1 - lo)
                lo, total = i + 1, 0


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (of the row's text: rows may share a doc_id)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    n_bands, n_rows = banding(percent)
    least = least_agree(percent)

    def describe(batches):
        of = Memo(xxhash.xxh64_intdigest)
        for ids, texts, part in blocks(batches):
            sets = shingles(texts, of)
            some = [s for s in sets if len(s)]
            k = sketch(some)
            bands = k[:, :n_bands * n_rows].reshape(len(some), n_bands, n_rows)
            keys = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(some), n_bands))
            for j in range(n_rows):
                keys = mix64((keys * np.uint64(0x100000001B3)) ^ bands[:, :, j])
            keys, low = iter(keys.view(np.int64)), iter(((k ^ (k >> np.uint64(40))) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([next(low) if len(s) else None for s in sets], pa.list_(pa.int32())),
                part.column("text_hash")], ["doc_id", "n_shingles", "set", "keys", "sketch", "text_hash"])

    rows = stored(d.mapInArrow(describe, "doc_id long, n_shingles long, set binary, keys array<long>, sketch array<int>, text_hash long"), "sketches")
    classes = rows.where("set is not null and doc_id is not null").groupBy("set").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    buckets = shared_buckets(classes.select("node", "n", F.explode("keys").alias("key")))
    nodes = buckets.select(F.col("node").alias("doc_id")).distinct()

    def sets_of(batches):
        of = Memo(xxhash.xxh64_intdigest)
        for ids, texts, _ in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                [s.view(np.int64) for s in shingles(texts, of)], pa.list_(pa.int64()))], ["node", "set"])

    # a repeated doc_id with other text gives several sets; each is compared
    sets = stored(likely_in(d.select("doc_id", "text"), "doc_id", nodes).join(nodes, "doc_id").mapInArrow(sets_of, "node long, set array<long>"), "sets")
    # a node with several sets has a null size, and no pair of it is ruled out
    sizes_of = sets.groupBy("node").agg(F.min(F.xxhash64("set")).alias("lo"), F.max(F.xxhash64("set")).alias("hi"), F.max(F.size("set")).alias("size")).where(
        "lo = hi").select("node", "size")
    looks = likely_in(classes, "node", nodes).groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    looks = stored(sizes_of.join(looks, "node"), "looks")

    def verify(pairs: DataFrame) -> DataFrame:
        a_look, b_look = (looks.select(F.col("node").alias(side), F.col("sketch").alias(f"{side}_sketch")) for side in "ab")
        pairs = stored(pairs.join(a_look, "a", "left").join(b_look, "b", "left").where(F.coalesce(agree(), F.lit(True))).select("a", "b"), "pairs")
        # only the sets that these pairs need are shuffled
        a = likely_in(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a", pairs.select("a"))
        b = likely_in(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b", pairs.select("b"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).where(
            F.size("x") > 0).select("a", "b").distinct()

    def sizes() -> Column:
        return 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")

    def agree() -> Column:
        same = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return same >= least

    def payload(members: DataFrame) -> DataFrame:
        """node, sketch, keys, size and shared of ``members``: how many of a node's shingles other members have too.
        A node with several sets gets nulls, and no pair of it is ruled out."""
        mine = likely_in(sets, "node", members).join(members, "node")
        alone = mine.select("node", F.explode("set").alias("e")).groupBy("e").agg(
            F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count("*").alias("alone"))
        return members.join(looks, "node", "left").join(alone, "node", "left").select(
            "node", "sketch", "keys", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))

    def near() -> Column:
        # both can share at most the lesser ``shared``; all else is in the union
        most = F.least("a_shared", "b_shared")
        possible = 100 * most >= percent * (F.col("a_size") + F.col("b_size") - most)
        first = F.get(F.array_intersect("a_keys", "b_keys"), F.lit(0)) == F.col("key")  # a pair is listed in one of its buckets
        return F.coalesce(agree() & possible & first, F.lit(True))

    comps = linked_groups(buckets, verify, sizes, near, payload)
    groups = classes.join(comps, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    return rows.join(groups, "set", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"), "text_hash")
