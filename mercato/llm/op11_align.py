"""Alignment of two tokenizers' tokens over the same bytes, merged in lockstep.

A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` model; both read
space + text, and a token's bytes end at an offset.  Offsets where an A and a B token
both end link the two and cut the text into groups.

Lockstep: the byte ranges of a block's documents are dealt to lanes of LANE bytes.  One
NumPy vector holds each lane's A and B pointers.  Each step compares the two end
offsets of every lane at once: equal ends give a link and a cut and move both pointers,
else the one that lies behind moves; lanes that are through leave the vector.  A pair of
equal ends lies in one lane, so the lanes of a long document need no word from each other.

Counts of the pairs over the corpus are summed per block, then by Spark.  The HOT
most frequent pairs (a bounded table of 16 bytes each, broadcast) score most links
where they lie; the others are joined with the stored counts by pair, summed by
document within the task first, and added.

Defined results: texts that are null, empty or not given back byte for byte by both
tokenizers have no tokens: zeros and an empty ``groups_sha256``; repeated rows are
worked on each (and counted each); an empty table gives an empty table; other columns
are ignored.  No entry of either vocabulary is empty, so tokens end at rising offsets.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import in_blocks, stored
from mercato.llm.op5_pack import Encoder

LANE, BLOCK, HOT = 1024, 2_000_000, 1 << 17
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIR = 1 << 20  # a pair of ids as one number: A's id times this, plus B's
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def a_bytes(path: str) -> list[bytes]:
    """The bytes of each entry; the file writes a byte as one character: visible ones as themselves, the rest from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
    with open(path) as f:
        spec = json.load(f)
    entries = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    entries |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def b_bytes(model) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


class Aligner:
    """Both tokenizers and their tables; made once in a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        self.a = Encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes = a_bytes(a_path), b_bytes(self.b)
        self.size = [np.array([*map(len, x)], np.int64) for x in self.bytes]
        # decimal ids with the mark that follows, inside a group and at its end
        self.said = [[np.array([f"{i}{m}" for i in range(len(x))], object) for m in marks]
                     for x, marks in zip(self.bytes, (",|", ",;"))]

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text, or None if a tokenizer doesn't give back its bytes."""
        if not text:
            return None
        whole = b" " + text.encode()
        a = self.a(" " + text)[:-1].astype(np.int64)
        b = np.array(self.b.encode(text), np.int64)
        for ids, table in zip((a, b), self.bytes):
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                return None
        return a, b


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For every A token the number of the B token that ends with it, or -1.

    Ends rise over all documents of the block; lane k holds the ends above limits[k] up to limits[k + 1].
    """
    link = np.full(len(ends_a), -1, np.int64)
    cut_a, cut_b = (np.searchsorted(e, limits, "right") for e in (ends_a, ends_b))
    at = np.stack([cut_a[:-1], cut_b[:-1], cut_a[1:], cut_b[1:]])  # pointers and where they stop
    while True:
        at = at[:, (at[0] < at[2]) & (at[1] < at[3])]  # lanes that are through leave
        if not at.shape[1]:
            return link
        i, j = at[0], at[1]
        a, b = ends_a[i], ends_b[j]
        same = a == b
        link[i[same]] = j[same]
        at[0] += a <= b
        at[1] += b <= a


def align(aligner: Aligner, texts: list) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, pairs, times) of every text; ``groups`` is the written form."""
    got = [aligner.ids(t) for t in texts]
    live = [g for g in got if g is not None]
    none = (0, 0, 0, 0, "", [], [])
    if not live:
        return [none] * len(texts)
    ids = [np.concatenate([g[s] for g in live]) for s in (0, 1)]
    ends = [np.cumsum(size[x]) for size, x in zip(aligner.size, ids)]
    first = [np.concatenate([[0], np.cumsum([len(g[s]) for g in live])]) for s in (0, 1)]
    last = np.concatenate([[0], ends[0][first[0][1:] - 1]])  # where documents end
    limits = np.unique(np.concatenate([last, np.arange(0, last[-1], LANE)]))
    link = lockstep(ends[0], ends[1], limits)

    cut_a = np.flatnonzero(link >= 0)
    cut_b = link[cut_a]
    # the written form puts a group's B tokens behind its A tokens
    group = [np.searchsorted(cut, np.arange(len(x))) for cut, x in zip((cut_a, cut_b), ids)]
    before_b = np.concatenate([[0], cut_b + 1])  # B tokens before each group
    place = [np.arange(len(ids[0])) + before_b[group[0]], np.arange(len(ids[1])) + (cut_a + 1)[group[1]]]
    words = np.empty(len(ids[0]) + len(ids[1]), object)
    for s, cut in ((0, cut_a), (1, cut_b)):
        inner, end = aligner.said[s]
        words[place[s]] = inner[ids[s]]
        words[place[s][cut]] = end[ids[s][cut]]
    pair = ids[0][cut_a] * PAIR + ids[1][cut_b]
    links = np.searchsorted(cut_a, first[0])
    out, k = [], 0
    for g in got:
        if g is None:
            out.append(none)
            continue
        lo, hi = links[k], links[k + 1]
        a, b = first[0][k], first[1][k]
        text = "".join(words[a + b:first[0][k + 1] + first[1][k + 1]].tolist())[:-1]
        pairs, times = np.unique(pair[lo:hi], return_counts=True)
        out.append((len(g[0]), len(g[1]), hi - lo, hi - lo, text, pairs, times.astype(np.int32)))
        k += 1
    return out


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """ALIGNED: one row per document, its distinct linked id pairs with how often each is linked."""
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        aligner = None
        for b in in_blocks(batches, size=BLOCK):
            aligner = aligner or Aligner(a_path, b_path)
            got = align(aligner, b.column("text").to_pylist())
            n = [pa.array([int(g[k]) for g in got], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(g[4].encode()).hexdigest() if g[0] else "" for g in got], pa.string())
            offsets = pa.array(np.cumsum([0, *(len(g[5]) for g in got)]), pa.int32())
            pairs, times = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(g[k], t) for g in got]), type=kind))
                            for k, t, kind in ((5, np.int64, pa.int64()), (6, np.int32, pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, sha, pairs, times],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return d.mapInArrow(run, ALIGNED)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair over the corpus; best: no pair with its B id has more."""
    def partial(batches):
        for b in batches:
            pairs, at = np.unique(b.column("pairs").flatten().to_numpy(), return_inverse=True)
            n = np.bincount(at, b.column("times").flatten().to_numpy(), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n)], ["pair", "n"])

    n = stored(table.select("pairs", "times").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = (F.col("pair") % PAIR).alias("b")
    most = n.groupBy(b).agg(F.max("n").alias("most"))
    return stored(n.select("*", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def alignment(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document with its token, group and link counts and how its links rank in the corpus."""
    table = stored(aligned(docs), "aligned")
    counts = pair_counts(table)
    top = counts.orderBy(F.col("n").desc(), "pair").limit(hot).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast((
        top.column("pair").to_numpy()[order], top.column("n").to_numpy()[order], top.column("best").to_pandas().to_numpy(bool)[order]))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def score(batches):
        pairs, n, best = known.value
        for b in batches:
            lists = b.column("pairs")
            x, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pairs, x), max(len(pairs) - 1, 0))
            hit = pairs[at] == x if len(pairs) else np.zeros(len(x), bool)
            # sums of whole numbers, exact below 2^63
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, doc[hit], times[hit] * best[at[hit]])
            np.add.at(total, doc[hit], times[hit] * n[at[hit]])
            rest = np.bincount(doc[~hit], minlength=b.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            rare = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit])) for v in (x, times)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ["row", *keep]] + [pa.array(n_best), pa.array(total), *rare],
                                             ["row", *keep, "n_best", "count_sum", "rare", "times"])

    schema = ", ".join(["row long", ALIGNED.split(", pairs")[0], "n_best long", "count_sum long, rare array<long>, times array<long>"])
    # the row number is made and stored in one step, so later reads agree on it
    scored = stored(table.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, schema), "scored")
    each = scored.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.select("row", *keep, "n_best", "count_sum").join(more, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                      (F.col("n_best") + F.coalesce("more_best", F.lit(0))).cast("long").alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256")


def links_table(docs: DataFrame) -> DataFrame:
    """(doc_id, at, a_id, b_id): every link of the texts by the byte offset where both tokens end, space + text from 0."""
    a_path, b_path = public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)

    def run(batches):
        aligner = Aligner(a_path, b_path)
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                got = aligner.ids(t)
                if got is not None:
                    ends = [np.cumsum(size[x]) for size, x in zip(aligner.size, got)]
                    link = lockstep(*ends, np.unique(np.append(np.arange(0, ends[0][-1], LANE), ends[0][-1])))
                    rows += [(i, int(ends[0][k]), int(got[0][k]), int(got[1][link[k]])) for k in np.flatnonzero(link >= 0)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "a_id", "b_id"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, at long, a_id long, b_id long")
