"""Packing documents into training sequences of power-of-two lengths.

Documents become token ids (byte-level BPE of the given file, then ``END``) and
are routed to tiers by length: those of at least the longest context give whole
windows of that length and a remainder; the others belong to the smallest tier
that holds them.  Each tier is packed into windows of exactly its length; the gap
that a window keeps is filled from the tiers below, longest fitting document
first, and a last gap by cutting one.  Only the end of a task's input can leave
an unfinished window, which is cut into powers of two down to ``MIN_TIER``.
Sequences of equal length are numbered off into step groups of STEP tokens each.

Everything happens in one pass over the rows, in blocks of documents: no row is
shuffled, and a lost task is simply run again on the same rows.

Defined results: null text is empty (one token, END); repeated rows are packed
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LONGEST, MIN_TIER, END = 2048, 64, 1
STEP = 8 * LONGEST
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_length long, step_group long")


class Encoder:
    """Token ids of whole texts by the byte-level BPE of a tokenizers file, then END.

    The file's vocabulary is handed to tiktoken, which gives the same ids four
    times as fast (a token's id is also its merge rank).  Text with a run of over
    RUN characters without, or of, white space goes to tokenizers itself, whose
    merging stays fast on such runs.
    """

    RUN = 4096

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # control strings in a text are ordinary text
        # the file writes each byte as one character: visible ones as themselves, the rest from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*seen}))}
        with open(path) as f:
            spec = json.load(f)
        added = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = re.compile(r"\s{%d}" % self.RUN)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= self.RUN and (max(map(len, text.split()), default=0) >= self.RUN or self.blank.search(text)):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        ids.append(END)
        return np.array(ids, "<u4")


class Packer:
    """Packs blocks of documents; an open window is carried over to the next block."""

    def __init__(self, task: int):
        # a task has less than 2^40 sequences and 2^28 step groups of a size, and numbers stay below 2^63
        self.base, self.step_base, self.n, self.rows, self.left = task << 40, task << 32, 0, [], []
        self.steps: dict[int, int] = {}

    def emit(self, pieces: list, size: int) -> None:
        """One sequence of ``size`` tokens from (doc, ids, start, length) pieces."""
        group = self.steps.get(size, 0)
        self.steps[size] = group + 1
        at = 0
        for doc, ids, start, length in pieces:
            raw = ids[start:start + length].tobytes()
            self.rows.append((doc, start, length, zlib.crc32(raw), len(ids), self.base + self.n, at, size,
                              self.step_base + (group * size // STEP) * 16 + size.bit_length(), raw))
            at += length
        self.n += 1

    def block(self, docs: list) -> None:
        """docs: (doc, ids).  Remainders and short documents, shortest first, fill windows."""
        short = [(len(ids) - s, k, doc, ids, s) for k, (doc, ids, s) in enumerate(self.left)]
        k = len(short)
        for doc, ids in docs:
            whole = len(ids) // LONGEST * LONGEST
            for s in range(0, whole, LONGEST):
                self.emit([(doc, ids, s, LONGEST)], LONGEST)
            if whole < len(ids):
                short.append((len(ids) - whole, k, doc, ids, whole))
                k += 1
        short.sort(key=lambda x: x[:2])
        tier, total = LONGEST, sum(x[0] for x in short)
        while short:
            while tier > MIN_TIER and short[-1][0] <= tier // 2:
                tier //= 2  # all that is left belongs to a shorter tier
            if total < tier:
                break
            n, _, doc, ids, s = short.pop()
            total -= tier
            pieces, gap = [(doc, ids, s, n)], tier - n
            while gap:
                i = bisect_right(short, gap, key=lambda x: x[0])
                if i:  # the longest document that fits
                    n, _, doc, ids, s = short.pop(i - 1)
                    pieces.append((doc, ids, s, n))
                    gap -= n
                else:  # cut the shortest one
                    n, _, doc, ids, s = short.pop(0)
                    pieces.append((doc, ids, s, gap))
                    insort(short, (n - gap, _, doc, ids, s + gap), key=lambda x: x[:2])
                    gap = 0
            self.emit(pieces, tier)
        self.left = [(doc, ids, s) for _, _, doc, ids, s in short]

    def close(self) -> None:
        """Cut what is left into powers of two; less than MIN_TIER tokens are one padded sequence."""
        todo = [(doc, ids, s, len(ids) - s) for doc, ids, s in self.left]
        total = sum(x[3] for x in todo)
        while total:
            size = min(LONGEST, 1 << (total.bit_length() - 1))
            size = size if size >= MIN_TIER else total
            pieces, gap = [], size
            while gap:
                doc, ids, s, n = todo.pop()
                take = min(n, gap)
                pieces.append((doc, ids, s, take))
                gap -= take
                if take < n:
                    todo.append((doc, ids, s + take, n - take))
            self.emit(pieces, size)
            total -= size

    def frame(self, schema: str = SCHEMA) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        rows, self.rows = self.rows, []
        return pd.DataFrame([x[:len(names)] for x in rows], columns=names).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, path: str | None = None, block_docs: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    schema = SCHEMA + ", ids binary" * with_ids

    def run(batches):
        encode, packer = Encoder(path), Packer(TaskContext.get().partitionId())
        for pdf in batches:
            for i in range(0, len(pdf), block_docs):
                part = pdf.iloc[i:i + block_docs]
                texts = [t or "" for t in part["text"]]
                ids = [d if known else None for d, known in zip(part["doc_id"], part["known"])]
                packer.block(list(zip(ids, map(encode, texts))))
                yield packer.frame(schema)
        packer.close()
        yield packer.frame(schema)

    # pandas would make a column of ids with nulls a float one
    i = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(i, F.lit(0)).alias("doc_id"), i.isNotNull().alias("known"), "text").mapInPandas(run, schema)
