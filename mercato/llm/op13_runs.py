"""Periodic runs of words, found online by dyadic square catching.

A run is a stretch of words with smallest period q, of at least max(LEAST, 2 q) words,
that no neighbouring word extends.  Words are appended to a stream; each power of two
L cuts it into blocks of L words.  A completed block is a catcher: every appended word
ends a suffix of L words, which is compared with the catchers that lie one of their
periods back.  Stretches with period p repeat at least max(p, LEAST - p) words p
further on, and a stretch of 2 L - 1 words holds a whole block of L, so the catchers of
the largest such L see every period p, and each suffix meets a bounded number of
catchers of each size.  A caught square is extended to the left, and to the right up to
the words appended so far; one that reaches the end stays open and grows with the next
words.  Stretches with equal ends have periods that are multiples of the smallest
(Fine and Wilf), so they merge into the run of that one.

Comparisons look at 64-bit hashes of 2^k words, made by doubling; every run is compared
word for word before it is reported, and the stream is read again with other hashes if
one differs.  The streams of a task hold the documents of a block of about BLOCK bytes,
dealt by the bit length of their word counts and set apart by words that occur once.
Memory grows with the longest document: 8 bytes for each word and bit of its length.

Defined results: null text has no words; without words or runs the counts are 0, the four
columns of the greatest run null and the digests those of empty text or of all words; a
null doc_id counts as empty text in its crc32; repeated rows are worked on each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import in_blocks, mix64

LEAST, BLOCK, SLAB = 12, 2_000_000, 1 << 16
SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def bands(most: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(k, p0, p1): blocks of 2^k words catch the periods p0 to p1; all of 1 to ``most``."""
    out: list[tuple[int, int, int]] = []
    p = 1
    while p <= most:
        k = ((max(p, least - p) + 1) // 2).bit_length() - 1
        last = p if p < least else (4 << k) - 2
        if out and out[-1][0] == k and out[-1][2] == p - 1:
            out[-1] = (k, out[-1][1], last)
        else:
            out.append((k, p, last))
        p = last + 1
    return [(k, a, min(b, most)) for k, a, b in out]


class Catchers:
    """Online detector of the runs of a stream of word numbers.

    ``longest`` bounds the words between two words that occur once; runs lie between them.
    """

    def __init__(self, longest: int, least: int = LEAST, seed: int = 0):
        self.least, self.n, self.seed = least, 0, np.uint64(seed * 2 + 1)
        self.levels = max(1, int(longest).bit_length())
        self.bands = bands(longest // 2, least)
        self.words = np.zeros(0, np.int64)
        self.hash = np.zeros((self.levels, 0), np.uint64)
        self.open: dict[int, int] = {}  # period -> start of the stretch that reaches the last word
        self.closed = [np.zeros((0, 3), np.int64)]

    def append(self, words: np.ndarray) -> None:
        """Read more words, one or many; the result doesn't depend on how they are cut."""
        old, self.n = self.n, self.n + len(words)
        self._hash(old, words)
        if self.open:  # advance the open squares
            p, s = np.array([*self.open.items()], np.int64).T
            self._keep(s, p, old)
        for k, p0, p1 in self.bands:
            b, p = self._catch(old, k, p0, p1)
            if len(b):
                if self.open:
                    start = np.full(p1 + 1, self.n, np.int64)
                    for q, s in self.open.items():
                        if q <= p1:
                            start[q] = s
                    new = start[p] > b  # the others lie in an open stretch of their period
                    b, p = b[new], p[new]
                self._keep(b - self._common(b, p, -1), p, b + p)

    def _hash(self, old: int, words: np.ndarray) -> None:
        room = self.n + (4 << self.levels)
        if room > self.hash.shape[1]:
            wide = np.zeros((self.levels, 2 * room), np.uint64)
            wide[:, :old] = self.hash[:, :old]
            self.hash, self.words = wide, np.concatenate([self.words[:old], np.zeros(2 * room - old, np.int64)])
        self.words[old:self.n] = words
        self.hash[0, old:self.n] = mix64(words.astype(np.uint64) * np.uint64(2) + self.seed)
        for k in range(1, self.levels):
            half = 1 << k - 1
            lo, hi = max(0, old - 2 * half + 1), self.n - 2 * half + 1
            if hi <= lo:
                break
            x = self.hash[k - 1, lo:hi] * np.uint64(0x9E3779B97F4A7C15)
            x += self.hash[k - 1, lo + half:hi + half]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            self.hash[k, lo:hi] = x

    def _catch(self, old: int, k: int, p0: int, p1: int) -> tuple[np.ndarray, np.ndarray]:
        """(block start, period) where a suffix that ends in a new word equals a block."""
        size, none = 1 << k, np.zeros(0, np.int64)
        lo, hi = max(0, old - size + 1), self.n - size + 1  # starts of the suffixes
        j0, j1 = max(0, -((p1 - lo) // size)), -((p0 - hi) // size)
        if j1 <= j0 or hi <= lo:
            return none, none
        h = self.hash[k]
        back = np.lib.stride_tricks.as_strided(h[j0 * size + p0:], (j1 - j0, p1 - p0 + 1), (8 * size, 8))
        same = back == h[j0 * size:j1 * size:size, None]
        first = same.copy()
        first[1:] &= ~same[:-1]  # the block before has caught the others
        j, d = np.divmod(np.flatnonzero(first), p1 - p0 + 1)
        b, p = (j + j0) * size, d + p0
        new = (b + p >= lo) & (b + p < hi)
        return b[new], p[new]

    def _common(self, at: np.ndarray, p: np.ndarray, way: int) -> np.ndarray:
        """Words that agree with those p further on, from ``at`` to the right or, with way -1, left of it."""
        got = np.zeros(len(at), np.int64)
        for k in range(self.levels - 1, -1, -1):
            size = 1 << k
            x = at + got if way > 0 else at - got - size
            ok = (x + p + size <= self.n) & (x >= 0)
            x = np.where(ok, x, 0)
            got += np.where(ok & (self.hash[k, x] == self.hash[k, np.where(ok, x + p, 0)]), size, 0)
        return got

    def _keep(self, start: np.ndarray, p: np.ndarray, known: np.ndarray | int) -> None:
        """File stretches known to go on until ``known``: open, or closed if they are long enough."""
        if not len(start):
            return
        at = np.maximum(known - p, start)
        end = at + self._common(at, p, 1) + p
        got = np.unique(np.stack([start, end, p], 1), axis=0)
        live = got[:, 1] == self.n
        for q in p.tolist():
            self.open.pop(q, None)
        self.open.update((q, s) for s, _, q in got[live].tolist())
        done = got[~live]
        self.closed.append(done[done[:, 1] - done[:, 0] >= np.maximum(self.least, 2 * done[:, 2])])

    def runs(self) -> np.ndarray:
        """(start, end, period) rows of the words read so far, by start, then period."""
        live = np.array([(s, self.n, q) for q, s in self.open.items() if self.n - s >= max(self.least, 2 * q)], np.int64).reshape(-1, 3)
        got = np.concatenate([*self.closed, live])
        got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
        # of stretches with equal ends the smallest period
        new = np.ones(len(got), bool)
        new[1:] = (got[1:, :2] != got[:-1, :2]).any(1)
        got = got[new]
        return got[np.lexsort((got[:, 2], got[:, 0]))]

    def exact(self, runs: np.ndarray) -> bool:
        return all(np.array_equal(self.words[s:e - q], self.words[s + q:e]) for s, e, q in runs.tolist())


def find_runs(words: np.ndarray, longest: int, least: int = LEAST, slab: int = SLAB) -> np.ndarray:
    """Runs of a whole stream, each compared word for word."""
    seed = 0
    while True:
        c = Catchers(longest, least, seed)
        for i in range(0, len(words), slab):
            c.append(words[i:i + slab])
        runs = c.runs()
        if c.exact(runs):
            return runs
        seed += 1


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The word numbers of a tenth of the documents, whose tail is made periodic; None for the others."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _block(ids: list, texts: list) -> list[list]:
    """The columns of SCHEMA for a block of documents; texts in UTF-8 bytes."""
    split = [(t or b"").split() for t in texts]  # bytes are split at \x20 and \x09 to \x0D
    number: dict[bytes, int] = {}
    for k, (i, w) in enumerate(zip(ids, split)):
        order = planted(len(w), i)
        if order is not None:
            split[k] = [w[x] for x in order.tolist()]
        for x in w:
            number.setdefault(x, len(number))
    found: list = [None] * len(split)
    gone: list = [None] * len(split)
    streams: dict[int, list[int]] = {}
    for k, w in enumerate(split):
        if len(w) >= LEAST:
            streams.setdefault(len(w).bit_length(), []).append(k)
    for members in streams.values():
        size = np.array([len(split[k]) + 1 for k in members])
        first = np.cumsum(size) - size
        stream = np.full(size.sum(), -1, np.int64)
        for at, k in zip(first.tolist(), members):
            stream[at:at + len(split[k])] = np.fromiter(map(number.__getitem__, split[k]), np.int64, len(split[k]))
            stream[at + len(split[k])] = len(number) + k  # occurs once
        runs = find_runs(stream, int(size.max()) - 1)
        if not len(runs):
            continue
        drop = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(stream) + 1) - np.bincount(runs[:, 1], minlength=len(stream) + 1)
        drop = np.cumsum(drop) > 0
        of = np.searchsorted(first, runs[:, 0], "right") - 1
        cut = np.flatnonzero(np.diff(of)) + 1
        for part in np.split(np.arange(len(runs)), cut):
            m = int(of[part[0]])
            k, at = members[m], int(first[m])
            found[k] = runs[part] - np.array([at, at, 0])
            gone[k] = drop[at:at + len(split[k])]
    out: list[list] = []
    for i, w, runs, drop in zip(ids, split, found, gone):
        if runs is None:
            out.append([i, 0, None, None, None, None, _digest(b""), _digest(b" ".join(w))])
            continue
        rows = [(s, e - s, q) for s, e, q in runs.tolist()]
        s, n, q = min(rows, key=lambda r: (-r[1], r[0], r[2]))
        text = b"".join(b"%d,%d,%d\n" % r for r in rows)
        out.append([i, len(rows), s, n, q, 1000 * n // q, _digest(text), _digest(b" ".join(compress(w, (~drop).tolist())))])
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its runs and the digest of its text with each run's repeats taken out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for b in in_blocks(batches, size=BLOCK):
            rows = _block(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return d.mapInArrow(run, SCHEMA)


def runs_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period, repeated): every run of the texts as they are, with one period of its words."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def run(batches):
        names = ["doc_id", "start", "length", "period", "repeated"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        for b in in_blocks(batches, size=BLOCK):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                w = (t or b"").split()
                number = {x: k for k, x in enumerate(dict.fromkeys(w))}
                codes = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
                rows += [(i, s, e - s, q, b" ".join(w[s:s + q]).decode()) for s, e, q in find_runs(codes, len(w)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)

    return d.mapInArrow(run, "doc_id long, start long, length long, period long, repeated string")
