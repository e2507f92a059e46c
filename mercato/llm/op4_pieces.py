"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of a text into the model's pieces with the
largest sum of scores.  A chunk of text maps the number of its first characters
that the piece before it covers (0 to LONGEST - 1) to the number of characters
its last piece covers beyond it: a LONGEST x LONGEST matrix over (max, +).  Such
matrices combine associatively.  A giant document is cut into segments, a
segment into chunks whose matrices are made in lockstep; the product over chunks
gives the segment's matrix, the matrices of a document give every segment's two
boundary states, and each segment is then traced back on its own.  Scores are
integers, so any way of combining gives the same best sum.

No piece has a space mark after another character, so the best segmentations of
space-separated parts are independent; documents of one segment are put together
from remembered parts.  Spaces are marked and one is put before the text, as the
model does; a character that is no piece falls back to byte pieces, as does the
mark itself where it occurs in a text, so that decoding gives back every text.

The file at hand is a BPE model: its scores are merge ranks, not
log-probabilities.  They are turned into log-probabilities by Zipf's law, log
p = -log(rank + 3) up to a constant, so ids need not equal those of merging.

Defined results: null text is empty; empty text has no pieces; repeated rows are
encoded each; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from mercato.llm.common import in_blocks, stored

LONGEST, CHUNK, SEGMENT = 16, 64, 32_768
BLOCK = 2_000_000  # bytes of texts or ids that a task works on at a time
NONE = -(1 << 50)
MARK, LITERAL = 0x2581, 0x110001  # the space mark; a mark that was already in the text
SCALE, BYTE_SCORE = 1_000_000, -25_000_000
CELL = re.compile(" +[^ ]*")
OPENS = re.compile("[^ ] ")


class Lexicon:
    """Pieces of a SentencePiece file, found by the hashes of their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        score = {i: -round(SCALE * np.log(r + 3)) for r, i in enumerate(order)}
        self.bytes = [b""] * sp.get_piece_size()
        first = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = bytes([int(p[3:5], 16)])
                first[int(p[3:5], 16)] = i
            elif i in score:
                self.bytes[i] = p.replace("▁", " ").encode()
        self.byte_ids = np.array([first[b] for b in range(256)], np.int64)
        found: dict[int, int] = {}
        for i in normal:
            h = np.uint64(0)
            for k, c in enumerate(sp.id_to_piece(i)):
                h = self.roll(np.array([h]), np.array([ord(c)], np.uint64))[0]
                found.setdefault(int(h), -1)
            found[int(h)] = i
        self.hash = np.array(sorted(found), np.uint64)
        self.id = np.array([found[int(h)] for h in self.hash])
        self.score = np.array([score.get(i, NONE) for i in range(sp.get_piece_size())])

        self.places()

    def places(self) -> None:
        # two tables of places by different bits of the hash: what the first one loses is in the second
        every = np.arange(len(self.hash))
        self.first = np.zeros(1 << 20, np.int64)
        self.first[self.slot(self.hash, 44)] = every
        lost = every[self.first[self.slot(self.hash, 44)] != every]
        self.shift = next(x for x in range(44) if len(np.unique(self.slot(self.hash[lost], x))) == len(lost))
        self.second = np.zeros(1 << 20, np.int64)
        self.second[self.slot(self.hash[lost], self.shift)] = lost

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "second", "shift")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.places()

    @staticmethod
    def slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    @staticmethod
    def roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = (h + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def pieces(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the piece of each length at each of the first n[m]
        positions of every row of codes (0 beyond a text's end); id -1: bytes."""
        rows, width = codes.shape
        width -= LONGEST - 1
        s, ids = np.full((rows, width, LONGEST), NONE), np.full((rows, width, LONGEST), -1)
        m, p = np.nonzero(np.arange(width)[None, :] < n[:, None])
        one = codes[m, p]
        size = 1 + (one >= 0x80).astype(np.int64) + (one >= 0x800) + (one >= 0x10000)
        s[m, p, 0] = BYTE_SCORE * np.where(one == LITERAL, 3, size)
        h = np.zeros(len(m), np.uint64)
        for k in range(LONGEST):
            h = self.roll(h, codes[m, p + k].astype(np.uint64))
            at = self.first[self.slot(h, 44)]
            miss = np.flatnonzero(self.hash[at] != h)
            at[miss] = self.second[self.slot(h[miss], self.shift)]
            ok = self.hash[at] == h
            m, p, h, at = m[ok], p[ok], h[ok], at[ok]
            got = self.id[at]
            whole = got >= 0
            s[m[whole], p[whole], k] = self.score[got[whole]]
            ids[m[whole], p[whole], k] = got[whole]
        return s, ids

    def emit(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Packed ids of rows of count[m] ids each; -1 - code stands for the bytes of a character."""
        ends, other = np.concatenate([[0], np.cumsum(count)]), ids < 0
        if other.any():
            code = -1 - ids[other]
            utf = [chr(c).encode() for c in np.where(code == LITERAL, MARK, code).tolist()]
            size = np.ones(len(ids), np.int64)
            size[other] = [len(x) for x in utf]
            ids = np.repeat(ids, size)
            ids[np.repeat(other, size)] = self.byte_ids[np.frombuffer(b"".join(utf), np.uint8)]
            ends = np.concatenate([[0], np.cumsum(size)])[ends]
        packed, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [packed[lo:hi] for lo, hi in zip(ends, ends[1:])]


def codes_of(text: str) -> np.ndarray:
    """Code points with the space mark for spaces."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(c == 32, MARK, np.where(c == MARK, LITERAL, c))


def transfer(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The matrices of chunks of n[m] characters."""
    rows, width, _ = s.shape
    f = np.full((width + LONGEST, rows, LONGEST), NONE)
    f[np.arange(LONGEST), :, np.arange(LONGEST)] = 0
    for p in range(width):
        for k in range(LONGEST):
            np.maximum(f[p + k + 1], f[p] + s[:, p, k, None], out=f[p + k + 1])
    out = f[n[:, None] + np.arange(LONGEST), np.arange(rows)[:, None]]  # rows, b, a
    return np.maximum(out.transpose(0, 2, 1), NONE)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus products of stacked matrices."""
    return np.maximum((x[..., :, :, None] + y[..., None, :, :]).max(-2), NONE)


def product(t: np.ndarray) -> np.ndarray:
    """The product of a stack of matrices in order, by halving."""
    while len(t) > 1:
        rest = t[len(t) // 2 * 2:]
        t = np.concatenate([times(t[0:len(t) // 2 * 2:2], t[1:len(t) // 2 * 2:2]), rest])
    return t[0]


def states(t: np.ndarray, a: int, b: int) -> np.ndarray:
    """The states at all boundaries of a stack of matrices on a best path from a to b."""
    ahead = np.full((len(t) + 1, LONGEST), NONE)
    ahead[-1, b] = 0
    for i in range(len(t) - 1, -1, -1):
        ahead[i] = np.maximum((t[i] + ahead[i + 1]).max(1), NONE)
    out = [a]
    for i in range(len(t)):
        out.append(int((t[i][out[-1]] + ahead[i + 1]).argmax()))
    return np.array(out)


def trace(s: np.ndarray, ids: np.ndarray, codes: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best pieces of every chunk from state a to state b, in one array (-1 - code for a
    character that is no piece), and how many each chunk has."""
    rows, width, _ = s.shape
    r = np.arange(rows)
    f, back = np.full((width + LONGEST, rows), NONE), np.zeros((width + LONGEST, rows), np.int8)
    f[a, r] = 0
    live = (s > NONE).any(0)
    for p in range(width):
        for k in np.flatnonzero(live[p]):
            x = f[p] + s[:, p, k]
            better = x > f[p + k + 1]
            np.copyto(f[p + k + 1], x, where=better)
            np.copyto(back[p + k + 1], k + 1, where=better)
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = n + b
    act = r[at > a]
    while len(act):
        k = back[at[act], act]
        at[act] -= k
        got = ids[act, at[act], k - 1]
        found.append(np.where(got >= 0, got, -1 - codes[act, at[act]]))
        of.append(act)
        act = act[at[act] > a[act]]
    row = np.concatenate(of[::-1])  # the last step is a row's first piece
    return np.concatenate(found[::-1])[np.argsort(row, kind="stable")], np.bincount(row, minlength=rows)


def chunked(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of CHUNK characters and LONGEST - 1 of lookahead; the first n codes are theirs."""
    count = max(1, -(-n // CHUNK))
    pad = np.concatenate([codes, np.zeros(max(0, count * CHUNK + LONGEST - 1 - len(codes)), np.int64)])
    rows = np.lib.stride_tricks.sliding_window_view(pad, CHUNK + LONGEST - 1)[:count * CHUNK:CHUNK]
    return rows, np.minimum(CHUNK, n - np.arange(count) * CHUNK)


def chunks_matrix(lex: Lexicon, codes: np.ndarray, n: int) -> np.ndarray:
    """The matrix of the first n characters, from those of chunks."""
    rows, sizes = chunked(codes, n)
    s, _ = lex.pieces(rows, sizes)
    return product(transfer(s, sizes))


def chunks_ids(lex: Lexicon, codes: np.ndarray, n: int, a: int, b: int) -> bytes:
    """Ids of the pieces that begin in the first n characters, chunk by chunk."""
    rows, sizes = chunked(codes, n)
    s, ids = lex.pieces(rows, sizes)
    at = states(transfer(s, sizes), a, b) if len(rows) > 1 else np.array([a, b])
    return b"".join(lex.emit(*trace(s, ids, rows, sizes, at[:-1], at[1:])))


def closed(part: str, n: int) -> tuple[int, int] | None:
    """The first and the last place among the first n characters that no piece crosses."""
    m = OPENS.search(part, 0, n)
    if not m:
        return None
    last = n
    while True:
        last = part.rfind(" ", 0, last)
        if part[last - 1] != " ":
            return m.start() + 1, last


def segment_matrix(lex: Lexicon, part: str, n: int) -> np.ndarray:
    """The matrix of a segment.  Where no piece can cross a place, the matrix has
    rank one: what lies between the first and the last such place adds the same
    to every path, so it is left out."""
    codes, ends = codes_of(part), closed(part, n)
    if not ends:
        return chunks_matrix(lex, codes, n)
    head, tail = chunks_matrix(lex, codes, ends[0]), chunks_matrix(lex, codes[ends[1]:], n - ends[1])
    return np.maximum(head[:, :1] + tail[:1, :], NONE)


def segment_ids(enc: Encoder, part: str, n: int, a: int, b: int) -> bytes:
    """Ids of the pieces that begin in the segment."""
    codes, ends = codes_of(part), closed(part, n)
    if not ends:
        return chunks_ids(enc.lex, codes, n, a, b)
    inner = enc.cells([CELL.findall(part[ends[0]:ends[1]])])[0]
    return (chunks_ids(enc.lex, codes, ends[0], a, 0) + inner
            + chunks_ids(enc.lex, codes[ends[1]:], n - ends[1], 0, b))


class Encoder:
    """Whole texts from the remembered ids of their space-separated parts.  What is remembered is
    forgotten when it reaches ``bound`` characters, 64 counted for each part beside its own."""

    def __init__(self, lex: Lexicon, bound: int = 12_000_000):
        self.lex, self.known, self.bound, self.held = lex, {}, bound, 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        return self.cells([CELL.findall(" " + t) if t else [] for t in texts])

    def cells(self, cells: list[list[str]]) -> list[bytes]:
        new = list(set().union(*cells).difference(self.known))
        if self.held > self.bound:
            self.known.clear()
            self.held = 0
            new = list(set().union(*cells))
        self.held += sum(map(len, new)) + 64 * len(new)
        new.sort(key=len)
        lo = 0
        while lo < len(new):
            width = len(new[lo]) + 3
            hi = lo
            while hi < len(new) and hi - lo < 2048 and len(new[hi]) <= min(width, CHUNK):
                hi += 1
            if hi == lo:  # a long part: its own scan over chunks
                c = codes_of(new[lo])
                self.known[new[lo]] = chunks_ids(self.lex, c, len(c), 0, 0)
                lo += 1
                continue
            n = np.array([len(x) for x in new[lo:hi]])
            rows = np.zeros((hi - lo, n.max() + LONGEST - 1), np.int64)
            rows[np.arange(rows.shape[1])[None, :] < n[:, None]] = codes_of("".join(new[lo:hi]))
            s, ids = self.lex.pieces(rows, n)
            zero = np.zeros(hi - lo, np.int64)
            self.known.update(zip(new[lo:hi], self.lex.emit(*trace(s, ids, rows, n, zero, zero))))
            lo = hi
        return [b"".join(map(self.known.__getitem__, x)) for x in cells]


def text_of(pieces_of: list[bytes], ids: bytes, step: int = 1 << 18) -> bytes:
    """The text of packed ids, ``step`` bytes of them at a time."""
    return b"".join(b"".join(map(pieces_of.__getitem__, np.frombuffer(ids[i:i + step], "<u4").tolist()))
                    for i in range(0, len(ids), step))[1:]


def encode(docs: DataFrame, path: str | None = None, segment: int = SEGMENT, back: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids``: little-endian unsigned 32-bit ids as binary.  ``back``
    names a column for the text that the ids decode to, made by the same worker."""
    lex = Lexicon(path or public_tokenizers.path("piece_bpe_32k.model"))  # read once, about 2 MB
    schema = StructType([*docs.schema.fields, StructField("ids", BinaryType()), *([StructField(back, StringType())] if back else [])])

    def short(batches):
        enc = Encoder(lex)
        for b in in_blocks(batches, "text", BLOCK):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = [x for i in range(0, len(texts), 512) for x in enc(texts[i:i + 512])]
            more = [pa.array(ids, pa.binary())]
            if back:
                more.append(pa.array([text_of(lex.bytes, x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], schema.names)

    giant = F.length("text") > segment
    small = docs.where(~F.coalesce(giant, F.lit(False))).mapInArrow(short, schema)
    large = docs.where(giant)
    marked = large.select(F.xxhash64("text", F.length("text")).alias("k"), F.concat(F.lit(" "), "text").alias("t")).dropDuplicates(["k"])
    last = F.ceil(F.length("t") / segment).cast("int") - 1
    segs = marked.select("k", last.alias("last"), "t", F.explode(F.sequence(F.lit(0), last)).alias("seg")).select(
        "k", "last", "seg", F.substring("t", F.col("seg") * segment + 1, F.lit(segment + LONGEST - 1)).alias("part"))
    segs = stored(segs.repartition("k", "seg"), "segments")

    def matrices(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "seg": pdf["seg"], "m": [
                segment_matrix(lex, x, min(len(x), segment)).tobytes() for x in pdf["part"]]})

    def boundaries(pdf: pd.DataFrame) -> pd.DataFrame:  # matrices of one document, no text
        pdf = pdf.sort_values("seg")
        at = states(np.stack([np.frombuffer(x, np.int64).reshape(LONGEST, LONGEST) for x in pdf["m"]]), 0, 0)
        return pd.DataFrame({"k": pdf["k"], "seg": pdf["seg"], "a": at[:-1], "b": at[1:]})

    def traced(batches):
        enc = Encoder(lex)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "seg": pdf["seg"], "ids": [
                segment_ids(enc, x, min(len(x), segment), a, b) for x, a, b in zip(pdf["part"], pdf["a"], pdf["b"])]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "ids": [b"".join(pdf.sort_values("seg")["ids"])]})

    cut = stored(segs.mapInPandas(matrices, "k long, seg int, m binary").groupBy("k").applyInPandas(
        boundaries, "k long, seg int, a int, b int"), "boundaries")
    whole = segs.join(cut, ["k", "seg"]).mapInPandas(traced, "k long, seg int, ids binary").groupBy("k").applyInPandas(
        joined, "k long, ids binary").withColumnsRenamed({"k": "__k", "ids": "__ids"})
    big = large.withColumn("__k", F.xxhash64("text", F.length("text"))).join(whole, "__k")
    big = big.select(*[F.col(c) for c in docs.columns], F.col("__ids").alias("ids"))
    return small.unionByName(decode(big, path, back) if back else big)


def decode(ids: DataFrame, path: str | None = None, out: str = "decoded") -> DataFrame:
    """All columns of ``ids`` and the text that its column ids stands for."""
    pieces_of = Lexicon(path or public_tokenizers.path("piece_bpe_32k.model")).bytes
    schema = StructType([*ids.schema.fields, StructField(out, StringType())])

    def run(batches):
        for b in in_blocks(batches, "ids", BLOCK):
            texts = [text_of(pieces_of, x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, out])

    return ids.mapInArrow(run, schema)


def pieces(docs: DataFrame) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return encode(d, back="decoded").select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("exact"))
