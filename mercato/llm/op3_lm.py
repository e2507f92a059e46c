"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

The corpus is counted in full: every training word's count and, over word
classes, every (two words back, one word back, word) triple.  The TOP most
frequent words are classes of their own; all others fall into RARE classes by
their last two bytes, and inside such a class a word has the probability
(c + 1) / (N + V + 1) of the class's own tokens N and distinct words V, an
unseen word that of c = 0.  The model scores a class w after classes a, b as
(p2 * r[a] + p1 * r[b]) . q[w] + bias[w]; it is trained in numpy on the triple
counts with NCE in ``parts`` groups, each of which goes over all of its triples by
their counts every round; the groups' parameters are averaged after it.
Batched matrix products then give the normalised log-probabilities of all
contexts, so a text's score is a sum of table entries.

Defined results: null text is empty (the end token only); a null doc_id counts
as fold 0; with no training rows every token has probability 1 under the base
and the untrained model is uniform; repeated rows are scored each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import Memo, fold, in_blocks, stored

TOP, RARE, HEAD, DIM = 126, 32, 50_000, 24
STEPS = 16  # of the scale of frequencies, for a doubling
HELD = 300_000  # words a task counts before it hands them on
END, BEGIN, N_CLASS = TOP + RARE, TOP + RARE + 1, TOP + RARE + 2
END_WORD = "\n"  # no word holds white space


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes.lower() changes A-Z, bytes.split() cuts at 20, 09-0D


def rare_class(word: bytes) -> int:
    return TOP + zlib.crc32(word[-2:]) % RARE


def _rare_class(word: Column) -> Column:
    return F.crc32(F.substring(word.cast("binary"), -2, 2)) % RARE + TOP


def texts(batches):
    """(rows, their texts) in blocks of bounded bytes."""
    for b in in_blocks(batches):
        yield b, b.column("text").cast(pa.binary()).to_pylist()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; each task counts before the shuffle, in a table that is emptied at HELD words."""
    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()),
                                           pa.array(seen.values(), pa.int64())], ["word", "n"])

    def run(batches):
        seen = Counter()
        for _, rows in texts(batches):
            seen.update(chain.from_iterable(map(words_of, rows)))
            seen[END_WORD.encode()] += len(rows)
            if len(seen) >= HELD:
                yield counted(seen)
                seen.clear()
        if seen:
            yield counted(seen)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def class_rows(rows: list, of: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens of all rows, and where each row's end token is."""
    words = [words_of(t) for t in rows]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    cls = np.fromiter((of[w] for w in chain.from_iterable(x + [None] for x in words)), np.int64, int(ends[-1]) + 1 if len(ends) else 0)
    return cls, ends


def contexts(cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The two classes before each token, as one number."""
    one = np.concatenate([[BEGIN], cls[:-1]])[:len(cls)]
    one[ends[:-1] + 1] = BEGIN
    two = np.concatenate([[BEGIN], one[:-1]])[:len(cls)]
    two[ends[:-1] + 1] = BEGIN
    return two * N_CLASS + one


def count_triples(docs: DataFrame, classes: dict) -> DataFrame:
    def run(batches):
        of = Memo(lambda w: END if w is None else classes[w] if w in classes else rare_class(w))
        total = None
        for _, rows in texts(batches):
            cls, ends = class_rows(rows, of)
            n = np.bincount(contexts(cls, ends) * N_CLASS + cls, minlength=N_CLASS**3)
            total = n if total is None else np.add(total, n, out=total)
        if total is not None:
            at = np.flatnonzero(total)
            for i in range(0, len(at), 100_000):
                part = at[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["triple", "n"])

    return docs.mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def unpack(theta: np.ndarray):
    r, q = theta[:N_CLASS * DIM].reshape(-1, DIM), theta[N_CLASS * DIM:2 * N_CLASS * DIM].reshape(-1, DIM)
    p, bias = theta[2 * N_CLASS * DIM:2 * N_CLASS * DIM + 2 * DIM].reshape(2, DIM), theta[2 * N_CLASS * DIM + 2 * DIM:]
    return r, q, p, bias


def start(noise: np.ndarray, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.1, 2 * N_CLASS * DIM), np.ones(2 * DIM), np.log(noise)])


def rows_of(n: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, weight) of the rows of one pass over triples that come ``n`` times: every triple has at least one
    row, frequent ones more, about ``draws`` in all and one for each triple; the weights of a triple add up to its count."""
    times = np.ceil(n * (draws / n.sum())).astype(np.int64)
    return np.repeat(np.arange(len(n)), times), np.repeat(n / times, times)


def nce(theta, triple, n, noise, steps, seed, k=32, batch=2048, rate=0.1):
    """Adagrad on the noise-contrastive objective, one pass over all triples by their counts in ``steps`` batches,
    and in more for more than ``steps * batch`` triples; the k noise classes of a batch are shared by its rows."""
    theta, rng = theta.copy(), np.random.default_rng(seed)
    r, q, p, bias = unpack(theta)
    square = np.full(len(theta), 1e-3)
    sr, sq, sp, sb = unpack(square)
    at, weight = rows_of(n, steps * batch)
    order = rng.permutation(len(at))
    at, weight = at[order], weight[order] / weight.mean()
    shift, one = np.log(k * noise), np.eye(N_CLASS)  # sums by class are products with rows of ``one``

    def step(x, s, at, g):
        s[at] += g * g
        x[at] -= rate * g / np.sqrt(s[at])

    for lo in range(0, len(at), batch):
        t, part = triple[at[lo:lo + batch]], weight[lo:lo + batch]
        a, b, w = t // N_CLASS**2, t // N_CLASS % N_CLASS, t % N_CLASS
        z = rng.choice(len(noise), k, p=noise)
        h = p[0] * r[a] + p[1] * r[b]
        true = -part / (1 + np.exp(np.clip((h * q[w]).sum(1) + bias[w] - shift[w], -30, 30)))
        false = part[:, None] / (1 + np.exp(-np.clip(h @ q[z].T + bias[z] - shift[z], -30, 30)))
        dh = (true[:, None] * q[w] + false @ q[z]) / batch
        is_w, is_z, is_a, is_b = (one[x] for x in (w, z, a, b))
        gq = (is_w.T @ (true[:, None] * h) + is_z.T @ (false.T @ h)) / batch
        gb = (true @ is_w + false.sum(0) @ is_z) / batch
        gr = is_a.T @ (dh * p[0]) + is_b.T @ (dh * p[1])
        gp = np.stack([(dh * r[a]).sum(0), (dh * r[b]).sum(0)])
        for x, s, g in ((q, sq, gq), (r, sr, gr), (bias, sb, gb), (p, sp, gp)):
            step(x, s, slice(None), g)
    return theta


def train(triples: DataFrame, noise: np.ndarray, parts: int = 4, rounds: int = 3, steps: int = 600) -> np.ndarray:
    """Iterative parameter mixing over ``parts`` groups of the at most N_CLASS^3 triples."""
    def fit_from(theta, k):
        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("triple")
            got = nce(theta, pdf.triple.to_numpy(), pdf.n.to_numpy(), noise, steps, seed=1000 * k + int(pdf.part.iloc[0]))
            return pd.DataFrame({"theta": [got.tolist()], "n": [pdf.n.sum()]})
        return fit

    theta = start(noise)
    dealt = triples.withColumn("part", F.pmod(F.xxhash64("triple"), F.lit(parts)))
    for k in range(rounds):
        got = dealt.groupBy("part").applyInPandas(fit_from(theta, k), "theta array<double>, n long").collect()  # ``parts`` rows
        if got:
            theta = np.average([x.theta for x in got], axis=0, weights=[x.n for x in got])
    return theta


def table(theta: np.ndarray) -> np.ndarray:
    """log10 p(class | context) of every context (rows) and class, normalised over
    the classes that can be predicted (BEGIN cannot)."""
    r, q, p, bias = unpack(theta)
    out = np.full((N_CLASS**2, N_CLASS), -np.inf, np.float32)
    for a in range(N_CLASS):  # the contexts whose first class is a
        s = (p[0] * r[a] + p[1] * r) @ q[:BEGIN].T + bias[:BEGIN]
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        out[a * N_CLASS:(a + 1) * N_CLASS, :BEGIN] = s / np.log(10)
    return out


def score(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    training = d.where("not held_out").select("text")
    counts = stored(count_words(training), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("word") != END_WORD)
    # the most frequent words, whole steps of a logarithmic scale and at most HEAD (and the TOP ones in any case)
    frequent = words.orderBy(F.desc("n"), "word").limit(TOP).collect()
    scale = F.floor(F.log2("n") * STEPS).cast("int")
    least, room = None, HEAD
    for x in sorted(words.groupBy(scale.alias("at")).agg(F.count("*").alias("v")).collect(), reverse=True):  # 64 * STEPS rows at most
        room -= x.v
        if room < 0:
            break
        least = x.at
    seen = {x.word for x in frequent}
    more = [] if least is None else [x for x in words.where(scale >= least).collect() if x.word not in seen]
    head = frequent + more
    ends = counts.where(F.col("word") == END_WORD).select("n").collect()
    ends = ends[0].n if ends else 0
    classes = {x.word.encode(): i for i, x in enumerate(head[:TOP])}
    top = [x.word for x in head[:TOP]]
    rare = words.where(~F.col("word").isin(top)) if top else words
    in_class = {x.c: (x.n, x.v) for x in rare.groupBy(_rare_class(F.col("word")).alias("c")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v")).collect()}  # RARE rows at most
    mass = np.ones(BEGIN)
    for i, x in enumerate(head[:TOP]):
        mass[i] += x.n
    for c, (n, _) in in_class.items():
        mass[c] += n
    mass[END] += ends
    noise = mass / mass.sum()
    theta = train(stored(count_triples(training, classes), "triples"), np.append(noise, 1e-9) / (1 + 1e-9))
    # of each head word: class, log10 of count + 1; of each rare class, of its N + V + 1
    known = {x.word.encode(): (i if i < TOP else rare_class(x.word.encode()), float(np.log10(x.n + 1))) for i, x in enumerate(head)}
    within = np.zeros(N_CLASS)
    for c in range(TOP, END):
        n, v = in_class.get(c, (0, 0))
        within[c] = np.log10(n + v + 1)
    base_norm, end_log = float(np.log10(total + distinct + 1)), float(np.log10(ends + 1))

    def run(batches):
        logp = table(theta)
        for b, rows in texts(batches):
            words = [words_of(t) for t in rows]
            n = np.array([len(w) + 1 for w in words])
            last = np.cumsum(n) - 1
            first = last - n + 1
            none = (-1, 0.0)
            pairs = [known.get(w, none) for w in chain.from_iterable(words)]
            cls, c1 = np.full(last[-1] + 1, END), np.full(last[-1] + 1, end_log)
            inner = np.ones(len(cls), bool)
            inner[last] = False
            cls[inner] = np.fromiter((x[0] for x in pairs), np.int64, len(pairs))
            c1[inner] = np.fromiter((x[1] for x in pairs), np.float64, len(pairs))
            rest = [[w for w in x if w not in known] for x in words]
            cls[cls < 0] = np.fromiter((rare_class(w) for w in chain.from_iterable(rest)), np.int64)
            lm = logp[contexts(cls, last), cls].astype(np.float64) - within[cls] + np.where((cls >= TOP) & (cls < END), c1, 0.0)
            known_n = n - np.array([len(x) for x in rest]) - (0 if ends else 1)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(known_n),
                pa.array(np.add.reduceat(c1, first) - n * base_norm), pa.array(np.add.reduceat(lm, first)),
                pa.array(rest, pa.list_(pa.binary())).cast(pa.list_(pa.string()))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "lm", "rest"])

    part = d.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, rest array<string>")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words outside the head, pre-aggregated per row, meet their counts in a join
    rest = part.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    met = rest.join(counts, "word").groupBy("row").agg(
        F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("add"))
    add = F.coalesce("add", F.lit(0.0))
    return part.drop("rest").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("lm") + add).alias("score"))
