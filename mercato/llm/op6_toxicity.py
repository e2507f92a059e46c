"""Toxicity by multiple-instance learning over sentences.

A sentence has the probability 1 - exp(-softplus(z)) with z = bias + the weights
of its distinct words and of their first 4 and 6 letters, and a document the noisy-or of its sentences:
1 - prod(1 - p) = 1 - exp(-sum softplus(z)).  Only document labels are known, so
the noisy-or is what training fits; it finds the offending sentences itself.

Candidate words are those whose document frequencies in the two classes differ
most, counted over all labelled training documents.  Weights are fitted in numpy
on at most ``sample`` labelled documents, reduced on the executors to the candidate
words of each distinct sentence.  Texts are never shuffled: their distinct words are.

Defined results: null text is empty, and a text without words scores as one
sentence without words; without labels of both classes every score is 0; a
document labelled more than once is toxic if any label says so; repeated rows are
scored each; other columns pass through ``with_score`` unchanged.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from mercato.llm.common import Memo, fold, in_blocks, stored

SPLIT = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 6)


def sentences(text: str | None) -> list[str]:
    return [s for s in SPLIT.split((text or "").lower()) if s and not s.isspace()] or [""]


def features(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Model:
    """weights: word -> weight; bias: of every sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.of = Memo(lambda w: sum(weights.get(f, 0.0) for f in features(w)))

    def rates(self, text: str | None) -> np.ndarray:
        """softplus(z) of every sentence."""
        of = self.of
        z = np.array([sum([of[w] for w in {*WORD.findall(s)}]) for s in sentences(text)]) + self.bias
        return np.logaddexp(0, z)

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-self.rates(text).sum()))

    def located(self, text: str | None, least: float = 0.5) -> list[tuple[str, float]]:
        """Sentences whose own probability reaches ``least``."""
        p = -np.expm1(-self.rates(text))
        return [(s, float(x)) for s, x in zip(sentences(text), p) if x >= least]


def bag_of(text: str | None, ids: dict[str, int]) -> Counter:
    """The distinct sentences of a text, each the sorted candidate features of its words, and how often they occur."""
    return Counter(tuple(sorted(ids[f] for w in {*WORD.findall(s)} for f in features(w) if f in ids)) for s in sentences(text))


def fit(bags: list[Counter], y: np.ndarray, size: int, steps: int = 300, rate: float = 0.1,
        l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on the log-loss of the noisy-or over the sentences of each bag."""
    sent_bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    times = np.array([n for b in bags for n in b.values()], float)
    pairs = [(i, w) for i, s in enumerate(s for b in bags for s in b) for w in s]
    at, word = np.array(pairs, np.int64).reshape(-1, 2).T
    theta = np.zeros(size + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        z = np.bincount(at, theta[word], len(sent_bag)) + theta[-1]
        total = np.bincount(sent_bag, times * np.logaddexp(0, z), len(bags))
        # d loss / d total: 1 for label 0, -exp(-t) / (1 - exp(-t)) for label 1
        g = np.clip(np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-6, 30)), 1.0), -50, 1) / len(y)
        gz = g[sent_bag] * times / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.append(np.bincount(word, gz[at], size) + l2 * theta[:-1] / len(y) ** 0.5, gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        theta[-1] = min(theta[-1], -3.0)
    return theta[:-1], float(theta[-1])


def document_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the distinct words of every row's whole text, joined by spaces."""
    def run(batches):
        for b in in_blocks(batches):
            got = [" ".join(sorted({*WORD.findall((t or "").lower())})) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(
        run, "doc_id long, words string")


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, candidates: int = 2000, most: int = 4_000_000) -> Model:
    """Fit on labelled documents outside fold 0 of 5.  ``sample`` bounds the fitted documents, and
    ``most`` their words and sentences together: documents are taken in the order of a hash of the id while they fit."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    y = y.where(fold(F.col("doc_id"), 5) != 0)
    # only distinct words meet the labels, by the same kind of join at every size
    known = document_words(docs).hint("merge").join(y, "doc_id")

    def count(batches):
        for pdf in batches:
            seen = [Counter(), Counter()]
            for words, toxic in zip(pdf["words"], pdf["__y"]):
                seen[int(toxic == 1)].update({f for w in words.split() for f in features(w)})
            words = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": ["", *words], "clean": [int((pdf["__y"] != 1).sum()), *(seen[0][w] for w in words)],
                                "toxic": [int((pdf["__y"] == 1).sum()), *(seen[1][w] for w in words)]})

    df = stored(known.mapInPandas(count, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "frequencies")
    both = df.where("word = ''").collect()
    if not both or not both[0].clean or not both[0].toxic:
        return Model({}, -50.0)
    n0, n1 = both[0].clean, both[0].toxic
    p = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    gain = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(p * (1 - p) + 1e-9)
    top = df.where("word <> '' and clean + toxic >= 2").orderBy(F.abs(gain).desc(), "word").limit(candidates).collect()
    ids = {x.word: i for i, x in enumerate(top)}
    # a bounded sample by a hash of the id, with the classes' shares of the data; at most ``sample`` rows are broadcast
    chosen = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def reduce(batches):
        for b in in_blocks(batches):
            pdf = b.to_pandas()
            bags = [bag_of(t, ids) for t in pdf["text"]]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "doc_id": pdf["doc_id"], "y": (pdf["__y"] == 1).astype("int32"), "size": [sum(1 + len(s) for s in x) for x in bags],
                "bag": [" ".join(f"{n}:" + ",".join(map(str, s)) for s, n in sorted(x.items())) for x in bags]}), preserve_index=False)

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").mapInArrow(
        reduce, "doc_id long, y int, size long, bag string"), "bags")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("size"), F.xxhash64("bag"), F.col("bag")]
    # the sizes of at most ``sample`` rows say up to which row the sample fits
    sizes = np.array([r[0] for r in rows.orderBy(*order).select("size").limit(sample).collect()], np.int64)
    fits = max(1, int((np.cumsum(sizes) <= most).sum()))
    taken = rows.orderBy(*order).limit(fits).collect()
    bags = [Counter({tuple(map(int, filter(None, s.partition(":")[2].split(",")))): int(s.partition(":")[0]) for s in x.bag.split(" ")})
            for x in taken]
    w, bias = fit(bags, np.array([x.y for x in taken]), len(ids))
    return Model({x: float(w[i]) for x, i in ids.items() if abs(w[i]) > 1e-3}, bias)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for b in in_blocks(batches):
            got = pa.array([model.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, score): the sentences located in every document."""
    def run(batches):
        for b in in_blocks(batches):
            found = [(d, s, p) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for s, p in model.located(t, least)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(
                (pa.int64(), pa.string(), pa.float64()))], ["doc_id", "sentence", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sentence string, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = with_score(d, train(docs, labels))
    return s.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))
