"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, runs of other characters than letters become one space, and
every 1-, 2- and 3-gram is hashed to one of BUCKETS features of its order.  A
feature's value is its share of the text's n-grams times its inverse document
frequency, counted over all training documents.  Weights are trained by
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, whose
L1 part keeps them sparse, on at most ``sample`` labelled documents; a fifth of
them is set aside for the temperature that calibrates the probabilities.

Defined results: null text, or text without letters, is ``und`` with score 0, as
is everything when there is nothing to learn from; null lang is not learned; a
null doc_id counts as fold 0; repeated rows are predicted each; other columns
pass through ``with_language`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mercato.llm.common import fold

BUCKETS, ORDERS, SCALE = 1 << 14, 3, 20.0
SIZE = BUCKETS * ORDERS
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Feature ids of all n-grams of a text; empty if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    two = c[:-1] * np.uint64(0x100001B3) + c[1:]
    out = [c[1:-1], two, two[:-1] * np.uint64(0x100001B3) + c[2:]]
    return np.concatenate([((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64) + i * BUCKETS
                           for i, x in enumerate(out)])


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights.astype(np.float32), bias, temperature

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        total = sum(self.weights[ids[i:i + 100_000]].sum(0, dtype=np.float64) for i in range(0, len(ids), 100_000))
        z = (total * (SCALE / len(ids)) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        ids = grams(text, letters)
        if not len(ids) or not self.langs:
            return UNKNOWN, 0.0
        p = self.probabilities(ids)
        return self.langs[int(p.argmax())], float(p.max())


def ftrl(rows: list, y: np.ndarray, n_class: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, one document at a time; rows: (feature ids, values)."""
    z, n = np.zeros((SIZE + 1, n_class)), np.zeros((SIZE + 1, n_class))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, SIZE), np.append(x, 1.0)  # the last one is the bias
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def train(docs: DataFrame, sample: int = 3000) -> Model:
    """Learn from rows with a lang outside fold 2 of 4; ``sample`` bounds the fitted rows only."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    d = d.where((fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())

    def frequencies(batches):
        letters, df, n = letter_table(), np.zeros(SIZE, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                ids = grams(t, letters)
                if len(ids):
                    df += np.bincount(ids, minlength=SIZE) > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, SIZE)), pa.array(np.append(df[at], n))], ["id", "n"])

    counts = d.select("text").mapInArrow(frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # SIZE + 1 rows at most
    df = np.zeros(SIZE + 1)
    df[counts["id"]] = counts["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    chosen = d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def reduce(batches):
        letters = letter_table()
        for pdf in batches:
            got = [np.unique(grams(t, letters), return_counts=True) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "id": [i.astype(np.int32) for i, _ in got],
                                "n": [n.astype(np.int32) for _, n in got]})

    rows = d.join(chosen, "doc_id").mapInPandas(reduce, "doc_id long, lang string, id array<int>, n array<int>").toPandas()
    rows = rows[rows["id"].map(len) > 0].sort_values(["doc_id", "lang"])
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], np.zeros((SIZE, 1)), np.zeros(1), 1.0)
    y = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    x = [(i, SCALE * n / n.sum() * idf[i]) for i, n in zip(rows["id"].map(np.asarray), rows["n"].map(np.asarray))]
    held = np.arange(len(x)) % 5 == 4
    w, bias = ftrl([r for r, h in zip(x, held) if not h], y[~held], len(langs))
    z = np.array([v @ w[i] + bias for (i, v), h in zip(x, held) if h]).reshape(-1, len(langs))

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), y[held]]).mean()

    temperature = min(np.geomspace(0.1, 10, 81), key=loss) if len(z) else 1.0
    return Model(langs, w * idf[:, None], bias, float(temperature))


def with_language(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, the predicted language of the whole text and its probability."""
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])

    def run(batches):
        letters = letter_table()
        for b in batches:
            got = [model.predict(t, letters) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()),
                                              pa.array([x[1] for x in got], pa.float64())], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_language(d, train(docs)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
