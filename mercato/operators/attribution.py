"""Path-dependent attributions of a boosted-tree model (CH9).

For one leaf, let F be the features its path tests.  A feature's conditions on the path
are one interval; o = 1 if the row lies in it, and z is the share of the training rows
that the path keeps at that feature's splits.  Replacing the features outside a coalition
by those shares gives the leaf the weight prod(o over the coalition) * prod(z over the
rest), so the Shapley value of feature i is the leaf's value times

    (o_i - z_i) * sum over sizes s of  s! (m-s-1)! / m! * [t^s] prod over j <> i of (z_j + o_j t).

Only the pattern of the o matters: the polynomial is worked out once for each pattern
that occurs in a batch of rows.  Summed over all leaves, a row's contributions add up
to the model's margin minus its base (the margin's mean under the shares).

The leaves are read from the model's saved node table: at most trees * 2^depth rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float          # times the tree's weight
    feature: np.ndarray   # distinct features of the path
    low: np.ndarray       # low < x <= high
    high: np.ndarray
    share: np.ndarray


def read_leaves(spark: SparkSession, path: str) -> list[Leaf]:
    """The leaves of a saved tree ensemble (Spark ML format)."""
    weights = {r["treeID"]: r["weights"] for r in spark.read.parquet(f"{path}/treesMetadata").toDF(
        "treeID", "metadata", "weights").collect()}
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    trees: dict[int, dict] = {}
    for r in nodes.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves = []
    for t, tree in sorted(trees.items()):
        stack = [(tree[0], {})]
        while stack:
            node, path_ = stack.pop()
            if node["leftChild"] < 0:
                f = sorted(path_)
                leaves.append(Leaf(node["prediction"] * weights[t], np.array(f, np.int64), *(
                    np.array([path_[j][k] for j in f], float) for k in range(3))))
                continue
            for child, left in ((tree[node["leftChild"]], True), (tree[node["rightChild"]], False)):
                lo, hi, share = path_.get(node["feature"], (-np.inf, np.inf, 1.0))
                lo, hi = (lo, min(hi, node["threshold"])) if left else (max(lo, node["threshold"]), hi)
                stack.append((child, path_ | {node["feature"]: (lo, hi, share * child["rawCount"] / node["rawCount"])}))
    return leaves


def base_margin(leaves: list[Leaf]) -> float:
    return float(sum(x.value * x.share.prod() for x in leaves))


def _shapley(inside: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Contributions of a leaf of value 1 for patterns ``inside`` (patterns, m)."""
    n, m = inside.shape
    weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
    out = np.empty((n, m))
    for i in range(m):
        poly = np.zeros((n, m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                up = poly[:, :-1] * inside[:, j:j + 1]
                poly *= share[j]
                poly[:, 1:] += up
        out[:, i] = (inside[:, i] - share[i]) * (poly @ weight)
    return out


def contributions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features): what each feature adds to the margin of each row."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        m = len(leaf.feature)
        if not m:
            continue
        part = x[:, leaf.feature]
        inside = (part > leaf.low) & (part <= leaf.high)
        code, at = np.unique(inside @ (1 << np.arange(m)), return_inverse=True)
        table = _shapley((code[:, None] >> np.arange(m) & 1).astype(float), leaf.share)
        out[:, leaf.feature] += leaf.value * table[at]
    return out


def top_contributions(matrix: DataFrame, key: str, features: list[str], leaves: list[Leaf], k: int) -> DataFrame:
    """(key, driver_rank, feature, contribution): each row's k greatest contributions, ties by name."""
    names = np.array(features)
    by_name = np.argsort(np.argsort(names))

    def run(batches):
        for pdf in batches:
            c = contributions(leaves, pdf[features].to_numpy(float))
            order = np.lexsort((np.broadcast_to(by_name, c.shape), -np.abs(c)))[:, :k]
            n, width = order.shape
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), width), "driver_rank": np.tile(np.arange(1, width + 1), n),
                                "feature": names[order].ravel(), "contribution": np.take_along_axis(c, order, 1).ravel()})

    return matrix.select(key, *features).mapInPandas(
        run, f"{key} {matrix.schema[key].dataType.simpleString()}, driver_rank bigint, feature string, contribution double")
