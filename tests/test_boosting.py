"""Leaf-wise boosting against growth of one split at a time, and on planted signals."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercato.operators import boosting, churn_model
from mercato.operators.attribution import base_margin, contributions
from mercato.operators.boosting import Settings, best_splits, shrink

NAMES = ["a", "b", "c"]
SCHEMA = "id long, a double, b double, c double, y int, w double, v boolean"


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.random(), float(r.randint(0, 5)), r.gauss(0, 1)
        y = int((a > 0.6) != (b > 2)) if r.random() < 0.9 else r.randint(0, 1)
        out.append((i, a, b, c if i % 17 else None, y, 1.0 + y, i % 5 == 0))
    return out


def fit(df, edges=None, **kw):
    return boosting.fit(df, NAMES, "id", "y", "w", "v", Settings(**kw), edges)


def one_at_a_time(bins, y, w, start, last, s):
    """The same tree grown the plain way: always the leaf of greatest gain next.  Returns the value of each row."""
    p = 1 / (1 + np.exp(-np.full(len(y), start)))
    g, h = np.rint(w * (p - y) * boosting.UNIT), np.rint(w * p * (1 - p) * boosting.UNIT)
    number, heap = 0, []

    def push(members, depth):
        nonlocal number
        table = np.zeros((1, bins.shape[1], int(last.max()) + 1, 3), np.int64)
        for i in members:
            for j in range(bins.shape[1]):
                table[0, j, bins[i, j]] += np.array([g[i], h[i], 1], np.int64)
        gain, j, cut = best_splits(table, np.ones(bins.shape[1], bool), last, s)[0]
        heapq.heappush(heap, (-(gain if depth < s.depth else 0), number, members, depth, j, cut))
        number += 1

    push(np.arange(len(y)), 0)
    while len(heap) < s.leaves and heap[0][0] < -1e-9:
        _, _, members, depth, j, cut = heapq.heappop(heap)
        left = bins[members, j] <= cut
        push(members[left], depth + 1)
        push(members[~left], depth + 1)
    out = np.zeros(len(y))
    for _, _, members, *_ in heap:
        out[members] = -s.step * shrink(g[members].sum() / boosting.UNIT, s.l1) / (h[members].sum() / boosting.UNIT + s.l2)
    return out


@pytest.mark.parametrize("leaves,depth", [(4, 9), (9, 9), (31, 4), (128, 9)])
def test_a_tree_equals_growth_one_split_at_a_time(spark, leaves, depth):
    data = [(*r[:6], False) for r in rows(400)]
    df = spark.createDataFrame(data, SCHEMA)
    s = dict(rounds=1, leaves=leaves, depth=depth, bag=1.1, features=1.0, least_rows=3, bins=16)
    m = fit(df, **s)
    x = np.array([[np.nan if v is None else v for v in r[1:4]] for r in data], float)
    y, w = np.array([r[4] for r in data]), np.array([r[5] for r in data])
    want = one_at_a_time(m.bins(x), y, w, m.start, np.array([len(e) for e in m.edges]), Settings(**s))
    assert len(m.trees) == 1 and np.allclose(m.margin(x) - m.start, want, atol=1e-12)
    assert sum(v < 0 for v in m.trees[0].left) <= leaves


def test_the_model_does_not_depend_on_partitions_and_stops_early(spark):
    df = spark.createDataFrame(rows(900), SCHEMA)
    kw = dict(rounds=60, step=0.3, patience=5, leaves=8)
    one = fit(df.repartition(1), **kw)
    two = fit(df.repartition(6, "b"), one.edges, **kw)
    assert one.trees == two.trees and one.losses == two.losses
    assert 0 < len(one.trees) < 60 and len(one.trees) == int(np.argmin(one.losses))
    got = boosting.with_probability(df, one).select("y", "model_probability", "v").collect()
    held = [(r[1] > 0.5) == (r[0] == 1) for r in got if r.v]
    assert len(got) == 900 and np.mean(held) > 0.85


def test_attributions_of_the_leaves_sum_to_the_margin(spark):
    m = fit(spark.createDataFrame(rows(500), SCHEMA), rounds=6, step=0.2, leaves=10)
    x = np.array([[*r[1:3], r[3] or 0.0] for r in rows(200, 9)], float)
    leaves = m.leaf_paths()
    assert np.allclose(contributions(leaves, x).sum(1) + base_margin(leaves) + m.start, m.margin(x), atol=1e-9)


def test_a_tree_uses_its_own_features_only(spark):
    m = fit(spark.createDataFrame(rows(600), SCHEMA), rounds=8, step=0.1, leaves=6, features=0.3, patience=100)
    used = [{f for f, side in zip(t.feature, t.left) if side >= 0} for t in m.trees]
    assert used and all(len(u) == 1 for u in used) and len(set.union(*used)) > 1
    for t in m.trees:
        assert all(t.rows[n] == t.rows[t.left[n]] + t.rows[t.right[n]] for n in range(len(t.left)) if t.left[n] >= 0)


def test_area_from_grades():
    r = np.random.default_rng(2)
    grade, y = r.integers(0, 40, 500), r.integers(0, 2, 500)
    up, down = grade[y == 1], grade[y == 0]
    want = np.mean((up[:, None] > down) + 0.5 * (up[:, None] == down))
    counts = np.stack([np.bincount(grade[y == k], minlength=boosting.GRADES) for k in (0, 1)])
    assert abs(1 - boosting.lost_area(counts) - want) < 1e-12
    assert boosting.lost_area(counts * np.array([[1], [0]])) == 0


def test_defined_results(spark):
    df = spark.createDataFrame(rows(60), SCHEMA)
    assert boosting.with_probability(df, fit(df.where("y = 1"), rounds=3)).where("model_probability < 0.99").count() == 0
    assert boosting.with_probability(df, fit(df.where("y = 0"), rounds=3)).where("model_probability > 0.01").count() == 0
    assert fit(df.limit(0), rounds=3).trees == []
    blank = df.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0))
    m = fit(blank, rounds=3)
    assert boosting.with_probability(blank, m).where("model_probability is null or isnan(model_probability)").count() == 0
    assert boosting.with_probability(df.limit(0), m).count() == 0


def test_auc_is_not_below_that_of_level_wise_trees(spark):
    from tests.test_models import _planted

    r = F.pmod(F.xxhash64("customer_unique_id"), F.lit(10)) < 1  # a tenth of the labels flipped
    m = _planted(spark).withColumn("churn", F.when(r, 1 - F.col("churn")).otherwise(F.col("churn")))
    split = churn_model.stratified_split(m).checkpoint()
    level = churn_model.evaluate(churn_model.fit_churn_model(split, max_iter=20, max_depth=4), split)
    model = churn_model.fit_leafwise(split, Settings(rounds=200, step=0.1, patience=20))
    out = churn_model.leafwise_metrics(model, split).first()
    assert out.test_auc >= level - 0.01 and out.trees == len(model.trees) > 0 and out.most_leaves <= 128
