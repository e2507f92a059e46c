"""Model jobs on planted-signal data: the fits must find the signal."""

import datetime as dt
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from mercato.operators import churn_model, forecast
from mercato.operators.churn import FEATURE_COLUMNS


def _planted(spark, n=1500, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = {c: rnd.random() for c in FEATURE_COLUMNS}
        x["recency"] = rnd.randint(0, 400)
        churned = 1 if x["recency"] > 150 else 0  # the planted rule
        rows.append((i, *[float(x[c]) for c in FEATURE_COLUMNS], rnd.randint(0, 1), churned))
    cols = ["customer_unique_id", *FEATURE_COLUMNS, "pay_a", "churn"]
    return spark.createDataFrame(rows, cols).withColumn("pay_a", F.col("pay_a").cast("bigint"))


def test_split_is_exact_per_class_and_stable(spark):
    m = _planted(spark)
    a = churn_model.stratified_split(m)
    counts = {(r[0], r[1]): r[2] for r in a.groupBy("churn", "split").count().collect()}
    for cls in (0, 1):
        n = counts.get((cls, "train"), 0) + counts.get((cls, "test"), 0)
        assert counts.get((cls, "test"), 0) == round(0.2 * n)
    b = churn_model.stratified_split(m.repartition(7))
    key = lambda df: sorted(df.where("split = 'test'").select("customer_unique_id").rdd.flatMap(lambda r: r).collect())
    assert key(a) == key(b)


def test_gbt_learns_planted_signal_and_scores_everyone(spark):
    split = churn_model.stratified_split(_planted(spark))
    model = churn_model.fit_churn_model(split, max_iter=20, max_depth=4)
    assert churn_model.evaluate(model, split) > 0.9
    scores = churn_model.score_customers(model, split)
    assert scores.count() == 1500
    assert scores.where(F.col("risk_level").isNull()).count() == 0


def test_drivers_sum_to_the_margin_less_the_base(spark):
    """Attributions of the scoring trees: for every customer they add up to margin - base."""
    from mercato.operators.attribution import base_margin

    m = _planted(spark, n=600)
    model = churn_model.fit_churn_model(churn_model.stratified_split(m), max_iter=8, max_depth=5)
    d = churn_model.churn_drivers(model, m, k=100)
    sums = {r[0]: r[1] for r in d.groupBy("customer_unique_id").agg(F.sum("contribution")).collect()}
    base = base_margin(churn_model.model_leaves(model))
    raw = model.pipeline.transform(m).select("customer_unique_id", "rawPrediction").collect()
    assert len(sums) == len(raw) == 600
    for r in raw:
        assert abs(sums[r[0]] - (r[1][1] - base)) < 1e-9
    # the planted rule is on recency: it leads for nearly everyone
    top = churn_model.churn_drivers(model, m, k=10)
    assert top.groupBy("customer_unique_id").count().agg(F.max("count")).first()[0] == 10
    assert top.where("driver_rank = 1 and feature = 'recency'").count() > 570
    ranked = top.groupBy("customer_unique_id").agg(F.sort_array(F.collect_list(F.struct("driver_rank", F.abs("contribution").alias("a")))).alias("x"))
    assert all(r.x[i].a >= r.x[i + 1].a for r in ranked.collect() for i in range(9))


def test_leaf_attributions_against_all_coalitions():
    """The polynomial form against the definition of the Shapley value on one small tree."""
    from itertools import combinations

    import numpy as np

    from mercato.operators.attribution import Leaf, contributions

    r = np.random.default_rng(1)
    leaves = [Leaf(float(r.normal()), np.array(f), r.normal(size=len(f)) - 1, r.normal(size=len(f)) + 1, r.uniform(0.1, 0.9, len(f)))
              for f in ([0], [1, 3], [0, 2, 3], [0, 1, 2, 3], [])]
    x = r.normal(size=(30, 4))

    def value(row, players):
        return sum(q.value * np.prod([float(lo < row[j] <= hi) if j in players else z
                                      for j, lo, hi, z in zip(q.feature, q.low, q.high, q.share)]) for q in leaves)

    got = contributions(leaves, x)
    for k, row in enumerate(x):
        for i in range(4):
            rest = [j for j in range(4) if j != i]
            want = sum(math.factorial(s) * math.factorial(3 - s) / 24 * (value(row, {*c, i}) - value(row, {*c}))
                       for s in range(4) for c in combinations(rest, s))
            assert abs(got[k, i] - want) < 1e-12


def test_forecast_recovers_trend_and_weekly_cycle():
    start = dt.date(2020, 1, 1)
    days = 400
    ds = [start + dt.timedelta(days=i) for i in range(days)]
    y = [1000 + 2.0 * i + 50 * math.sin(2 * math.pi * i / 7) for i in range(days)]
    out = forecast.fit_series(pd.DataFrame({"series": "s", "ds": ds, "y": y}))
    assert len(out) == days + forecast.HORIZON_DAYS
    fut = out[out["is_future"]]
    truth = [1000 + 2.0 * (days + j) + 50 * math.sin(2 * math.pi * (days + j) / 7)
             for j in range(1, forecast.HORIZON_DAYS + 1)]
    err = max(abs(a - b) for a, b in zip(fut["yhat"], truth))
    assert err < 0.05 * truth[-1]
    assert (out["yhat_lower"] <= out["yhat"]).all() and (out["yhat"] <= out["yhat_upper"]).all()


def test_forecast_interval_widens_and_covers_planted_breaks():
    """Series with breaks of the trend at random days: the 90 % interval covers most future days and widens."""
    import numpy as np

    day = np.array([dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(720)])
    for gap, size in ((60, 0.6), (30, 0.3), (10**9, 0.0)):
        covered, widths = [], []
        for s in range(30):
            r = np.random.default_rng(1000 + s)
            breaks = (r.random(900) < 1 / gap) * r.laplace(0, size, 900) if size else np.zeros(900)
            y = 1000 + np.cumsum(2 + np.cumsum(breaks)) + 60 * np.sin(2 * np.pi * np.arange(900) / 7) + r.normal(0, 40, 900)
            out = forecast.fit_series(pd.DataFrame({"series": f"s{s}", "ds": day, "y": y[:720]}))
            fut = out[out["is_future"]]
            covered.append(((y[720:] >= fut["yhat_lower"]) & (y[720:] <= fut["yhat_upper"])).mean())
            widths.append((fut["yhat_upper"] - fut["yhat_lower"]).to_numpy()[[0, 90, 179]])
        a, b, c = np.mean(widths, 0)
        assert 0.75 < np.mean(covered) < 0.97, (gap, np.mean(covered))
        assert a < b < c and (size == 0 or c > 3 * a)
    again = forecast.fit_series(pd.DataFrame({"series": "s29", "ds": day, "y": y[:720]}))
    assert again.equals(out)


def test_forecast_of_few_days():
    for n in (1, 2, 5, 26):
        ds = [dt.date(2020, 1, 1) + dt.timedelta(days=3 * i) for i in range(n)]
        out = forecast.fit_series(pd.DataFrame({"series": "s", "ds": ds, "y": [100.0 + i for i in range(n)]}))
        assert len(out) == n + forecast.HORIZON_DAYS and out[["yhat", "yhat_lower", "yhat_upper"]].notna().all().all()
        assert (out["yhat_lower"] <= out["yhat"]).all() and (out["yhat"] <= out["yhat_upper"]).all()
