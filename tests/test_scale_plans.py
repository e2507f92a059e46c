"""Shapes that must hold at scale: exact medians by counting, the fact's shuffles, numbering without a sort."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.operators import fraud
from mercato.operators.clean import PRODUCT_NUMERIC, clean
from mercato.operators.fact import FACT_COLUMNS, build_fact
from mercato.operators.medians import group_medians
from mercato.operators.sequence import sequence_by_time
from mercato.plans.context import Context
from mercato.sources.binding import derived_translation
from tests.conftest import SMALL


@pytest.mark.parametrize("limit", [100_000, 60, 0])
def test_seven_medians_with_one_group_of_half_the_rows(spark, limit):
    r = np.random.default_rng(4)
    n = 1500
    g = np.where(r.random(n) < 0.5, "hot", np.char.add("g", r.integers(0, 12, n).astype(str))).astype(object)
    g[:40] = None
    cols = {
        "flat": r.normal(size=n), "ties": r.integers(0, 3, n).astype(float), "one": np.full(n, 7.25),
        "wide": np.exp(r.normal(size=n) * 40) * r.choice([-1, 1], n), "skew": np.r_[np.zeros(n - 200), r.normal(size=200) * 1e12],
        "holes": np.where(r.random(n) < 0.7, np.nan, r.random(n)), "huge": r.choice([-1.7e308, 1.7e308, 0.0, 5e-324], n)}
    rows = [(k, *[None if (name == "holes" and np.isnan(v)) else float(v) for name, v in zip(cols, vs)]) for k, *vs in zip(g, *cols.values())]
    rows += [("empty", *[None] * 7), ("nan", *[float("nan")] * 7)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in cols))
    got = {x["g"]: x for x in group_medians(df, "g", list(cols), limit).collect()}
    want = pd.DataFrame({"g": g, **cols}).fillna({"g": "none"}).groupby("g")
    assert set(got) == {None, "hot", "empty", "nan", *(f"g{i}" for i in range(12))}
    for name, part in want:
        for c in cols:
            v = np.sort(part[c].dropna().to_numpy())
            a, b = v[(len(v) - 1) // 2], v[len(v) // 2]
            m = a if a == b else 0.5 * a + 0.5 * b
            assert got[None if name == "none" else name][f"__med_{c}"] == m, (name, c)
    assert all(got[k][f"__med_{c}"] is None for k in ("empty", "nan") for c in cols)


def test_fact_has_all_columns_and_one_shuffle_of_the_items_by_order(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    cl = clean(Context(spark, SMALL).src, translation_builder=derived_translation)
    assert cl.hot_orders is None  # no salts on small data
    try:
        # the plan where only the bounded nation table is broadcast
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = build_fact(clean(Context(spark, SMALL).src, translation_builder=derived_translation))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert df.columns == FACT_COLUMNS and set(PRODUCT_NUMERIC) < set(df.columns)
    exchanges = re.findall(r"Exchange hashpartitioning\(order_id#\d+L, \d+\)", plan)
    assert len(exchanges) == 4  # items, orders, payments and reviews, once each
    assert "__salt" not in plan


def test_fact_with_hot_orders_equals_the_plain_one(spark, monkeypatch):
    from mercato.operators import clean as clean_module

    plain = build_fact(clean(Context(spark, SMALL).src, translation_builder=derived_translation))
    hot_keys = clean_module.hot_keys
    monkeypatch.setattr(clean_module, "hot_keys", lambda keys, key: hot_keys(keys, key, rows_per_salt=4))
    cl = clean(Context(spark, SMALL).src, translation_builder=derived_translation)
    hot = cl.hot_orders
    assert hot is not None and hot.agg(F.max("__salts")).first()[0] > 1
    salted = build_fact(cl)
    assert salted.count() == plain.count() and salted.exceptAll(plain).count() == 0


def test_numbering_by_time_matches_row_number(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 30)}",
             None if rnd.random() < 0.05 else f"20{rnd.randint(10, 12)}-0{rnd.randint(1, 3)}-1{rnd.randint(0, 9)} 0{rnd.randint(0, 2)}:0{rnd.randint(0, 1)}:00.{rnd.randint(0, 2)}",
             i, float(i % 13)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, t string, id int, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    w = Window.partitionBy("g").orderBy(F.asc_nulls_first("t"), "id")
    want = {r["id"]: (r["n"], r["fv"]) for r in df.withColumn("n", F.row_number().over(w)).withColumn("fv", F.first("v").over(w)).collect()}
    out = sequence_by_time(df, "g", "t", ["t", "id"], first_cols=["v"])
    assert {r["id"]: (r["seq"], r["first_v"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_fraud_without_numbers_agrees_with_the_numbered_pairs(spark):
    fact = Context(spark, SMALL).fact
    cases = fraud.fraud_cases(fact)
    assert fraud.fraud_count(fact).first()[0] == cases.count() > 0
    want = cases.orderBy(F.desc("value_ratio"), "customer_unique_id", "order_sequence").limit(20).select(*fraud.TOP_COLUMNS)
    assert fraud.fraud_top(fact).collect() == want.collect()
    for df in (fraud.fraud_count(fact), fraud.fraud_top(fact), cases):
        assert "rangepartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_fact_is_written_without_a_shuffle_by_month(spark, tmp_path):
    from mercato.sources.io import write_fact

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(0, 600, 1, 3).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("1996-0"), F.col("id") % 3)).alias("purchase_month"))
    write_fact(df, str(tmp_path / "fact"))
    months = sorted(p for p in (tmp_path / "fact").iterdir() if p.name.startswith("purchase_month="))
    # every task wrote its own rows of every month, the missing one too
    assert [len(list(p.glob("*.parquet"))) for p in months] == [3, 3, 3]
    assert spark.read.parquet(str(tmp_path / "fact")).select("id", "purchase_month").exceptAll(df).count() == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_fact_of_many_rows_has_more_partitions_by_order(spark, monkeypatch):
    from mercato.operators import skew

    plain = build_fact(clean(Context(spark, SMALL).src, translation_builder=derived_translation))
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 300)
    cl = clean(Context(spark, SMALL).src, translation_builder=derived_translation)
    n = cl.order_partitions
    assert n == -(-cl.src.order_items.count() // 300) and n > int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = build_fact(cl)
    assert f", {n})" in many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == plain.count() and many.exceptAll(plain).count() == 0


def test_hot_keys_counts_single_keys_only_in_large_slots(spark):
    from mercato.operators.skew import hot_keys

    rows = [(k,) for k in range(300) for _ in range(3)] + [(7,)] * 50 + [(None,)] * 90 + [(9,)] * 20
    df = spark.createDataFrame(rows, "k int")
    assert sorted(hot_keys(df, "k", rows_per_salt=20).collect()) == [(7, 3), (9, 2)]
    assert hot_keys(df, "k", rows_per_salt=60).count() == 0
    plan = hot_keys(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "__slot" in plan


def test_forecast_kpis_read_the_forecast_once(spark):
    import datetime as dt

    from mercato.operators.forecast import forecast_metrics

    day = dt.date(1998, 1, 30)
    actual = spark.createDataFrame([("a", day, 4.0), ("b", day, 0.0)], "series string, ds date, y double")
    given = spark.createDataFrame([(s, day + dt.timedelta(i), v * i) for s, v in (("a", 1.0), ("b", 2.0)) for i in range(0, 4)],
                                  "series string, ds date, yhat double").repartition(2, "series")
    seen = spark.sparkContext.accumulator(0)

    def fit(pdf):
        seen.add(1)
        return pdf

    got = forecast_metrics(actual, given.groupBy("series").applyInPandas(fit, given.schema)).orderBy("series").collect()
    assert [tuple(r) for r in got] == [("a", 3, 6.0, -25.0, "Feb 1998", 5.0), ("b", 3, 12.0, None, "Feb 1998", 10.0)]
    assert seen.value == 2  # one fit a series
