"""One hand-made frame per semantic trap."""

import datetime as dt

from pyspark.sql import functions as F

from mercato.functions.rules import (bin_counts, day_diff, half_even_pct, keyed, ne_or_true, nz_sum,
                                     quarter_label, share_true)
from mercato.operators.clean import impute_group_median, label_categories, payments_per_order


def test_t1_day_diff_floors(spark):
    base = dt.datetime(2020, 1, 10, 12, 0)
    df = spark.createDataFrame([(base, base - dt.timedelta(hours=12)), (base, base + dt.timedelta(hours=12)),
                                (base, base - dt.timedelta(hours=36)), (base, base)],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(day_diff("b", "a")).collect()]
    assert got == [-1, 0, -2, 0]


def test_t2_bins_are_left_open_and_keep_empty_bins(spark):
    vals = [-100, -99, 0, 1, 7, 8, 14, 30, 31, 100, 101, None]
    df = spark.createDataFrame([(v,) for v in vals], "x int")
    out = {r["label"]: r["n"] for r in
           bin_counts(df, "x", [-100, 0, 7, 14, 30, 100], ["a", "b", "c", "d", "e"], "label", "n").collect()}
    # -100 and 101 and NULL fall out; (0,7] holds 1 and 7; (14,30] holds 30
    assert out == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 2}
    empty = bin_counts(df, "x", [200, 300, 400], ["p", "q"], "label", "n").collect()
    assert sorted((r["label"], r["n"]) for r in empty) == [("p", 0), ("q", 0)]


def test_t3_null_comparison_counts_as_false(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "d int")
    assert abs(df.agg(share_true(F.col("d") <= 0)).first()[0] - 1 / 3) < 1e-12


def test_t4_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, v double")
    got = dict(df.groupBy("k").agg(nz_sum("v").alias("s")).collect())
    assert got == {"a": 0, "b": 2.0}


def test_t5_null_keys_drop(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), (None,), ("b",)], "k string")
    assert sorted(r[0] for r in keyed(df, "k").groupBy("k").count().collect()) == ["a", "b"]


def test_t7_null_side_is_different(spark):
    df = spark.createDataFrame([(None, "x"), (None, None), ("x", "x"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(ne_or_true("a", "b")).collect()] == [True, True, False, True]


def test_t8_initcap_after_space_only(spark):
    df = spark.createDataFrame([("it's_home-care_3d",), (None,)], "product_category_name string")
    got = [r["category"] for r in label_categories(df, None).collect()]
    assert got == ["It's Home-care 3d", None]


def test_t9_first_payment_type_by_sequence(spark):
    df = spark.createDataFrame(
        [(1, 2, 5, "z", 1, 10.0), (1, 1, 9, "b", 3, 5.0), (1, 1, 7, "c", 2, 1.0), (2, 1, 1, None, 1, 2.0)],
        "order_id long, payment_sequential int, source_row long, payment_type string, "
        "payment_installments int, payment_value double")
    got = {r["order_id"]: (r["payment_type"], r["payment_installments"], r["payment_value"])
           for r in payments_per_order(df).collect()}
    assert got == {1: ("c", 3, 16.0), 2: (None, 1, 2.0)}


def test_t12_half_even_percentage(spark):
    # 1/8 = 12.5 % exactly; 1/800 = 0.125 % -> 0.12 (half to even); 3/800 = 0.375 % -> 0.38
    df = spark.createDataFrame([(1, 8), (1, 800), (3, 800), (0, 5), (1, 0)], "p long, t long")
    got = [r[0] for r in df.select(half_even_pct(F.col("p"), F.col("t"), 2)).collect()]
    assert got == [12.5, 0.12, 0.38, 0.0, None]


def test_a7_mode_ties_to_smallest(spark):
    from mercato.operators.churn import preferred_payment
    df = spark.createDataFrame([(1, "z"), (1, "a"), (1, "z"), (1, "a"), (1, None), (2, None)],
                               "customer_unique_id long, payment_type string")
    got = dict(preferred_payment(df).collect())
    assert got == {1: "a"}  # customer 2 has no type: the caller fills 'unknown'


def test_group_median_fill(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 4.0), ("b", None), ("c", 2.0), ("c", 3.0),
                                ("c", None)], "product_category_name string, w double")
    got = sorted((r[0], r[1]) for r in impute_group_median(df, "product_category_name", ["w"]).collect())
    assert got == [("a", 1.0), ("a", 2.5), ("a", 4.0), ("b", None), ("c", 2.0), ("c", 2.5), ("c", 3.0)]


def test_quarter_labels(spark):
    df = spark.createDataFrame([(dt.date(2020, m, 1),) for m in (1, 4, 9, 12)], "d date")
    assert [r[0] for r in df.select(quarter_label("d")).collect()] == [
        "Q1 (Jan-Mar)", "Q2 (Apr-Jun)", "Q3 (Jul-Sep)", "Q4 (Oct-Dec)"]
