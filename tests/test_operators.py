"""Operator properties: skew-safe numbering, fraud rules, churn pieces, totals."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.operators import churn, delivery, fraud, geo
from mercato.operators.churn_model import adjusted_probability, risk_tier
from mercato.operators.sequence import sequence_within
from mercato.plans.context import Context
from tests.conftest import SMALL


def test_sequence_within_matches_row_number_on_a_hot_group(spark):
    rnd = random.Random(7)
    # group 'hot' holds most rows; order values repeat so the tie-breaker matters
    rows = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 20)}", rnd.randint(0, 50), i, float(i % 13))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v double")
    w = Window.partitionBy("g").orderBy("t", "id")
    want = {(r["g"], r["id"]): (r["rn"], r["fv"]) for r in
            df.withColumn("rn", F.row_number().over(w))
              .withColumn("fv", F.first("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    for n in (1, 3, 16):
        got = {(r["g"], r["id"]): (r["seq"], r["first_v"]) for r in
               sequence_within(df, ["g"], ["t", "id"], first_cols=["v"], num_partitions=n).collect()}
        assert got == want
    # the property the operator relies on: range partitioning on (group, order)
    # spreads the hot group over several slices instead of one task
    slices = (df.repartitionByRange(8, "g", "t", "id").where(F.col("g") == "hot")
                .select(F.spark_partition_id().alias("p")).distinct().count())
    assert slices >= 4


def test_fraud_score_table(spark):
    df = spark.createDataFrame([(6.0, True), (6.0, False), (4.0, True), (4.0, False), (2.0, True), (None, True),
                                (5.0, True), (3.0, True)], "r double, d boolean")
    got = [r[0] for r in df.select(fraud.fraud_score("r", "d")).collect()]
    assert got == [100, 75, 50, 0, 0, 0, 100, 50]
    lv = spark.createDataFrame([(75,), (100,), (90,)], "s long").select(fraud.risk_level("s")).collect()
    assert [r[0] for r in lv] == ["High Risk", "Critical Risk", "Very High Risk"]


def test_risk_tiers_and_recency_scaling(spark):
    df = spark.createDataFrame([(1, 0.9, 40), (2, 0.65, 40), (3, 0.45, 40), (4, 0.1, 40), (5, 0.9, 0)],
                               "customer_unique_id long, p double, recency long")
    out = df.select(adjusted_probability(F.col("p"), F.col("recency")).alias("q")).select(
        "q", risk_tier(F.col("q")).alias("t")).collect()
    assert [r["t"] for r in out] == ["VERY HIGH RISK", "HIGH RISK", "MONITOR", "SAFE", "SAFE"]
    assert 0 <= out[4]["q"] <= 0.9 * 0.05


def test_purchase_gaps_against_brute_force(spark):
    fact = Context(spark, SMALL).fact
    got = {r[0]: (r[1], r[2]) for r in churn.purchase_gaps(fact).collect()}
    from mercato.operators.fact import delivered
    rows = delivered(fact).select("customer_unique_id", "purchase_date").collect()
    end = max(r[1] for r in rows)
    cutoff = end - dt.timedelta(days=90)
    per = {}
    for cust, day in rows:
        if cust is not None and day <= cutoff:
            per.setdefault(cust, []).append(day)
    assert set(per) == set(got)
    for cust, ts in per.items():
        ts.sort()
        gaps = [(b - a).days for a, b in zip(ts, ts[1:])]
        avg, std = got[cust]
        if not gaps:
            assert avg is None
            continue
        assert abs(avg - sum(gaps) / len(gaps)) < 1e-9
        if len(gaps) >= 2:
            m = sum(gaps) / len(gaps)
            var = sum((g - m) ** 2 for g in gaps) / (len(gaps) - 1)
            assert abs(std - var ** 0.5) < 1e-9
        else:
            assert std is None


def test_shares_and_loyalty_add_up(spark):
    fact = Context(spark, SMALL).fact
    cats = delivery.delay_categories(fact).collect()
    assert abs(sum(r["percentage"] for r in cats) - 100) < 0.05
    assert sum(r["row_count"] for r in delivery.delivery_time_histogram(fact).collect()) <= fact.count()
    from mercato.operators.customers import customer_loyalty
    row = customer_loyalty(fact).first()
    assert row["repeat_customers"] + row["single_customers"] == row["total_customers"]
    nat = {}
    for r in geo.state_vs_national(fact).collect():
        nat[r["category"]] = r["national_pct"]
    assert all(0 <= v <= 100 for v in nat.values())


def test_date_range_filter_is_inclusive(spark):
    from mercato.operators.fact import date_range
    df = spark.createDataFrame([(dt.date(2020, 1, d), f"2020-01") for d in (1, 2, 3)],
                               "purchase_date date, purchase_month string")
    assert date_range(df, "2020-01-02", "2020-01-03").count() == 2
    assert date_range(df).count() == 3


def test_reordered_fact_equals_naive_left_join_chain(spark):
    """build_fact reorders the joins for scale; it must equal the plain chain
    items -> orders -> customers -> products -> sellers -> payments -> reviews."""
    from mercato.operators.clean import clean
    from mercato.operators.fact import build_fact
    from mercato.sources.binding import derived_translation
    ctx = Context(spark, SMALL)
    cl = clean(ctx.src, translation_builder=derived_translation)
    naive = (cl.order_items
             .join(cl.orders, "order_id", "left")
             .join(cl.customers, "customer_id", "left")
             .join(cl.products, "product_id", "left")
             .join(cl.sellers, "seller_id", "left")
             .join(cl.payments_agg, "order_id", "left")
             .join(cl.reviews, "order_id", "left"))
    cols = ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "customer_id",
            "order_status", "customer_unique_id", "category", "seller_state", "payment_value", "payment_type",
            "review_no", "review_score", "review_comment_message"]
    fast = build_fact(cl).select(*cols)
    assert fast.count() == naive.count()
    assert fast.exceptAll(naive.select(*cols)).count() == 0
    assert naive.select(*cols).exceptAll(fast).count() == 0
    # undelivered orders keep their payments and reviews
    undelivered = fast.where(F.col("order_status").isNull() & F.col("payment_value").isNotNull())
    assert undelivered.count() > 0


def test_salted_left_join_equals_plain_left_join(spark):
    from mercato.operators.skew import hot_keys, salted_left_join
    rnd = random.Random(11)
    big = spark.createDataFrame(
        [("hot" if i % 2 == 0 else (None if i % 97 == 0 else f"k{rnd.randint(0, 300)}"), i, rnd.random())
         for i in range(4000)], "k string, id int, v double")
    small = spark.createDataFrame(
        [("hot", 1, "a"), ("hot", 2, "b")] + [(f"k{j}", j, "x") for j in range(0, 300, 2)] + [("zzz", 0, "y")],
        "k string, r int, s string")
    assert [r[0] for r in hot_keys(big.select("k"), "k", rows_per_salt=250).collect()] == ["hot"]
    want = big.join(small, "k", "left")
    got = salted_left_join(big, small, "k", rows_per_salt=250)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0
    assert want.select(*got.columns).exceptAll(got).count() == 0


def test_sketched_counts_are_within_two_percent_of_the_exact_ones(spark):
    from mercato.plans.catalog import RANGE_END, RANGE_START
    from tests.conftest import MEDIUM

    ctx = Context(spark, MEDIUM)
    for start, end in ((None, None), (RANGE_START, RANGE_END)):
        exact = {r.customer_state: r for r in geo.sales_by_state(ctx.fact, start, end).collect()}
        got = geo.sales_by_state_approx(ctx.sketches, start, end).collect()
        assert {r.customer_state for r in got} == set(exact) and len(got) > 20
        for r in got:
            e = exact[r.customer_state]
            assert r.total_revenue == e.total_revenue
            assert abs(r.total_orders - e.total_orders) <= 0.02 * e.total_orders
            assert abs(r.unique_customers - e.unique_customers) <= 0.02 * e.unique_customers
    assert "/fact/" not in geo.sales_by_state_approx(ctx.sketches)._jdf.queryExecution().executedPlan().toString()


def test_results_come_in_the_dashboard_s_order(spark):
    """Sorted views keep their order; ties go by name."""
    from mercato.operators import customers, sales

    fact = Context(spark, SMALL).fact

    def ordered(df, key):
        rows = df.collect()
        assert len(rows) > 2 and rows == sorted(rows, key=key)

    ordered(geo.sales_by_state(fact), lambda r: (-r.total_revenue, r.customer_state))
    ordered(geo.customer_distribution(fact), lambda r: (-r.unique_customers, r.customer_state))
    ordered(geo.seller_performance(fact), lambda r: (-r.total_revenue, r.seller_state))
    ordered(customers.payment_analysis(fact), lambda r: (-r.total_revenue, r.payment_type))
    ordered(sales.seasonal_segmentation(fact), lambda r: (r.purchase_quarter, -r.sales_volume, r.category))
    top = geo.state_top_categories(fact).collect()
    per = {}
    for r in top:
        per.setdefault(r.customer_state, []).append(r.revenue_rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
