"""Sources and sinks: round trips and materialise-once."""

import os

from pyspark.sql import functions as F

from mercato.operators.fact import date_range
from mercato.plans.context import Context
from mercato.sources.io import materialize, read_csv_table, write_csv, write_fact, write_parquet
from tests.conftest import SMALL


def test_fact_parquet_round_trip_and_month_pruning(spark, tmpdir_path):
    fact = Context(spark, SMALL).fact
    path = os.path.join(tmpdir_path, "fact")
    write_fact(fact, path)
    back = spark.read.parquet(path)
    assert back.count() == fact.count()
    assert any(d.startswith("purchase_month=") for d in os.listdir(path))
    sel = date_range(back, "1996-01-01", "1996-03-31")
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "purchase_month" in plan
    assert sel.count() == date_range(fact, "1996-01-01", "1996-03-31").count()


def test_csv_round_trip_with_declared_schema(spark, tmpdir_path):
    src = Context(spark, SMALL).src
    path = os.path.join(tmpdir_path, "customers_csv")
    write_csv(src.customers, path)
    back = read_csv_table(spark, path, "customers")
    assert dict(back.dtypes)["customer_zip_code_prefix"] == "string"
    assert back.exceptAll(src.customers).count() == 0 and src.customers.exceptAll(back).count() == 0


def test_materialize_builds_once(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "mat")
    calls = []

    def builder():
        calls.append(1)
        return spark.range(10).withColumn("x", F.col("id") * 2)

    a = materialize(spark, path, builder)
    b = materialize(spark, path, builder)
    assert len(calls) == 1 and a.count() == b.count() == 10
    write_parquet(spark.range(3), os.path.join(tmpdir_path, "pub"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "pub")).count() == 3


def test_churn_assets_are_built_once_and_reloaded(spark, tmpdir_path):
    from mercato.operators import churn_model
    fact = Context(spark, SMALL).fact
    root = os.path.join(tmpdir_path, "churn")
    a = churn_model.churn_assets(fact, root)
    n = a.scores.count()
    assert n == a.features.count() > 0
    stamp = os.path.getmtime(os.path.join(root, "scores", "_SUCCESS"))
    b = churn_model.churn_assets(fact, root)
    assert os.path.getmtime(os.path.join(root, "scores", "_SUCCESS")) == stamp
    assert b.scores.count() == n
    cid = b.features.agg(F.min("customer_unique_id")).first()[0]
    rep = churn_model.customer_report(b, cid).collect()
    assert len(rep) == 1 and rep[0]["risk_level"] is not None and len(rep[0]["top_drivers"]) <= 10


def test_fraud_candidates_materialize(spark, tmpdir_path):
    from mercato.operators import fraud
    fact = Context(spark, SMALL).fact
    path = os.path.join(tmpdir_path, "fraud")
    first = fraud.fraud_candidates(fact, path)
    assert first.count() == fraud.fraud_cases(fact).count()
    fraud.export_fraud_cases(fact, os.path.join(tmpdir_path, "fraud_csv"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "fraud_csv"))
    assert back.count() == first.count()


def test_analytics_agree_on_materialized_and_lazy_fact(spark, tmpdir_path):
    """The stored fact (month-partitioned; NULL months in the default
    partition; partition column read back as string) gives the same answers."""
    from mercato.operators import churn, delivery, fraud, geo, sales
    ctx = Context(spark, SMALL)
    lazy = ctx.fact
    stored = Context(spark, SMALL).materialize_fact(os.path.join(tmpdir_path, "fact"))
    assert dict(stored.dtypes)["purchase_month"] == "string"
    for op in (delivery.monthly_delay, sales.top_categories_revenue, geo.sales_by_state,
               fraud.fraud_cases, churn.churn_features):
        a, b = op(lazy), op(stored)
        assert a.exceptAll(b.select(*a.columns)).count() == 0
        assert b.select(*a.columns).exceptAll(a).count() == 0


def test_csv_by_header_name_with_text_ids_and_no_silent_nulls(spark, tmpdir_path):
    import pytest

    path = os.path.join(tmpdir_path, "products.csv")
    with open(path, "w") as f:  # another column order, extra columns, a text id
        f.write("product_name_lenght,product_weight_g,product_id,product_photos_qty,product_category_name\n"
                "40,225,1e9e8ef04dbcff4541ed26657ea517e5,1,perfumaria\n44,1000,3aa071139cb16b67ca9e5dea641aaa2f,,\n")
    rows = {r.product_id: r for r in read_csv_table(spark, path, "products").collect()}
    assert rows["1e9e8ef04dbcff4541ed26657ea517e5"].product_weight_g == 225.0
    assert rows["3aa071139cb16b67ca9e5dea641aaa2f"].product_weight_g == 1000.0
    assert rows["3aa071139cb16b67ca9e5dea641aaa2f"].product_category_name is None
    with open(path, "a") as f:
        f.write("1,heavy,x,1,toys\n")
    with pytest.raises(Exception, match="products.product_weight_g: not a double: heavy"):
        read_csv_table(spark, path, "products").collect()
    with open(path, "w") as f:
        f.write("product_id,product_weight_g\n1,2\n")
    with pytest.raises(ValueError, match="product_category_name"):
        read_csv_table(spark, path, "products")


def test_cluster_without_a_shared_folder_raises(monkeypatch):
    import types

    import pytest

    from mercato.session import checkpoint_root

    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(fake)


def test_national_share_counts_rows_without_a_state(spark):
    import datetime

    from mercato.operators.geo import state_vs_national

    day = datetime.datetime(2020, 1, 1)
    rows = [("SP", "a", 1, 100.0), ("SP", "b", 2, 100.0), (None, "a", 3, 200.0)]
    fact = spark.createDataFrame(
        [(s, c, o, v, day, day.date(), "delivered", 2020 * 100 + 1) for s, c, o, v in rows],
        "customer_state string, category string, order_id long, payment_value double, order_purchase_timestamp timestamp_ntz, "
        "purchase_date date, order_status string, purchase_month int").withColumn("payment_value", F.col("payment_value").cast("decimal(18,2)"))
    for c in Context(spark, SMALL).fact.columns:
        if c not in fact.columns:
            fact = fact.withColumn(c, F.lit(None))
    fact = fact.withColumn("order_delivered_customer_date", F.col("order_purchase_timestamp"))
    got = {r.category: r.national_pct for r in state_vs_national(fact).collect()}
    assert got == {"a": 75.0, "b": 25.0}
