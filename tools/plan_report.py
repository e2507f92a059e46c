"""Write PLANS.md: the executed physical plan of each headline analytic,
summarised (scans, pruned read schema, pushed and partition filters,
exchanges, join strategies, reuse).

usage: python tools/plan_report.py [sf_dir]   (default /root/testdata/sf0.01)
Runs over a materialised fact (month-partitioned Parquet), as the analytics
do in production; the fact build itself is summarised with automatic
broadcast off, i.e. the sort-merge plan a large cluster would run.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mercato.operators import churn, customers, delivery, forecast, fraud, geo, sales  # noqa: E402
from mercato.operators.fact import build_fact  # noqa: E402
from mercato.plans.context import Context  # noqa: E402
from mercato.session import checkpoint_root, get_spark  # noqa: E402


def summarize(plan: str) -> dict:
    return {
        "parquet scans": plan.count("FileScan parquet"),
        "checkpoint scans": len(re.findall(r"Scan ExistingRDD|LogicalRDD|ExistingRDD", plan)),
        "shuffle exchanges": len(re.findall(r"(?<!Reused)Exchange (hashpartitioning|rangepartitioning|"
                                            r"SinglePartition|RoundRobinPartitioning)", plan)),
        "reused exchanges": plan.count("ReusedExchange"),
        "broadcast hash joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "windows": len(re.findall(r"\bWindow\b|WindowGroupLimit", plan)),
        "python (applyInPandas)": plan.count("FlatMapGroupsInPandas"),
        "read schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:,|\n|$)", plan))),
        "pushed filters": sorted(set(re.findall(r"PushedFilters: (\[[^\n]*?\])", plan))),
        "partition filters": sorted(set(f for f in re.findall(r"PartitionFilters: (\[[^\n]*?\])", plan) if f != "[]")),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(8, extra={"spark.sql.maxMetadataStringLength": "2000"})
    root = checkpoint_root(spark)
    ctx = Context(spark, sf)
    lines = ["# PLANS", "",
             f"Executed physical plans (after AQE) of the headline analytics, over the fact materialised "
             f"as month-partitioned Parquet from `{sf}`. Generated by `tools/plan_report.py`; counts are "
             "taken from the final plan, so AQE's runtime choices (broadcast conversion, reuse) are included.",
             ""]

    # The fact build as a large cluster would plan it: no automatic broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    fb = build_fact(ctx.clean)
    fb.write.format("noop").mode("overwrite").save()
    s = summarize(fb._jdf.queryExecution().executedPlan().toString())
    lines += ["## build_fact (automatic broadcast off: the at-scale sort-merge plan)", ""]
    lines += [f"- {k}: {v}" for k, v in s.items() if not isinstance(v, list)]
    lines += [""]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    fact = ctx.fact
    cases = {
        "top_categories_revenue": sales.top_categories_revenue(fact),
        "revenue_by_category (date range)": sales.revenue_by_category(fact, start="1996-01-01", end="1997-06-30"),
        "seasonal_segmentation": sales.seasonal_segmentation(fact),
        "customer_loyalty": customers.customer_loyalty(fact),
        "sales_by_state": geo.sales_by_state(fact),
        "seller_performance": geo.seller_performance(fact),
        "city_analysis": geo.city_analysis(fact),
        "state_vs_national": geo.state_vs_national(fact),
        "delivery_kpis (date range)": delivery.delivery_kpis(fact, start="1996-01-01", end="1997-06-30"),
        "delay_categories": delivery.delay_categories(fact),
        "fraud_cases": fraud.fraud_cases(fact),
        "churn_features": churn.churn_features(fact),
        "revenue_forecast": forecast.revenue_forecast(fact),
    }
    for name, df in cases.items():
        df.write.format("noop").mode("overwrite").save()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        lines += [f"## {name}", ""]
        for k, v in s.items():
            if isinstance(v, list):
                for item in v:
                    lines.append(f"- {k}: `{item[:220]}`")
            else:
                lines.append(f"- {k}: {v}")
        lines.append("")
    notes = [
        "## Reading the counts", "",
        "- Read schemas list only the columns each analytic uses; filters on `order_status` and the date reach the",
        "  Parquet reader, and date ranges prune `purchase_month=` directories (partition filters).",
        "- `churn_features` reads its checkpointed (customer, order) table instead of re-scanning the fact.",
        "- Broadcast joins in these plans are AQE runtime conversions of small aggregated sides or explicit",
        "  broadcasts of fixed-size tables (histogram bins, one-row maxima).",
        "- `build_fact` without automatic broadcast: products and sellers are sort-merge joined; items, orders, payments",
        "  and reviews are each shuffled once by order_id. The hot-order count ran before the plan and found none.",
        "",
    ]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines + notes))
    spark.stop()


if __name__ == "__main__":
    main()
