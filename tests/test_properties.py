"""Property tests: the column rules against independent Python oracles.

Each hypothesis example is a batch of values evaluated in one Spark job.
"""

import datetime as dt
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.functions.rules import bin_index, day_diff, half_even_pct
from mercato.operators.delivery import DELAY_EDGES, DELIVERY_EDGES

SETTINGS = settings(max_examples=8, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10 ** 7), st.integers(1, 10 ** 7)), min_size=1, max_size=300))
def test_half_even_pct_matches_decimal(spark, pairs):
    pairs = [(min(p, t), t) for p, t in pairs]
    df = spark.createDataFrame(pairs, "p long, t long")
    got = [r[0] for r in df.select(half_even_pct(F.col("p"), F.col("t"), 2)).collect()]
    want = [float((Decimal(p) * 100 / Decimal(t)).quantize(Decimal("0.01"), rounding=ROUND_HALF_EVEN))
            for p, t in pairs]
    assert got == want


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-150, 150)), min_size=1, max_size=300),
       st.sampled_from([DELIVERY_EDGES, DELAY_EDGES]))
def test_bins_match_pandas_cut(spark, values, edges):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = [r[0] for r in df.select(bin_index("x", edges)).collect()]
    codes = pd.cut(pd.Series(values, dtype="float64"), bins=edges, labels=False)
    want = [None if pd.isna(c) else int(c) for c in codes]
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(-10 ** 7, 10 ** 7), st.integers(-10 ** 7, 10 ** 7)), min_size=1,
                max_size=300))
def test_day_diff_is_floored_timedelta_days(spark, offsets):
    base = dt.datetime(2018, 6, 1)
    rows = [(base + dt.timedelta(seconds=a), base + dt.timedelta(seconds=b)) for a, b in offsets]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(day_diff("a", "b")).collect()]
    want = [(a - b).days for a, b in rows]  # timedelta.days floors, like pandas .dt.days
    assert got == want
