"""Revenue forecasts for many series at once (FC2) and their KPIs (FC3).

The studied code fits one Bayesian additive model (trend + yearly + weekly
seasonality, 90 % interval, 180 days ahead) to the total daily revenue on one
machine.  Here Spark aggregates the fact to (series, ds, y) - total, per
category, per state - and ``groupBy('series').applyInPandas`` fits every
series in parallel: a piecewise-linear trend plus Fourier terms (yearly order 10,
weekly order 3), fitted with numpy by maximum a posteriori with a Laplace prior on
the trend's breaks, whose scale is estimated with them.  The interval is simulated:
noise, the spread of the coefficients, and breaks after the last day at the rate and
size of those before it, so it widens with the horizon.  A group is one series' daily
points, bounded by the calendar (a few thousand rows), whatever the data volume.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.rules import keyed, money, nz_sum
from mercato.operators.fact import delivered

HORIZON_DAYS = 180
INTERVAL = 0.90
YEARLY_ORDER, WEEKLY_ORDER = 10, 3
N_CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.95
# Prior scales, in units of the greatest |y| and of the whole span.
LEVEL_SCALE, SEASON_SCALE, FIRST_BREAK_SCALE = 5.0, 10.0, 0.05
ROUNDS, SAMPLES = 25, 500

FORECAST_SCHEMA = "series string, ds date, yhat double, yhat_lower double, yhat_upper double, is_future boolean"


def daily_series(fact: DataFrame, by: tuple[str, ...] = ("total", "category", "customer_state")) -> DataFrame:
    """(series, ds, y): delivered revenue per day for the total and for each
    value of the given dimensions, in one aggregate over an exploded key."""
    rows = keyed(delivered(fact), "purchase_date")
    keys = []
    for d in by:
        if d == "total":
            keys.append(F.lit("total"))
        else:
            keys.append(F.when(F.col(d).isNotNull(), F.concat(F.lit(d + "="), F.col(d))))
    rows = rows.withColumn("series", F.explode(F.array(*keys))).where(F.col("series").isNotNull())
    return rows.groupBy("series", F.col("purchase_date").alias("ds")).agg(money(nz_sum("payment_value")).alias("y"))


def _design(t: np.ndarray, changepoints: np.ndarray, days: np.ndarray,
            seasonalities=((YEARLY_ORDER, 365.25), (WEEKLY_ORDER, 7.0))) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - c) for c in changepoints]
    for order, period in seasonalities:
        for k in range(1, order + 1):
            ang = 2.0 * np.pi * k * days / period
            cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def _posterior(X: np.ndarray, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, root of their covariance, noise, break size): columns 2 to 2 + k are the breaks.  The
    Laplace prior is a normal one whose precision follows the size of each break, a few rounds over."""
    p = X.shape[1]
    size, scale, noise = np.full(k, FIRST_BREAK_SCALE), FIRST_BREAK_SCALE, max(z.std(), 1e-6)
    gram, xz = X.T @ X, X.T @ z
    for _ in range(ROUNDS):
        precision = np.full(p, LEVEL_SCALE**-2)
        precision[2:2 + k] = 1 / (scale * np.maximum(size, 1e-6))
        precision[2 + k:] = SEASON_SCALE**-2
        value, vector = np.linalg.eigh(gram / noise**2 + np.diag(precision))
        value = np.maximum(value, precision.min())  # rounding can take it below, even below 0
        beta = vector @ (vector.T @ (xz / noise**2) / value)
        noise = max(float(np.sqrt(((z - X @ beta) ** 2).sum() / max(len(z) - 1, 1))), 1e-6)
        size = np.sqrt(beta[2:2 + k] ** 2 + (vector[2:2 + k] ** 2 / value).sum(1))
        scale = max(size.mean(), 1e-4) if k else scale
    return beta, vector / np.sqrt(value), noise, float(np.sqrt((size**2).mean())) if k else 0.0


def _future_breaks(rng: np.random.Generator, horizon: int, rate: float, size: float) -> np.ndarray:
    """(samples, days): what breaks after the last day add, per unit of slope; ``rate`` breaks a day."""
    n = rng.poisson(rate, (SAMPLES, horizon))
    step = np.zeros((SAMPLES, horizon))
    for i in range(n.max(initial=0)):
        step += np.where(n > i, rng.laplace(0.0, size, (SAMPLES, horizon)), 0.0)
    return np.cumsum(np.cumsum(step, 1), 1)


def fit_series(pdf: pd.DataFrame, horizon: int = HORIZON_DAYS, interval: float = INTERVAL,
               yearly: bool = True, weekly: bool = True) -> pd.DataFrame:
    """Fit one series and predict its history plus ``horizon`` days."""
    seasonalities = tuple(sp for on, sp in ((yearly, (YEARLY_ORDER, 365.25)), (weekly, (WEEKLY_ORDER, 7.0))) if on)
    series = pdf["series"].iloc[0]
    pdf = pdf.sort_values("ds")
    ds = pd.to_datetime(pdf["ds"]).to_numpy()
    y = pdf["y"].to_numpy(dtype=float)
    start = ds[0]
    days = ((ds - start) / np.timedelta64(1, "D")).astype(float)
    span = max(days[-1], 1.0)
    cps = np.linspace(0, CHANGEPOINT_RANGE, N_CHANGEPOINTS + 1)[1:] if len(y) > N_CHANGEPOINTS else np.array([])
    X = _design(days / span, cps, days, seasonalities)
    scale = max(np.abs(y).max(), 1.0)
    beta, root, noise, size = _posterior(X, y / scale, len(cps))

    all_days = np.concatenate([days, days[-1] + np.arange(1, horizon + 1, dtype=float)])
    Xa = _design(all_days / span, cps, all_days, seasonalities)
    yhat = Xa @ beta
    # equal series give equal bounds, wherever they are worked on
    rng = np.random.default_rng(zlib.crc32(str(series).encode()))
    drift = (Xa @ (root @ rng.normal(size=(len(beta), SAMPLES)))).T
    drift[:, len(days):] += _future_breaks(rng, horizon, len(cps) / CHANGEPOINT_RANGE / span, size) / span
    drift += rng.normal(0.0, noise, drift.shape)
    low, high = np.quantile(drift, [(1 - interval) / 2, 1 - (1 - interval) / 2], axis=0)
    return pd.DataFrame({
        "series": series,
        "ds": pd.to_datetime(start + all_days.astype("timedelta64[D]")).date,
        "yhat": yhat * scale,
        "yhat_lower": (yhat + np.minimum(low, 0.0)) * scale,
        "yhat_upper": (yhat + np.maximum(high, 0.0)) * scale,
        "is_future": np.r_[np.zeros(len(days), bool), np.ones(horizon, bool)],
    })


def revenue_forecast(fact: DataFrame, by: tuple[str, ...] = ("total", "category", "customer_state"),
                     horizon: int = HORIZON_DAYS, interval: float = INTERVAL, yearly: bool = True,
                     weekly: bool = True) -> DataFrame:
    """FC2: history + ``horizon``-day forecast for every series (defaults: the
    studied settings - 180 days, 90 % interval, yearly and weekly terms)."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return fit_series(pdf, horizon, interval, yearly, weekly)
    return daily_series(fact, by).groupBy("series").applyInPandas(fit, FORECAST_SCHEMA)


def forecast_metrics(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """FC3 per series: forecast days after the last actual day, their total,
    growth % of the last forecast day over the last actual value, and the
    month with the largest forecast total ('MMM yyyy', earliest on a tie)."""
    last = actual.groupBy("series").agg(F.max("ds").alias("last_ds"), F.max_by("y", "ds").alias("last_y"))
    fut = forecast.join(last, "series").where(F.col("ds") > F.col("last_ds"))
    # one pass over the forecast, so that no series is fitted twice
    months = fut.groupBy("series", F.trunc("ds", "MM").alias("month")).agg(
        F.sum("yhat").alias("month_yhat"), F.count(F.lit(1)).alias("days"), F.max("ds").alias("last_day"),
        F.max_by("yhat", "ds").alias("last_yhat"), F.first("last_y").alias("last_y"))
    kpis = months.groupBy("series").agg(
        F.sum("days").alias("forecast_days"),
        F.round(F.sum("month_yhat"), 2).alias("total_forecast"),
        F.max_by("last_yhat", "last_day").alias("final_forecast"),
        F.first("last_y").alias("last_actual"),
        F.min_by(F.struct("month", "month_yhat"), F.struct(-F.col("month_yhat"), F.col("month"))).alias("p"))
    return kpis.select(
        "series", "forecast_days", "total_forecast",
        (F.try_divide(F.col("final_forecast") - F.col("last_actual"), F.col("last_actual")) * 100)
         .alias("predicted_growth_pct"),
        F.date_format("p.month", "MMM yyyy").alias("peak_month"),
        F.round("p.month_yhat", 2).alias("peak_revenue"))
