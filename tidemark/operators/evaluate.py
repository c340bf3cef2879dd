"""Forecast evaluation: naive forecast, error metrics, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import time_position
from ..plans.rolling import Lag, ordered_features
from ..session import IDX, SERIES, TS

# Fixed value: float64 machine epsilon, the floor of |actual| in MAPE.
EPS = 2.220446049250313e-16


def naive_forecast(df: DataFrame, col: str = "actual", keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Add ``naive``: previous row's ``col``; the first row takes its own value."""
    d = df if IDX in df.columns else time_position(df, ts, keys, IDX)
    d = ordered_features(d, lags=[Lag("_prev", col, 1)], keys=keys)
    d = d.withColumn("naive", F.coalesce(F.col("_prev"), F.col(col))).drop("_prev")
    return d if IDX in df.columns else d.drop(IDX)


def forecast_metrics(
    df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """MAE, MSE, RMSE, MAPE (%), Theil's U per key over rows with an actual value.

    U = RMSE of the forecast / RMSE of the naive (previous actual) forecast;
    NULL when the naive error is 0.  One aggregation (partial before shuffle).
    """
    scored = df.filter(F.col(actual).isNotNull())
    scored = naive_forecast(scored, actual, keys, ts)
    e = F.col(predicted) - F.col(actual)
    ne = F.col("naive") - F.col(actual)
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("MAE"),
        F.avg(e * e).alias("MSE"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(actual)), F.lit(EPS))).alias("_ape"),
        F.avg(ne * ne).alias("_nmse"),
    )
    return agg.select(
        *keys,
        F.col("n").cast("long").alias("n"),
        "MAE",
        "MSE",
        F.sqrt("MSE").alias("RMSE"),
        (F.col("_ape") * 100.0).alias("MAPE"),
        F.when(F.col("_nmse") != 0, F.sqrt("MSE") / F.sqrt("_nmse")).alias("Theils_U"),
    )


def metrics_long(metrics: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Unpivot metrics to ``keys, metric, value``."""
    cols = [c for c in ("MAE", "RMSE", "MAPE", "Theils_U") if c in metrics.columns]
    return metrics.unpivot(list(keys), cols, "metric", "value")


def historical_bands(
    df: DataFrame, z: float = 1.96, keys: Sequence[str] = (SERIES,), actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """``lower``/``upper`` = predicted -/+ z * population std of (actual - predicted) of the key."""
    sd = df.filter(F.col(actual).isNotNull()).groupBy(*keys).agg(
        F.stddev_pop(F.col(actual) - F.col(predicted)).alias("_sd")
    )
    out = df.join(sd, list(keys), "left")
    return (
        out.withColumn("lower", F.col(predicted) - z * F.col("_sd"))
        .withColumn("upper", F.col(predicted) + z * F.col("_sd"))
        .drop("_sd")
    )


def future_bands(df: DataFrame, z: float = 1.96, width: float = 0.1, predicted: str = "predicted") -> DataFrame:
    """``lower``/``upper`` = predicted -/+ z * width * |predicted| (the reference's future band)."""
    s = z * width * F.abs(F.col(predicted))
    return df.withColumn("lower", F.col(predicted) - s).withColumn("upper", F.col(predicted) + s)
