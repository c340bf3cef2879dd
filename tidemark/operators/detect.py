"""Spike and drop flags against a trailing rolling band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import time_position
from ..plans.rolling import Roll, ordered_features
from ..session import IDX, SERIES, TS


def rolling_band(
    df: DataFrame, col: str = "predicted", rows: int = 24, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX
) -> DataFrame:
    """Add ``band_mean`` and ``band_std``: mean and sample std of ``col`` over the last ``rows`` rows."""
    d = df if idx in df.columns else time_position(df, ts, keys, idx)
    d = ordered_features(d, rolls=[Roll(col, rows, (("mean", "band_mean"), ("std", "band_std")))], keys=keys, idx=idx)
    return d if idx in df.columns else d.drop(idx)


def detect_spikes(
    df: DataFrame, threshold: float = 3.0, col: str = "predicted", rows: int = 24, keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """``is_spike``: value above the trailing mean by more than ``threshold`` sample stds."""
    d = rolling_band(df, col, rows, keys, ts)
    return d.withColumn(
        "is_spike", F.coalesce(F.col(col) > F.col("band_mean") + threshold * F.col("band_std"), F.lit(False))
    ).drop("band_mean", "band_std")


def detect_drops(
    df: DataFrame, threshold: float = 3.0, col: str = "predicted", rows: int = 24, keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """``is_drop``: value below the trailing mean by more than ``threshold`` sample stds."""
    d = rolling_band(df, col, rows, keys, ts)
    return d.withColumn(
        "is_drop", F.coalesce(F.col(col) < F.col("band_mean") - threshold * F.col("band_std"), F.lit(False))
    ).drop("band_mean", "band_std")


def flag_moves(
    df: DataFrame, threshold: float = 3.0, col: str = "predicted", rows: int = 24, keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """Both flags from one rolling pass."""
    d = rolling_band(df, col, rows, keys, ts)
    up = F.col("band_mean") + threshold * F.col("band_std")
    dn = F.col("band_mean") - threshold * F.col("band_std")
    return (
        d.withColumn("is_spike", F.coalesce(F.col(col) > up, F.lit(False)))
        .withColumn("is_drop", F.coalesce(F.col(col) < dn, F.lit(False)))
    )
