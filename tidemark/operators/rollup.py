"""Daily roll-up of forecast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SERIES, TS


def day_start(ts: str = TS):
    """Midnight of the stamp's day, as a time stamp."""
    return F.to_date(F.col(ts)).cast("timestamp_ntz")


def aggregate_daily(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Mean of ``predicted`` and ``actual`` per day; ``lower`` and ``upper`` too when
    both are present.  One group-by (partial aggregation before the shuffle).
    """
    cols = ["predicted", "actual"] + (["lower", "upper"] if {"lower", "upper"} <= set(df.columns) else [])
    return df.groupBy(*keys, day_start(ts).alias(TS)).agg(*[F.avg(c).alias(c) for c in cols])
