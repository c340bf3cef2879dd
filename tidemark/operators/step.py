"""Time-step detection per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from ..plans.ordered import BUCKET, drop_halo, previous_time, with_halo
from ..session import IDX, SERIES, TS


def row_deltas(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX) -> DataFrame:
    """Add ``delta_seconds``: seconds since the previous row of the series (NULL on the first)."""
    since = lambda prev: ((epoch_micros(ts) - epoch_micros(prev)).cast("double") / 1e6).alias("delta_seconds")
    if idx not in df.columns:
        d = previous_time(df, ts, keys)
        return d.select(*df.columns, since("_prev_ts"))
    d = with_halo(df, 1, 0, 1 << 16, idx)
    w = Window.partitionBy(*keys, BUCKET).orderBy(idx)
    return drop_halo(d.select("*", since(F.lag(ts, 1).over(w))))


def detect_step(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """One row per series: modal step (ties -> the smaller step), whether the
    series is regular (exactly one distinct step), the mean step
    ``(last - first) / rows`` and rows per day for the modal step.
    """
    d = row_deltas(df.select(*keys, ts), keys, ts)
    # one pass over the rows: count and time span per (series, step); the first
    # row of a series has a NULL step and still counts towards rows and span
    counts = d.groupBy(*keys, "delta_seconds").agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b")
    )
    steps = counts.filter(F.col("delta_seconds").isNotNull())
    modal = steps.groupBy(*keys).agg(
        F.max_by(F.col("delta_seconds"), F.struct(F.col("_n"), -F.col("delta_seconds"))).alias("step_seconds"),
        F.count(F.lit(1)).alias("n_steps"),
    )
    span = counts.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"),
        F.min("_a").alias("first_ts"),
        F.max("_b").alias("last_ts"),
    )
    out = span.join(modal, list(keys), "left")
    return out.select(
        *keys,
        "n_rows",
        "first_ts",
        "last_ts",
        F.col("step_seconds").cast("double").alias("step_seconds"),
        F.coalesce(F.col("n_steps"), F.lit(0)).cast("long").alias("n_steps"),
        (F.coalesce(F.col("n_steps"), F.lit(0)) == 1).alias("is_regular"),
        ((epoch_micros("last_ts") - epoch_micros("first_ts")).cast("double") / 1e6 / F.col("n_rows")).alias("mean_step_seconds"),
        F.floor(F.try_divide(F.lit(86400.0), F.col("step_seconds"))).cast("long").alias("periods_per_day"),
    )
