"""Regular time grids generated on the executors.

A grid of ``n`` points is produced in two explode steps - first chunk ids,
spread over the cluster by an explicit repartition, then the points of each
chunk - so one very long series never materialises as one array in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from ..session import IDX, SERIES, TS

GRID_CHUNK = 1 << 18


def dense_grid(
    bounds: DataFrame,
    step_seconds: int,
    keys: Sequence[str] = (SERIES,),
    start: str = "t0",
    end: str = "t1",
    chunk: int = GRID_CHUNK,
    ts: str = TS,
    idx: str = IDX,
) -> DataFrame:
    """``keys, idx, ts`` for ``ts = start + idx * step`` up to ``end`` (inclusive).

    ``bounds`` has one row per key with columns ``start`` and ``end``.
    """
    step_us = int(step_seconds) * 1_000_000
    n = (F.floor((epoch_micros(end) - epoch_micros(start)) / F.lit(step_us)) + 1).cast("long")
    nparts = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (
        bounds.select(*keys, F.col(start).alias("_t0"), n.alias("_n"))
        .filter(F.col("_n") > 0)
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(chunk)).cast("long"))))
        .repartition(nparts, *keys, "_c")
    )
    pts = chunks.withColumn(
        idx,
        F.explode(F.sequence(F.col("_c") * chunk, F.least(F.col("_n"), (F.col("_c") + 1) * chunk) - 1)),
    )
    return pts.select(*keys, F.col(idx), F.timestamp_add("MICROSECOND", F.col(idx) * F.lit(step_us), F.col("_t0")).alias(ts))


def forecast_dates(starts: DataFrame, days: int = 30, keys: Sequence[str] = (SERIES,), start: str = "start") -> DataFrame:
    """Hourly stamps from ``start`` (included) for ``days`` days: ``days * 24`` rows per key."""
    b = starts.select(*keys, F.col(start).alias("t0"), F.timestamp_add("HOUR", F.lit(days * 24 - 1), F.col(start)).alias("t1"))
    return dense_grid(b, 3600, keys).withColumnRenamed(IDX, "h")


def future_grid(
    series: DataFrame,
    horizon_days: int,
    step_seconds: int | DataFrame,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
) -> DataFrame:
    """The ``horizon_days * 86400 / step`` (rounded down) stamps after each series' last stamp (start excluded).

    Returns ``keys, h, ts`` with ``h = 0, 1, ...`` the future row number.
    ``step_seconds`` is a constant or a DataFrame ``keys, step_seconds``
    (e.g. from :func:`tidemark.operators.step.detect_step`).
    """
    last = series.groupBy(*keys).agg(F.max(ts).alias("_last"))
    if isinstance(step_seconds, DataFrame):
        last = last.join(step_seconds.select(*keys, "step_seconds"), list(keys))
        step = F.col("step_seconds")
    else:
        step = F.lit(int(step_seconds))
    n = F.floor(F.lit(int(horizon_days) * 86400) / step).cast("long")
    b = last.select(*keys, "_last", step.alias("_step"), n.alias("_n")).filter(F.col("_n") > 0)
    nparts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = b.withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / F.lit(GRID_CHUNK)).cast("long")))
    ).repartition(nparts, *keys, "_c")
    pts = chunks.withColumn(
        "h", F.explode(F.sequence(F.col("_c") * GRID_CHUNK, F.least(F.col("_n"), (F.col("_c") + 1) * GRID_CHUNK) - 1))
    )
    return pts.select(
        *keys,
        F.col("h"),
        F.timestamp_add("SECOND", (F.col("h") + 1) * F.col("_step"), F.col("_last")).alias(ts),
    )
