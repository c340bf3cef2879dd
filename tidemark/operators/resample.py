"""Resampling onto a regular grid.

Buckets are left-closed and left-labelled, aligned on multiples of the step
since 1970-01-01 (for steps that divide a day this is the day-start origin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from ..plans.ordered import materialize
from ..sources.grids import dense_grid
from ..session import IDX, SERIES, TS
from .fill import fill_time_linear, value_columns
from .step import detect_step



def _epoch():
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def floor_to_step(ts, step_seconds: int) -> Column:
    """Start of the ``step_seconds`` bucket containing ``ts``."""
    step_us = int(step_seconds) * 1_000_000
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.floor(epoch_micros(c) / F.lit(step_us)) * F.lit(step_us), _epoch())


def on_grid(
    agg: DataFrame, step_seconds: int, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX
) -> DataFrame:
    """Left-join per-bucket rows onto the dense grid ``min(ts)..max(ts)`` of each key.

    Empty buckets are kept with NULL values; ``idx`` is the grid position.
    """
    bounds = agg.groupBy(*keys).agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    grid = dense_grid(bounds, step_seconds, keys, ts=ts, idx=idx)
    return grid.join(agg, [*keys, ts], "left")


def resample_mean(
    df: DataFrame,
    step_seconds: int,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
) -> DataFrame:
    """Mean per bucket on the dense grid; empty buckets are NULL (downsampling)."""
    cols = list(cols) if cols is not None else value_columns(df)
    agg = df.groupBy(*keys, floor_to_step(ts, step_seconds).alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])
    return on_grid(agg, step_seconds, keys, ts)


def resample_interpolate(
    df: DataFrame,
    step_seconds: int,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
) -> DataFrame:
    """Values on the grid ``floor(first)..floor(last)`` by time-linear
    interpolation between the original points (upsampling).  Points already
    on the grid keep their value.
    """
    cols = list(cols) if cols is not None else value_columns(df)
    step_us = int(step_seconds) * 1_000_000
    # the points feed the bounds, the on-grid join and the off-grid rows: store once
    pts = materialize(df.groupBy(*keys, ts).agg(*[F.avg(c).alias(c) for c in cols]))
    bounds = pts.groupBy(*keys).agg(
        floor_to_step(F.min(ts), step_seconds).alias("t0"), floor_to_step(F.max(ts), step_seconds).alias("t1")
    )
    grid = dense_grid(bounds, step_seconds, keys, ts=ts).withColumn("_g", F.lit(True))
    on = grid.join(pts, [*keys, ts], "left")
    off = (
        pts.join(bounds, list(keys))
        .withColumn(IDX, F.floor((epoch_micros(ts) - epoch_micros("t0")) / F.lit(step_us)).cast("long"))
        .filter(epoch_micros(ts) % F.lit(step_us) != 0)
        .select(*keys, IDX, ts, *cols, F.lit(False).alias("_g"))
    )
    both = materialize(on.select(*keys, IDX, ts, *cols, "_g").unionByName(off))  # the fill reads it twice
    filled = fill_time_linear(both, cols, keys, ts, IDX)
    return filled.filter(F.col("_g")).drop("_g")


def resample(
    df: DataFrame,
    step_seconds: int,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Bring every series to ``step_seconds``, choosing per series by its modal step:
    finer or equal -> bucket mean (identity on a regular series already on the
    grid), coarser -> time interpolation.  A series whose modal step is the target keeps its
    phase: its grid starts at its most frequent offset (ties: the smaller), so hourly stamps at :30 stay at :30.
    """
    cols = list(cols) if cols is not None else value_columns(df)
    steps = steps if steps is not None else detect_step(df, keys, ts)
    steps = steps.select(*keys, "step_seconds")
    step_us = int(step_seconds) * 1_000_000
    own = df.join(steps.filter(F.col("step_seconds") == float(step_seconds)).select(*keys), list(keys), "left_semi")
    offsets = own.groupBy(*keys, F.pmod(epoch_micros(ts), F.lit(step_us)).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    phase = offsets.groupBy(*keys).agg(F.max_by(F.col("_at"), F.struct(F.col("_n"), -F.col("_at"))).alias("_phase"))
    steps = steps.join(phase, list(keys), "left").withColumn("_phase", F.coalesce("_phase", F.lit(0).cast("long")))
    steps = materialize(steps)  # one row per series
    coarse = F.coalesce(F.col("step_seconds"), F.lit(0.0)) > float(step_seconds)
    # which paths are needed at all: three values reach the driver
    kinds = steps.agg(F.max(coarse.cast("int")).alias("c"), F.min(coarse.cast("int")).alias("f"), F.max("_phase").alias("p")).first()
    any_coarse, any_fine = bool(kinds["c"]), not bool(kinds["f"]) if kinds["f"] is not None else True
    tagged = df.join(steps, list(keys), "left")
    parts = []
    if any_fine:
        fine = tagged.filter(~coarse)
        if kinds["p"]:  # work on stamps moved back by the phase, and move the grid on again
            fine = fine.withColumn(ts, F.timestamp_add("MICROSECOND", -F.col("_phase"), F.col(ts)))
        fine = resample_mean(fine.drop("step_seconds", "_phase"), step_seconds, cols, keys, ts)
        if kinds["p"]:
            fine = fine.join(steps.select(*keys, "_phase"), list(keys)).withColumn(ts, F.timestamp_add("MICROSECOND", F.col("_phase"), F.col(ts))).drop("_phase")
        parts.append(fine)
    if any_coarse:
        parts.append(resample_interpolate(tagged.filter(coarse).drop("step_seconds", "_phase"), step_seconds, cols, keys, ts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resample_to_hourly(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Legacy form: :func:`resample` to one hour."""
    return resample(df, 3600, cols, keys, ts)
