"""Lags and trailing statistics over spans of time: one plan for series of any, mixed or no steps.

Where :mod:`.rolling` counts rows, the frames here are value ranges over the stamp: a lag is the value exactly so many
seconds earlier (NULL where no row has that stamp; of several rows the largest value), a trailing frame holds the rows
of ``(t - span, t]``.  On a gap-free series of any step both agree with the frames over rows, so series of different
steps need no plan each.

Rows are dealt to buckets of equal length in time, at least twice the longest reach, and the rows that a neighbour's
frames reach are copied into it, each row at most once per side (the *halo in time*).  A bucket is one task's work, so
a long series is spread over its years; a bucket holds the rows of that much time, as the frames themselves do.
Rows with a NULL position have no place in time: their lags and statistics are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timefn import epoch_micros
from ..session import SERIES, TS
from .ordered import BUCKET, HALO, drop_halo
from .rolling import _frame_stat

MICROS = 1_000_000


@dataclass(frozen=True)
class SpanLag:
    out: str
    col: str
    seconds: int


@dataclass(frozen=True)
class SpanRoll:
    """Trailing frame of ``seconds`` over ``col``; ``outs`` maps stat -> column name."""

    col: str
    seconds: int
    outs: tuple
    ddof: int = 1


def with_time_halo(df: DataFrame, position: str, back: int, fwd: int = 0, width: int | None = None) -> DataFrame:
    """Assign a bucket of ``width`` units of the long column ``position`` (twice the reach by default) and copy the rows within
    ``back`` of the next bucket and within ``fwd`` of the one before, marked as halo."""
    width = width or 2 * max(back, fwd, 1)
    if max(back, fwd) > width:
        raise ValueError("a bucket must be at least as long as the reach")
    r = F.pmod(F.col(position), F.lit(width))
    b = ((F.col(position) - r) / F.lit(width)).cast("long")
    near = [(F.lit(True), b, False)]
    if back > 0:
        near.append((r >= width - back, b + 1, True))
    if fwd > 0:
        near.append((r < fwd, b - 1, True))
    places = [F.when(test | F.lit(not halo), F.struct(place.alias("b"), F.lit(halo).alias("h"))) for test, place, halo in near]
    placed = F.explode(F.array_compact(F.array(*places))).alias("_hb")
    return df.select("*", placed).select(*df.columns, F.col("_hb.b").alias(BUCKET), F.col("_hb.h").alias(HALO))


def at_distance(value: Column, window: WindowSpec, distance: int) -> Column:
    """``value`` of the row exactly ``distance`` units later (earlier if negative), NULL without one."""
    return F.max(value).over(window.rangeBetween(distance, distance))


def span_features(
    df: DataFrame, lags: Sequence[SpanLag] = (), rolls: Sequence[SpanRoll] = (), keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """``df`` with a column per lag and per statistic of ``rolls``, all from one exchange and one order."""
    reach = max([x.seconds for x in (*lags, *rolls)] + [0]) * MICROS
    if not reach:
        return df
    d = with_time_halo(df.withColumn("_at", epoch_micros(ts)), "_at", reach)
    w = Window.partitionBy(*keys, BUCKET).orderBy("_at")
    known = lambda c: F.when(F.col("_at").isNotNull(), c)
    new = [known(at_distance(F.col(x.col), w, -x.seconds * MICROS)).alias(x.out) for x in lags]
    new += [
        known(_frame_stat(stat, F.col(x.col), x.ddof).over(w.rangeBetween(1 - x.seconds * MICROS, 0))).alias(out)
        for x in rolls
        for stat, out in x.outs
    ]
    return drop_halo(d.select("*", *new)).drop("_at")
