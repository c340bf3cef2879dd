"""Additive seasonal decomposition with linear trend ends.

Period ``p`` = 7 days of rows, ``h = p // 2``.
Per series of ``n`` rows (``idx`` 0..n-1, dense, no NULL price):

* trend at ``h <= i < n-h``: centred moving average (for an even period with half
  weight on the two end rows), from running sums (O(1) per row) in bucketed windows;
* trend ends: least-squares line through the trend rows
  ``[h, min(h+p, n-h-1))`` (left) and ``[max(h, n-h-1-p), n-h-1)`` (right),
  extended to the missing rows (statsmodels ``extrapolate_trend='freq'``);
* seasonal: mean of ``price - trend`` per phase ``i % p``, centred to zero
  mean over the phases (a table of ``p`` rows per series);
* residual = price - trend - seasonal.

Series shorter than ``2p`` rows get no decomposition rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import BUCKET, bucket_rows_for, drop_halo, materialize, with_halo
from ..plans.spans import MICROS, at_distance, with_time_halo
from ..session import IDX, PRICE, SERIES, TS


# Periods up to this many rows use the sliding frame sum, longer ones running sums.
FRAME_SUM_MAX = 512


def season_rows(step_seconds: int) -> int:
    """Rows in seven days; 0 where the step does not divide them, and then there is no decomposition."""
    rows, rest = divmod(7 * 86400, int(step_seconds))
    return 0 if rest else rows


def decompose(
    df: DataFrame,
    step_seconds: int = 3600,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    col: str = PRICE,
    period: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    p = int(period or season_rows(step_seconds))
    base = df.select(*keys, ts, idx, col)
    if p < 2:
        return base.select("*", *[F.lit(None).cast("double").alias(c) for c in ("trend", "seasonal", "residual")]).limit(0)
    h = p // 2
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = base.join(n.filter(F.col("_n") >= 2 * p), list(keys))

    # centred moving average from running sums inside halo buckets
    B = bucket_rows_for(h + 1, h)
    d = with_halo(d, h + 1, h, B, idx)
    w = Window.partitionBy(*keys, BUCKET).orderBy(idx)
    whole = Window.partitionBy(*keys, BUCKET)
    if p <= FRAME_SUM_MAX:
        # short period: Spark's frame sum (p+1 additions per row, most exact)
        d = d.withColumn("_c0", F.lit(0.0)).withColumn("_S", F.lit(0.0))
        win_sum = F.sum(col).over(w.rowsBetween(-h, h))
    else:
        # long period (e.g. 5-minute rows): O(1) per row from running sums,
        # values shifted by a per-bucket constant to keep the sums small
        d = d.withColumn("_c0", F.first(col, True).over(whole))
        d = d.withColumn("_S", F.sum(F.col(col) - F.col("_c0")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        win_sum = (F.lead("_S", h).over(w) - F.coalesce(F.lag("_S", h + 1).over(w), F.lit(0.0))) + F.lit(
            float(2 * h + 1)
        ) * F.col("_c0")
    ends = F.lag(col, h).over(w) + F.lead(col, h).over(w)
    inner = (F.col(idx) >= h) & (F.col(idx) < F.col("_n") - h)
    # an even period weighs the two end rows by half, an odd one is a plain mean of its rows
    d = d.withColumn("_tmid", F.when(inner, (win_sum - 0.5 * ends if p % 2 == 0 else win_sum) / p))
    d = drop_halo(d).drop("_c0", "_S")
    if checkpoint:
        # the trend pass feeds the line fits, the phase means and their joins:
        # store it once instead of re-running the bucketed window per branch
        d = materialize(d)

    return _ends_and_seasons(d, F.lit(p), F.lit(h), keys, idx, col).select(*keys, ts, idx, col, "trend", "seasonal", "residual")


def _ends_and_seasons(d: DataFrame, p: Column, h: Column, keys: Sequence[str], idx: str, col: str) -> DataFrame:
    """Trend, seasonal and residual from ``_tmid``, the trend of the inner rows, and ``_n``, the rows of the series."""
    # straight-line ends
    i = F.col(idx)
    nn = F.col("_n")
    left = (i >= h) & (i < F.least(h + p, nn - h - 1))
    right = (i >= F.greatest(h, nn - h - 1 - p)) & (i < nn - h - 1)
    x = i.cast("double")
    lines = d.groupBy(*keys).agg(
        F.regr_slope(F.when(left, F.col("_tmid")), F.when(left, x)).alias("_bl"),
        F.regr_intercept(F.when(left, F.col("_tmid")), F.when(left, x)).alias("_al"),
        F.regr_slope(F.when(right, F.col("_tmid")), F.when(right, x)).alias("_br"),
        F.regr_intercept(F.when(right, F.col("_tmid")), F.when(right, x)).alias("_ar"),
    )
    d = d.join(lines, list(keys))
    trend = (
        F.when(F.col("_tmid").isNotNull(), F.col("_tmid"))
        .when(i < h, F.col("_al") + F.col("_bl") * x)
        .otherwise(F.col("_ar") + F.col("_br") * x)
    )
    d = d.withColumn("trend", trend).withColumn("_phase", F.pmod(i, p))

    # seasonal phase table, centred
    phase = d.groupBy(*keys, "_phase").agg(F.avg(F.col(col) - F.col("trend")).alias("_pm"))
    centre = phase.groupBy(*keys).agg(F.avg("_pm").alias("_pc"))
    phase = phase.join(centre, list(keys)).select(*keys, "_phase", (F.col("_pm") - F.col("_pc")).alias("seasonal"))
    d = d.join(phase, [*keys, "_phase"])
    return d.withColumn("residual", F.col(col) - F.col("trend") - F.col("seasonal"))


def decompose_by_step(
    df: DataFrame,
    step: str = "step_seconds",
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    col: str = PRICE,
    checkpoint: bool = True,
) -> DataFrame:
    """:func:`decompose` of series with different steps in one plan: ``step`` is a column of seconds, one value per series.

    The centred average is a frame of three and a half days either way over ``idx * step``, which holds the rows of the
    series' own period whatever its step.  Series that have no decomposition (shorter than two periods, a step that does
    not divide seven days) have no rows in the result.
    """
    half = 7 * 86400 * MICROS // 2
    size = F.round(F.col(step).cast("double") * MICROS).cast("long")
    base = df.select(*keys, ts, idx, col, size.alias("_step")).filter(F.col("_step") > 0)
    base = base.filter((F.lit(2 * half) % F.col("_step") == 0) & (F.col("_step") <= half))
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    p = F.expr(f"{2 * half} div _step")
    h = F.expr(f"{2 * half} div _step div 2")
    d = base.join(n, list(keys)).filter(F.col("_n") >= 2 * p).withColumn("_at", F.col(idx) * F.col("_step"))
    d = with_time_halo(d, "_at", half, half, 4 * half)
    w = Window.partitionBy(*keys, BUCKET).orderBy("_at")
    ends = at_distance(F.col(col), w, -half) + at_distance(F.col(col), w, half)
    total = F.sum(col).over(w.rangeBetween(-half, half))
    inner = (F.col(idx) >= h) & (F.col(idx) < F.col("_n") - h)
    d = drop_halo(d.withColumn("_tmid", F.when(inner, F.when(p % 2 == 0, total - 0.5 * ends).otherwise(total) / p))).drop("_at")
    if checkpoint:
        d = materialize(d)
    return _ends_and_seasons(d, p, h, keys, idx, col).select(*keys, ts, idx, col, "trend", "seasonal", "residual")


def add_decomposition_features(
    features: DataFrame, decomposition: DataFrame, keys: Sequence[str] = (SERIES,), idx: str = IDX, col: str = PRICE
) -> DataFrame:
    """Join trend, seasonal, residual and each divided by price (division by 0 -> 0)."""
    dec = decomposition.select(*keys, idx, "trend", "seasonal", "residual", F.col(col).alias("_dp"))
    for c in ("trend", "seasonal", "residual"):
        dec = dec.withColumn(f"{c}_pct", F.coalesce(F.try_divide(F.col(c), F.col("_dp")), F.lit(0.0)))
    return features.join(dec.drop("_dp"), [*keys, idx], "left")
