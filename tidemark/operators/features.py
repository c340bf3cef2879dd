"""Feature columns: calendar (T1-T3, P5), lags (W1), rolling (W2, T10),
drivers (W3, J3), and the whole feature composition (D4, P6).

Row counts for "hours" and "days" come from the series step (:func:`rows_in`).
Lags and windows that are not a whole number of steps are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import TWO_PI
from ..plans.ordered import materialize
from ..plans.rolling import Lag, Roll, ordered_features
from ..plans.spans import MICROS, SpanLag, SpanRoll, span_features
from ..session import DRIVERS, IDX, PRICE, SERIES, TS
from .decompose import decompose, decompose_by_step, season_rows

# The reference's lag and window lists.
LAG_HOURS = [1, 3, 6, 12, 24]
LAG_DAYS = [7, 14, 30]
ROLL_DAYS = [1, 7, 30]
DRIVER_LAG_HOURS = 24


def rows_in(span_seconds: int, step_seconds: int) -> int:
    """Rows in a span, 0 where the step does not divide it: such a column is left out rather than shifted."""
    rows, rest = divmod(int(span_seconds), int(step_seconds))
    return 0 if rest else rows


def temporal_features(df: DataFrame, ts: str = TS) -> DataFrame:
    """hour, day, day_of_week (Mon=0), month, quarter, year; their sin/cos; weekend and business-hour flags."""
    t = F.col(ts)
    d = df.select(
        "*",
        F.hour(t).cast("long").alias("hour"),
        F.dayofmonth(t).cast("long").alias("day"),
        F.weekday(t).cast("long").alias("day_of_week"),
        F.month(t).cast("long").alias("month"),
        F.quarter(t).cast("long").alias("quarter"),
        F.year(t).cast("long").alias("year"),
    )
    weekend = F.col("day_of_week").isin(5, 6)
    return d.select(
        "*",
        F.sin(TWO_PI * F.col("hour") / 24).alias("hour_sin"),
        F.cos(TWO_PI * F.col("hour") / 24).alias("hour_cos"),
        F.sin(TWO_PI * F.col("day_of_week") / 7).alias("day_of_week_sin"),
        F.cos(TWO_PI * F.col("day_of_week") / 7).alias("day_of_week_cos"),
        F.sin(TWO_PI * F.col("month") / 12).alias("month_sin"),
        F.cos(TWO_PI * F.col("month") / 12).alias("month_cos"),
        weekend.cast("long").alias("is_weekend"),
        (F.col("hour").between(8, 18) & ~weekend).cast("long").alias("is_business_hour"),
    )


def lag_rows(step_seconds: int, hours: Sequence[int] = LAG_HOURS, days: Sequence[int] = LAG_DAYS) -> list[tuple[str, int]]:
    """(name, rows) of every lag that is a whole number of steps."""
    named = [(f"{h}h", rows_in(h * 3600, step_seconds)) for h in hours] + [(f"{d}d", rows_in(d * 86400, step_seconds)) for d in days]
    return [(name, k) for name, k in named if k]


def lag_specs(step_seconds: int, col: str = PRICE) -> list[Lag]:
    return [Lag(f"{col}_lag_{name}", col, k) for name, k in lag_rows(step_seconds)]


def roll_specs(step_seconds: int, col: str = PRICE) -> list[Roll]:
    spans = [(d, rows_in(d * 86400, step_seconds)) for d in ROLL_DAYS]
    return [Roll(col, k, tuple((s, f"{col}_rolling_{s}_{d}d") for s in ("mean", "std", "min", "max"))) for d, k in spans if k]


def _with_ranges(df: DataFrame, col: str = PRICE) -> DataFrame:
    for d in [d for d in ROLL_DAYS if f"{col}_rolling_max_{d}d" in df.columns]:
        df = df.withColumn(f"{col}_rolling_range_{d}d", F.col(f"{col}_rolling_max_{d}d") - F.col(f"{col}_rolling_min_{d}d"))
    return df


def lag_features(df: DataFrame, step_seconds: int = 3600, keys: Sequence[str] = (SERIES,), idx: str = IDX) -> DataFrame:
    """price lags of 1, 3, 6, 12, 24 hours and 7, 14, 30 days (rows scaled by the step)."""
    return ordered_features(df, lags=lag_specs(step_seconds), keys=keys, idx=idx)


def rolling_features(df: DataFrame, step_seconds: int = 3600, keys: Sequence[str] = (SERIES,), idx: str = IDX, method: str = "auto") -> DataFrame:
    """Trailing 1, 7, 30-day mean, sample std, min, max and range of price (current row included)."""
    return _with_ranges(ordered_features(df, rolls=roll_specs(step_seconds), keys=keys, idx=idx, method=method))


def driver_specs(df: DataFrame, step_seconds: int) -> tuple[list[Lag], list[Roll]]:
    day = rows_in(DRIVER_LAG_HOURS * 3600, step_seconds)
    present = [c for c in DRIVERS if c in df.columns and day]
    lags = [Lag(f"{c}_lag_24h", c, day) for c in present]
    return lags, [Roll(c, day, (("mean", f"{c}_rolling_mean_1d"), ("std", f"{c}_rolling_std_1d"))) for c in present]


def add_external_features(df: DataFrame, step_seconds: int = 3600, keys: Sequence[str] = (SERIES,), idx: str = IDX) -> DataFrame:
    """For each driver present: 1-day rolling mean and sample std, 24-hour lag."""
    lags, rolls = driver_specs(df, step_seconds)
    if not lags:
        return df
    return ordered_features(df, lags=lags, rolls=rolls, keys=keys, idx=idx)


DECOMP_COLS = ["trend", "seasonal", "residual", "trend_pct", "seasonal_pct", "residual_pct"]


def engineer_features(
    df: DataFrame,
    step_seconds: int | None = 3600,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    checkpoint: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """See :func:`_engineer`.  ``step_seconds=None`` detects the modal step of each series and handles all steps in one
    plan, by frames over time (:func:`_engineer_spans`)."""
    if step_seconds is not None:
        return _engineer(df, int(step_seconds), keys, ts, idx, checkpoint)
    return _engineer_spans(df, keys, ts, idx, checkpoint)


def span_specs(columns: Sequence[str], col: str = PRICE) -> tuple[list[SpanLag], list[SpanRoll]]:
    """The lags and frames of ``col`` and of the drivers among ``columns``, by their length in time."""
    lags = [SpanLag(f"{col}_lag_{h}h", col, h * 3600) for h in LAG_HOURS] + [SpanLag(f"{col}_lag_{d}d", col, d * 86400) for d in LAG_DAYS]
    rolls = [SpanRoll(col, d * 86400, tuple((s, f"{col}_rolling_{s}_{d}d") for s in ("mean", "std", "min", "max"))) for d in ROLL_DAYS]
    day = DRIVER_LAG_HOURS * 3600
    present = [c for c in DRIVERS if c in columns]
    lags += [SpanLag(f"{c}_lag_24h", c, day) for c in present]
    return lags, rolls + [SpanRoll(c, day, (("mean", f"{c}_rolling_mean_1d"), ("std", f"{c}_rolling_std_1d"))) for c in present]


def _engineer_spans(df: DataFrame, keys: Sequence[str], ts: str, idx: str, checkpoint: bool) -> tuple[DataFrame, DataFrame]:
    """The features of :func:`_engineer` for cleaned series of any steps -> ``(features, decomposition)``.

    Every series has every column.  A lag or frame that is no whole number of a series' steps is NULL there, and so is the
    deviation of a frame of one row; rows are dropped for other NULL features only.  Series without a step (fewer
    than two stamps) have no rows.
    """
    from .step import detect_step

    drivers = [c for c in DRIVERS if c in df.columns]
    steps = detect_step(df.select(*keys, ts), keys, ts).filter(F.col("step_seconds") > 0).select(*keys, F.col("step_seconds").alias("_step_s"))
    base = df.select(*keys, ts, idx, PRICE, *drivers).join(steps, list(keys))
    if checkpoint:
        base = materialize(base)
    dec = decompose_by_step(base, "_step_s", keys, ts, idx, checkpoint=checkpoint)
    dcols = ["trend", "seasonal", "residual"]
    rows = base.join(dec.select(*keys, idx, *dcols), [*keys, idx], "left")
    lags, rolls = span_specs(drivers)
    feats = span_features(rows, lags, rolls, keys, ts)
    step = F.round(F.col("_step_s") * MICROS).cast("long")
    whole = lambda seconds: F.lit(seconds * MICROS) % step == 0
    owed = {x.out: whole(x.seconds) for x in lags}
    owed |= {out: whole(x.seconds) & (F.lit(stat != "std") | (step < x.seconds * MICROS)) for x in rolls for stat, out in x.outs}
    feats = feats.select(*[F.when(owed[c], F.col(c)).alias(c) if c in owed else c for c in feats.columns])
    for c in [PRICE, *drivers]:
        feats = feats.filter(F.col(c).isNotNull())
    for c, needed in owed.items():
        feats = feats.filter(~needed | F.col(c).isNotNull())
    feats = _with_ranges(temporal_features(feats.drop("_step_s").filter(F.col(ts).isNotNull()), ts))
    for c in dcols:
        share = F.coalesce(F.try_divide(F.col(c), F.col(PRICE)), F.lit(0.0))
        feats = feats.withColumn(f"{c}_pct", F.when(F.col(c).isNotNull(), share))
    order = [*keys, ts, idx, PRICE] + [c for c in feats.columns if c not in (*keys, ts, idx, PRICE)]
    return feats.select(*order), dec


def _engineer(
    df: DataFrame,
    step_seconds: int,
    keys: Sequence[str],
    ts: str,
    idx: str,
    checkpoint: bool,
) -> tuple[DataFrame, DataFrame]:
    """Feature composition over cleaned dense series -> ``(features, decomposition)``.

    Calendar, price lags and rolling statistics and the driver features come
    from one bucketed window pass (one shuffle); the decomposition is joined
    on ``(series_id, idx)``.  Rows with a NULL feature are dropped, except
    that a series too short to decompose keeps NULL decomposition columns
    (the reference leaves those columns out for such a series).
    """
    drivers = [c for c in DRIVERS if c in df.columns]
    base = df.select(*keys, ts, idx, PRICE, *drivers)
    if checkpoint:
        # read more than once below (decomposition, short-series rows): cut the upstream once
        base = materialize(base)
    lags = lag_specs(step_seconds)
    rolls = roll_specs(step_seconds)
    dl, dr = driver_specs(base, step_seconds)
    # Decompose first and run the feature pass over the decomposed rows, so the
    # decomposition columns ride along: no join of two full-size outputs.
    dec = decompose(base, step_seconds, keys, ts, idx)
    p = season_rows(step_seconds)
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = base.join(n.filter(F.col("_n") < 2 * p).select(*keys), list(keys), "left_semi") if p >= 2 else base
    dcols = ["trend", "seasonal", "residual"]
    rows = dec.join(base.select(*keys, idx, *drivers), [*keys, idx]) if drivers else dec
    rows = rows.select(*keys, ts, idx, PRICE, *drivers, *dcols).unionByName(
        short.select(*keys, ts, idx, PRICE, *drivers, *[F.lit(None).cast("double").alias(c) for c in dcols])
    )
    feats = ordered_features(rows, lags=lags + dl, rolls=rolls + dr, keys=keys, idx=idx)
    feats = _with_ranges(temporal_features(feats, ts))
    for c in dcols:
        # share of price; division by 0 -> 0; NULL for series too short to decompose
        feats = feats.withColumn(
            f"{c}_pct", F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c), F.col(PRICE)), F.lit(0.0)))
        )
    required = [c for c in feats.columns if c not in DECOMP_COLS]
    feats = feats.dropna("any", subset=required)
    order = [*keys, ts, idx, PRICE] + [c for c in feats.columns if c not in (*keys, ts, idx, PRICE)]
    return feats.select(*order), dec
