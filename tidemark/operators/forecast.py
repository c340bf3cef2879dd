"""Future grid features, history extension and the set-based forecasters.

F1-F6, F8, J5, J9, A9, A10, W10, W11, W12, U1-U3, P3, O3.

The reference never feeds predictions back into later predictions, so every
future row is computed independently from history: joins and group-bys,
no driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import BUCKET, drop_halo, gather, materialize, time_position, with_halo
from ..session import DRIVERS, IDX, PRICE, SERIES, TS
from ..sources.grids import future_grid
from .decompose import decompose, season_rows
from .evaluate import forecast_metrics, future_bands, historical_bands
from .features import DRIVER_LAG_HOURS, ROLL_DAYS, lag_rows, rows_in, temporal_features

RECENT_ROWS = 100  # fixed value: rows behind the future rolling constants


def extend_history(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """History prices plus predictions renamed to price; one row per stamp, history first."""
    h = history.select(*keys, ts, F.col(PRICE), F.lit(0).alias("_prio"))
    f = forecast.select(*keys, ts, F.col("predicted").alias(PRICE), F.lit(1).alias("_prio"))
    both = h.unionByName(f)
    first = both.groupBy(*keys, ts).agg(F.min_by(F.col(PRICE), F.col("_prio")).alias(PRICE))
    return first


def combine_forecast(tested: DataFrame, future: DataFrame) -> DataFrame:
    """Tested part and future part as one table; columns missing on one side are NULL."""
    return tested.unionByName(future, allowMissingColumns=True)


def future_features(
    history: DataFrame,
    horizon_days: int = 7,
    step_seconds: int = 3600,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    ddof: int = 0,
    carry_cols: Sequence[str] = (),
) -> DataFrame:
    """Features of the future rows of each series.

    Calendar columns are exact.  A lag of ``k`` rows at future row ``h`` is
    the history value at position ``n + h - k``, clamped to the first/last
    history row; all lags of all columns come from one join (``gather``).
    Rolling columns are the mean, std (population by default, as the
    reference), min, max and range of the last 100 history rows.  Every driver
    in the history gets its 24-hour lag and its 1-day mean and std in the same
    way, from its own values.  ``carry_cols`` take the last history value.
    """
    hist = history if idx in history.columns else time_position(history, ts, keys, idx)
    drivers = [c for c in DRIVERS if c in hist.columns]
    n = hist.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(idx).alias("_last"))
    grid = future_grid(hist, horizon_days, step_seconds, keys, ts).join(n, list(keys))
    day = rows_in(DRIVER_LAG_HOURS * 3600, step_seconds)
    wanted = [(f"price_lag_{name}", PRICE, k) for name, k in lag_rows(step_seconds)]
    wanted += [(f"{c}_lag_24h", c, day) for c in drivers if day]
    # only the history tail the longest lag reaches (and row 0, the clamp target) is ever looked up
    kmax = max([0, *[k for _, _, k in wanted]])
    tail = hist.join(n, list(keys)).filter((F.col(idx) >= F.col("_n") - kmax) | (F.col(idx) == 0))
    clamped = lambda k: F.greatest(F.lit(0), F.least(F.col("_n") - 1, F.col("_n") + F.col("h") - k))
    out = temporal_features(gather(grid, tail, wanted, clamped, keys, idx), ts)
    recent = hist.join(n, list(keys)).filter(F.col(idx) > F.col("_last") - RECENT_ROWS)
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    of_drivers = [a for c in drivers if day for a in (F.avg(c).alias(f"{c}_rolling_mean_1d"), std(c).alias(f"{c}_rolling_std_1d"))]
    stats = recent.groupBy(*keys).agg(
        F.avg(PRICE).alias("_mean"), std(PRICE).alias("_std"), F.min(PRICE).alias("_min"), F.max(PRICE).alias("_max"),
        *of_drivers, *[F.max_by(F.col(c), F.col(idx)).alias(c) for c in carry_cols],
    )
    out = out.join(stats, list(keys), "left")
    for d in ROLL_DAYS:
        out = (
            out.withColumn(f"price_rolling_mean_{d}d", F.col("_mean"))
            .withColumn(f"price_rolling_std_{d}d", F.col("_std"))
            .withColumn(f"price_rolling_min_{d}d", F.col("_min"))
            .withColumn(f"price_rolling_max_{d}d", F.col("_max"))
            .withColumn(f"price_rolling_range_{d}d", F.col("_max") - F.col("_min"))
        )
    return out.drop("_mean", "_std", "_min", "_max", "_n", "_last")


def sequence_windows(
    df: DataFrame, col: str = PRICE, seq_len: int = 72, keys: Sequence[str] = (SERIES,), idx: str = IDX
) -> DataFrame:
    """For each row with ``seq_len`` earlier rows: the array of the previous ``seq_len`` values (oldest first, NULL kept)."""
    d = with_halo(df, seq_len, 0, max(8192, 4 * seq_len), idx)
    w = Window.partitionBy(*keys, BUCKET).orderBy(idx).rowsBetween(-seq_len, -1)
    d = d.withColumn("window", F.transform(F.collect_list(F.struct(F.col(col).alias("v"))).over(w), lambda x: x["v"]))
    d = drop_halo(d)
    return d.filter(F.size("window") == seq_len)


# ---------------------------------------------------------------- scaling (A10)


def fit_scaler(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per key and column: mean and population std (std 0 -> 1), as one wide row per key."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd")]
    s = df.groupBy(*keys).agg(*aggs)
    for c in cols:
        s = s.withColumn(f"{c}__sd", F.when((F.col(f"{c}__sd") == 0) | F.col(f"{c}__sd").isNull(), F.lit(1.0)).otherwise(F.col(f"{c}__sd")))
    return s


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keys: Sequence[str] = (SERIES,), suffix: str = "") -> DataFrame:
    d = df.join(scaler, list(keys), "left")
    for c in cols:
        d = d.withColumn(c + suffix, (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd"))
    return d.drop(*[x for x in scaler.columns if x not in keys])


def invert_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keys: Sequence[str] = (SERIES,), suffix: str = "") -> DataFrame:
    d = df.join(scaler, list(keys), "left")
    for c in cols:
        d = d.withColumn(c + suffix, F.col(c) * F.col(f"{c}__sd") + F.col(f"{c}__mean"))
    return d.drop(*[x for x in scaler.columns if x not in keys])


# ---------------------------------------------------------------- forecasters


def _split_point(df: DataFrame, test_size: float, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_m", F.col("_n") - F.ceil(F.col("_n") * test_size))


def _finish(
    hist_pred: DataFrame,
    fut_pred: DataFrame,
    z: float,
    keys: Sequence[str],
    model: str,
) -> tuple[DataFrame, DataFrame]:
    tested = historical_bands(hist_pred, z, keys)
    future = future_bands(fut_pred, z)
    fc = combine_forecast(
        tested.select(*keys, TS, "actual", "predicted", "lower", "upper"),
        future.select(*keys, TS, "predicted", "lower", "upper"),
    ).withColumn("model", F.lit(model))
    metrics = forecast_metrics(tested, keys).withColumn("model", F.lit(model))
    return fc, metrics


def forecast_seasonal_naive(
    series: DataFrame,
    horizon_days: int = 7,
    step_seconds: int = 3600,
    test_size: float = 0.2,
    z: float = 1.96,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
) -> tuple[DataFrame, DataFrame]:
    """Same row one season (7 days) earlier.  Test rows use actual history;
    future row ``h`` repeats the last season: ``price[n - p + (h % p)]``.
    Needs ``n >= p``.  Returns ``(forecast, metrics)``.
    """
    p = season_rows(step_seconds)
    if p < 1:
        raise ValueError(f"a season of seven days is not a whole number of {step_seconds}-second steps")
    hist = series.select(*keys, ts, idx, PRICE)
    sp = _split_point(hist, test_size, keys).filter(F.col("_n") >= p)
    # look-ups reach back at most one season before the test part
    vals = hist.join(sp, list(keys)).filter(F.col(idx) >= F.col("_m") - p)
    vals = vals.select(*keys, F.col(idx).alias("_src"), F.col(PRICE).alias("predicted"))
    test = hist.join(sp, list(keys)).filter(F.col(idx) >= F.col("_m")).withColumn("_src", F.col(idx) - p)
    test = test.join(vals, [*keys, "_src"]).select(*keys, ts, F.col(PRICE).alias("actual"), "predicted")
    grid = future_grid(hist, horizon_days, step_seconds, keys, ts).join(sp, list(keys))
    grid = grid.withColumn("_src", F.col("_n") - p + F.pmod(F.col("h"), F.lit(p)))
    fut = grid.join(vals, [*keys, "_src"]).select(*keys, ts, "predicted")
    return _finish(test, fut, z, keys, "seasonal_naive")


def forecast_trend_seasonal(
    series: DataFrame,
    horizon_days: int = 7,
    step_seconds: int = 3600,
    test_size: float = 0.2,
    z: float = 1.96,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    checkpoint: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Decomposition of the train part; straight line through the last ``2p``
    trend rows of train; prediction = line + seasonal phase, for test and
    future rows alike.  Returns ``(forecast, metrics)``.
    """
    p = season_rows(step_seconds)
    if p < 1:
        raise ValueError(f"a season of seven days is not a whole number of {step_seconds}-second steps")
    hist = series.select(*keys, ts, idx, PRICE)
    sp = _split_point(hist, test_size, keys)
    train = hist.join(sp, list(keys)).filter(F.col(idx) < F.col("_m")).select(*keys, ts, idx, PRICE)
    dec = decompose(train, step_seconds, keys, ts, idx, period=p, checkpoint=checkpoint)
    if checkpoint:
        dec = materialize(dec)
    m = dec.groupBy(*keys).agg(F.max(idx).alias("_mx"))
    tail = dec.join(m, list(keys)).filter(F.col(idx) > F.col("_mx") - 2 * p)
    x = F.col(idx).cast("double")
    line = tail.groupBy(*keys).agg(F.regr_slope("trend", x).alias("_b"), F.regr_intercept("trend", x).alias("_a"))
    phases = dec.select(*keys, F.pmod(F.col(idx), F.lit(p)).alias("_ph"), "seasonal").distinct()
    model = line.join(phases, list(keys))

    def predict(rows: DataFrame) -> DataFrame:
        r = rows.withColumn("_ph", F.pmod(F.col(idx), F.lit(p))).join(model, [*keys, "_ph"])
        return r.withColumn("predicted", F.col("_a") + F.col("_b") * F.col(idx).cast("double") + F.col("seasonal"))

    test = hist.join(sp, list(keys)).filter(F.col(idx) >= F.col("_m"))
    test = predict(test).select(*keys, ts, F.col(PRICE).alias("actual"), "predicted")
    grid = future_grid(hist, horizon_days, step_seconds, keys, ts).join(sp, list(keys))
    grid = grid.withColumn(idx, F.col("_n") + F.col("h"))
    fut = predict(grid).select(*keys, ts, "predicted")
    return _finish(test, fut, z, keys, "trend_seasonal")
