"""Validation, inspection, outlier repair, splits and the cleaning composition.

P1, T4, A1, O2, P16, P13, A3, P4, C4, C0, C5, C6, P2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import coerce_numeric, parse_timestamp, whole_days_between
from ..plans.ordered import materialize, time_position
from ..session import IDX, PRICE, SERIES, TS
from .fill import fill_time_linear, value_columns
from .quantiles import exact_quantiles
from .resample import resample

REQUIRED = ["timestamp", "price"]

# Verdict texts, as the reference words them.
MSG_OK = "Data validation successful."
MSG_EMPTY = "The uploaded data is empty."
MSG_MISSING = "Missing required column: {}"
MSG_BAD_TS = "Error converting timestamp column to datetime"
MSG_BAD_PRICE = "Error converting price column to numeric"
MSG_SHORT = "Data spans only {} days. At least {} days of data is recommended."


def validate_series(raw: DataFrame, min_days: int = 30, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """One verdict row per series of text input ``timestamp``, ``price``.

    Checks in order: required columns (schema, for the whole input), stamps
    parse, prices are numeric, span of at least ``min_days`` whole days.
    A missing column gives a single verdict row with NULL key.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        spark = raw.sparkSession
        return spark.createDataFrame(
            [(None, 0, 0, 0, None, False, MSG_MISSING.format(missing[0]))],
            f"{keys[0]} string, n_rows long, n_bad_ts long, n_bad_price long, span_days long, is_valid boolean, message string",
        )
    if raw.limit(1).count() == 0:  # one bounded probe: is there any row at all
        return raw.sparkSession.createDataFrame(
            [(None, 0, 0, 0, None, False, MSG_EMPTY)],
            f"{keys[0]} string, n_rows long, n_bad_ts long, n_bad_price long, span_days long, is_valid boolean, message string",
        )
    ts = parse_timestamp("timestamp")
    bad_ts = F.col("timestamp").isNotNull() & (F.trim(F.col("timestamp").cast("string")) != "") & ts.isNull()
    bad_price = (
        F.col("price").isNotNull()
        & (F.trim(F.col("price").cast("string")) != "")
        & coerce_numeric("price").isNull()
    )
    agg = raw.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_ts).alias("n_bad_ts"),
        F.count_if(bad_price).alias("n_bad_price"),
        F.min(ts).alias("_t0"),
        F.max(ts).alias("_t1"),
    )
    span = whole_days_between("_t0", "_t1")
    msg = (
        F.when(F.col("n_bad_ts") > 0, F.lit(MSG_BAD_TS))
        .when(F.col("n_bad_price") > 0, F.lit(MSG_BAD_PRICE))
        .when(F.coalesce(span, F.lit(0)) < min_days, F.format_string(MSG_SHORT.replace("{}", "%d"), F.coalesce(span, F.lit(0)), F.lit(min_days)))
        .otherwise(F.lit(MSG_OK))
    )
    return agg.select(
        *keys,
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_bad_ts").cast("long").alias("n_bad_ts"),
        F.col("n_bad_price").cast("long").alias("n_bad_price"),
        span.alias("span_days"),
        (msg == MSG_OK).alias("is_valid"),
        msg.alias("message"),
    )


def parse_series(raw: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Typed series from text input: ``ts`` parsed, ``price`` and drivers numeric (bad -> NULL)."""
    cols = [c for c in raw.columns if c not in (*keys, "timestamp", "price")]
    return raw.select(
        *keys,
        parse_timestamp("timestamp").alias(TS),
        coerce_numeric("price").alias(PRICE),
        *[coerce_numeric(c).alias(c) for c in cols],
    )


def series_overview(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Rows, first and last stamp, and present prices per series; the column list as text."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(PRICE).alias("n_price"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def preview(df: DataFrame, n: int = 5, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """The first ``n`` rows of each series by time."""
    d = df if IDX in df.columns else time_position(df, ts, keys, IDX)
    out = d.filter(F.col(IDX) < n)
    return out if IDX in df.columns else out.drop(IDX)


def null_census(df: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per series and value column: rows, NULL count (long form, one agg pass)."""
    cols = [c for c in df.columns if c not in (*keys, TS, IDX)]
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    long = agg.unpivot([*keys, "n_rows"], cols, "column", "n_null")
    return long.select(*keys, "column", F.col("n_rows").cast("long"), F.col("n_null").cast("long"))


def flag_extreme(df: DataFrame, limit: float = 1e10, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per series: whether any ``|price|`` exceeds ``limit`` (the fit refuses such series)."""
    return df.groupBy(*keys).agg(
        F.min(PRICE).alias("min_price"),
        F.max(PRICE).alias("max_price"),
        F.coalesce(F.max(F.abs(PRICE)) > limit, F.lit(False)).alias("is_extreme"),
    )


def outlier_bounds(df: DataFrame, k: float = 3.0, col: str = PRICE, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Per series: exact quartiles of ``col`` and the fences ``Q1 - k*IQR``, ``Q3 + k*IQR``."""
    q = exact_quantiles(df, col, [0.25, 0.75], keys)
    iqr = F.col("q75") - F.col("q25")
    return q.select(
        *keys,
        F.col("q25"),
        F.col("q75"),
        (F.col("q25") - k * iqr).alias("lower_fence"),
        (F.col("q75") + k * iqr).alias("upper_fence"),
    )


def flag_outliers(df: DataFrame, k: float = 3.0, col: str = PRICE, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Add ``is_outlier``: value outside the fences of its series."""
    b = outlier_bounds(df, k, col, keys)
    out = df.join(b, list(keys), "left")
    flag = (F.col(col) < F.col("lower_fence")) | (F.col(col) > F.col("upper_fence"))
    return out.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def repair_outliers(df: DataFrame, k: float = 3.0, col: str = PRICE, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Outliers become NULL and are refilled by the time-linear fill (only ``col``)."""
    flagged = flag_outliers(df, k, col, keys)
    cleared = flagged.withColumn(col, F.when(F.col("is_outlier"), F.lit(None).cast("double")).otherwise(F.col(col)))
    cleared = cleared.drop("q25", "q75", "lower_fence", "upper_fence", "is_outlier")
    # the fill reads its input twice (in-bucket pass, carry table): store it once
    return fill_time_linear(materialize(cleared), [col], keys, ts)


def preprocess(
    df: DataFrame, step_seconds: int = 3600, k: float = 3.0, keys: Sequence[str] = (SERIES,), ts: str = TS
) -> DataFrame:
    """Cleaning composition: fill -> resample to the step -> fill the new gaps -> repair outliers.

    ``df`` holds typed rows ``keys, ts, price[, drivers]``.  Result is on a
    dense grid with ``idx``.
    """
    cols = value_columns(df)
    base = df.select(*keys, ts, *cols).filter(F.col(ts).isNotNull())
    filled = materialize(fill_time_linear(base, cols, keys, ts))
    regular = resample(filled, step_seconds, cols, keys, ts)
    regular = materialize(fill_time_linear(regular, cols, keys, ts))
    return repair_outliers(regular, k, PRICE, keys, ts)


def _sized(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    d = df if IDX in df.columns else time_position(df, ts, keys, IDX)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, list(keys))


def split_chronological(df: DataFrame, test_size: float = 0.2, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """``part`` = train for the first ``floor(n * (1 - test_size))`` rows of each series, else test."""
    d = _sized(df, keys, ts)
    cut = F.floor(F.col("_n") * (1 - test_size))
    out = d.withColumn("part", F.when(F.col(IDX) < cut, F.lit("train")).otherwise(F.lit("test"))).drop("_n")
    return out if IDX in df.columns else out.drop(IDX)


def split_xy(df: DataFrame, test_size: float = 0.2, keys: Sequence[str] = (SERIES,), ts: str = TS, target: str = PRICE) -> DataFrame:
    """Unshuffled split with ``ceil(test_size * n)`` test rows; ``y`` = target, the
    features are every other column but the stamp (kept for the test part).
    """
    d = _sized(df, keys, ts)
    n_test = F.ceil(F.col("_n") * test_size)
    out = d.withColumn("part", F.when(F.col(IDX) < F.col("_n") - n_test, F.lit("train")).otherwise(F.lit("test")))
    out = out.withColumn("y", F.col(target)).drop("_n")
    return out if IDX in df.columns else out.drop(IDX)
