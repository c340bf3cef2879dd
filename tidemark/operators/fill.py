"""Gap filling: time-linear interpolation, then carry forward, then back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import DEFAULT_CARRY_ROWS, carry_present, with_time_buckets
from ..session import DRIVERS, IDX, PRICE, SERIES, TS


def value_columns(df: DataFrame) -> list[str]:
    """``price`` and the optional driver columns present, in the reference's order."""
    return [c for c in [PRICE, *DRIVERS] if c in df.columns]


def fill_time_linear(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    carry_rows: int = DEFAULT_CARRY_ROWS,
) -> DataFrame:
    """Fill NULLs per series and column, linear in time between the nearest
    present points; leading gaps take the first present value, trailing gaps
    the last one.  Present values are never changed.  A column that is NULL on
    every row of a series stays NULL.
    """
    cols = list(cols) if cols is not None else value_columns(df)
    if not cols:
        return df
    if idx in df.columns:
        d = carry_present(df, cols, ts, keys, idx, bucket_rows=carry_rows)
    else:
        # only a bucket monotone in time is needed, not a dense position
        d = with_time_buckets(df, ts, keys, carry_rows, "_fb")
        d = carry_present(d, cols, ts, keys, "_fb", bucket_rows=1).drop("_fb")
    t = F.col(ts).cast("timestamp_ntz")
    for c in cols:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        pt, nt = p["t"].cast("timestamp_ntz"), n["t"].cast("timestamp_ntz")
        pv, nv = p["v"], n["v"]
        # a difference of stamps costs far more than the rest: two a row
        span, past = F.timestamp_diff("MICROSECOND", pt, nt), F.timestamp_diff("MICROSECOND", pt, t)
        blend = (nv - pv) / span.cast("double") * past.cast("double") + pv
        filled = (
            F.when(F.col(c).isNotNull(), F.col(c))
            .when(p.isNull(), nv)
            .when(n.isNull(), pv)
            .when(nt == pt, pv)
            .otherwise(blend)
        )
        d = d.withColumn(c, filled).drop(f"_p_{c}", f"_n_{c}")
    return d


def fill_constant(df: DataFrame, value: float = 0.0, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL by a constant (default 0) in the given or all numeric columns."""
    if cols is None:
        return df.fillna(value)
    return df.fillna(value, subset=list(cols))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any NULL in ``cols`` (default: every column)."""
    return df.dropna("any", subset=list(cols) if cols is not None else None)
