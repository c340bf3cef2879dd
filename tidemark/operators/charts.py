"""Tables behind the charts (V1-V5, P9, P10): long-form rows a plotting layer draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import PRICE, SERIES, TS
from .evaluate import metrics_long

# Range presets (label, unit, amount) counting back from the last point.
PRESETS = [("1w", "day", 7), ("2w", "day", 14), ("1m", "month", 1), ("3m", "month", 3), ("6m", "month", 6), ("1y", "month", 12), ("all", None, 0)]


def preset_cutoffs(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """``keys, preset, cutoff``: the first stamp shown by each preset (NULL = all)."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    rows = []
    for label, unit, n in PRESETS:
        if unit == "day":
            cut = F.timestamp_add("DAY", F.lit(-n), F.col("_last"))
        elif unit == "month":
            cut = F.timestamp_add("MONTH", F.lit(-n), F.col("_last"))
        else:
            cut = F.lit(None).cast("timestamp_ntz")
        rows.append(F.struct(F.lit(label).alias("preset"), cut.alias("cutoff")))
    return last.select(*keys, F.explode(F.array(*rows)).alias("_p")).select(*keys, "_p.preset", "_p.cutoff")


def range_preset(df: DataFrame, preset: str = "all", keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """Rows shown by a preset: ``ts >= last - interval`` per series."""
    cut = preset_cutoffs(df, keys, ts).filter(F.col("preset") == preset).drop("preset")
    return df.join(cut, list(keys)).filter(F.col("cutoff").isNull() | (F.col(ts) >= F.col("cutoff"))).drop("cutoff")


def split_forecast(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """``part`` = history before the first row without an actual value, future from it;
    with no such row every row is history."""
    start = df.groupBy(*keys).agg(F.min(F.when(F.col("actual").isNull(), F.col(ts))).alias("_fs"))
    out = df.join(start, list(keys), "left")
    part = F.when(F.col("_fs").isNull() | (F.col(ts) < F.col("_fs")), F.lit("history")).otherwise(F.lit("future"))
    return out.withColumn("part", part).drop("_fs")


def chart_history(df: DataFrame, preset: str = "all", keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    return range_preset(df.select(*keys, ts, PRICE), preset, keys, ts)


def chart_forecast(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    """``keys, ts, part, trace, y`` with traces actual (history only), predicted, lower, upper."""
    s = split_forecast(df, keys, ts)
    long = s.unpivot([*keys, ts, "part"], ["actual", "predicted", "lower", "upper"], "trace", "y")
    return long.filter(~((F.col("trace") == "actual") & (F.col("part") == "future")))


def chart_metrics(metrics: DataFrame, keys: Sequence[str] = ("model", SERIES)) -> DataFrame:
    return metrics_long(metrics, keys)


def chart_decomposition(dec: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS) -> DataFrame:
    return dec.unpivot([*keys, ts], [PRICE, "trend", "seasonal", "residual"], "component", "value")


def top_features(importance: DataFrame, n: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` features by importance (ties by name); per key when keys are given."""
    from pyspark.sql import Window

    if not keys:
        return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), F.col("feature"))
    return importance.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
