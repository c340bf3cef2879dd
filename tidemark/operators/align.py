"""Aligning a price series to a feature frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import time_position
from ..session import IDX, PRICE, SERIES, TS


def align_to(
    prices: DataFrame,
    features: DataFrame,
    how: str = "semi",
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    col: str = PRICE,
) -> DataFrame:
    """``semi``: price rows whose stamp is in the features.
    ``left``: one row per feature stamp, price NULL where absent (reindex).
    ``pad``: by position - feature row ``i`` takes price row ``i``; feature
    rows past the end of the prices take the last price (extra prices dropped).
    """
    if how == "semi":
        return prices.join(features.select(*keys, ts), [*keys, ts], "left_semi")
    if how == "left":
        return features.select(*keys, ts).join(prices.select(*keys, ts, col), [*keys, ts], "left")
    if how == "pad":
        fx = features.select(*keys, ts) if IDX not in features.columns else features.select(*keys, ts, IDX)
        fx = fx if IDX in fx.columns else time_position(fx, ts, keys, IDX)
        px = time_position(prices.select(*keys, F.col(ts).alias("_pts"), col), "_pts", keys, "_pos")
        last = px.groupBy(*keys).agg(F.max_by(F.col(col), F.col("_pos")).alias("_last"))
        out = fx.join(px.select(*keys, F.col("_pos").alias(IDX), col), [*keys, IDX], "left").join(last, list(keys), "left")
        return out.select(*keys, ts, F.coalesce(F.col(col), F.col("_last")).alias(col))
    raise ValueError(how)
