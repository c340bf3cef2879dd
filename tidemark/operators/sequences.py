"""Sequence tensors: the rows before a row as its input, the row's own value as target (W10, inputs of F1, F2).

A tensor of ``seq_len`` rows by ``F`` features per row would store every row ``seq_len`` times.  Here rows are packed once:
a block holds ``block_rows`` consecutive rows of a series and the ``seq_len`` rows before them (the halo, one part in
eight by default), so a long series is many blocks on many tasks and the packed table is little larger than the series.
Examples are cut out of the blocks where they are used, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import BUCKET, HALO, with_halo
from ..session import IDX, PRICE, SERIES, TS

SEQ_LEN = 72  # fixed value: rows the reference feeds its network


def sequence_blocks(
    df: DataFrame,
    cols: Sequence[str],
    target: str = PRICE,
    seq_len: int = SEQ_LEN,
    keys: Sequence[str] = (SERIES,),
    ts: str = TS,
    idx: str = IDX,
    block_rows: int | None = None,
) -> DataFrame:
    """``keys, block, rows``: rows (``idx``, ``own``, ``x`` = the values of ``cols``, ``y``, ``ts``) in order of the dense position ``idx``.

    ``own`` is false on the halo.  NULL values stay in their place.
    """
    size = block_rows or 8 * seq_len
    x = F.array(*[F.col(c).cast("double") for c in cols])
    placed = with_halo(df.select(*keys, idx, x.alias("_x"), F.col(target).cast("double").alias("_y"), ts), seq_len, 0, size, idx)
    row = F.struct(F.col(idx).alias("idx"), (~F.col(HALO)).alias("own"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col(ts).alias("ts"))
    # at most block_rows + seq_len rows a group
    packed = placed.groupBy(*keys, BUCKET).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.withColumnRenamed(BUCKET, "block")


def sequence_examples(
    blocks: DataFrame, seq_len: int = SEQ_LEN, keys: Sequence[str] = (SERIES,), ts: str = TS, idx: str = IDX, flat: bool = False
) -> DataFrame:
    """``keys, ts, idx, X, y``: for every row with ``seq_len`` earlier rows, those rows' values (oldest first) and its target.

    ``X`` is an array per earlier row, or with ``flat`` one array of all of them, the features of the oldest row first.
    """
    rows = F.col("rows")

    def example(j: Column) -> Column:
        before = F.transform(F.slice(rows, j - seq_len + 1, F.lit(seq_len)), lambda r: r["x"])
        at = F.get(rows, j)
        return F.struct(at["ts"].alias(ts), at["idx"].alias(idx), (F.flatten(before) if flat else before).alias("X"), at["y"].alias("y"))

    # the first block has no halo, so its first seq_len rows have no example; in all others the halo comes first
    places = F.when(F.size(rows) > seq_len, F.sequence(F.lit(seq_len), F.size(rows) - 1))
    return blocks.select(*keys, F.inline(F.transform(places, example)))


def last_rows(df: DataFrame, cols: Sequence[str], seq_len: int = SEQ_LEN, keys: Sequence[str] = (SERIES,), idx: str = IDX) -> DataFrame:
    """``keys, tail``: the values of ``cols`` in the last ``seq_len`` rows of each series that has so many, oldest first."""
    n = df.groupBy(*keys).agg(F.max(idx).alias("_last"))
    recent = df.join(n, list(keys)).filter(F.col(idx) > F.col("_last") - seq_len)
    row = F.struct(F.col(idx).alias("idx"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    tail = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))  # at most seq_len rows a series
    return tail.filter(F.size("_rows") == seq_len).select(*keys, F.transform("_rows", lambda r: r["x"]).alias("tail"))


def future_examples(grid: DataFrame, tails: DataFrame, seq_len: int = SEQ_LEN, keys: Sequence[str] = (SERIES,), flat: bool = True) -> DataFrame:
    """``grid`` (with ``h``) with ``X``: the rows before future row ``h``, those beyond the history being its last row.

    Predictions are never fed back, so every future row has its input at once: positions ``n + h - seq_len`` to ``n + h - 1``,
    clamped to ``n - 1``, are places of the series' last rows.
    """
    place = lambda j: F.least(F.lit(seq_len - 1).cast("long"), F.col("h") + j).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda j: F.get("tail", place(j)))
    out = grid.join(tails, list(keys))
    return out.withColumn("X", F.flatten(rows) if flat else rows).drop("tail")


def sequence_names(cols: Sequence[str], seq_len: int = SEQ_LEN) -> list[str]:
    """Names of a flat example's places: feature and how many rows before the target."""
    return [f"{c}_t-{seq_len - j}" for j in range(seq_len) for c in cols]
