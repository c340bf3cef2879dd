"""Places of rows in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, stored


def place(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "__place") -> DataFrame:
    """``df`` with ``name``: the place of each row, from 0, in ``order`` (nulls first) among the rows of equal ``by``.

    Rows are dealt by ranges of ``by + order``, sorted inside each range and stored, so that the ranges stay as they are; a
    table of at most (ranges + groups) rows holds how many rows of a group lie in earlier ranges.  Rows equal in ``order`` get
    neighbouring places in any order, so callers order by all that tells rows apart.
    """
    by = by or []
    cols = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    ranged = stored(df.repartitionByRange(*cols).sortWithinPartitions(*cols))
    ranged = ranged.withColumn("__mid", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__mid", 33))
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min("__mid").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long"))).drop("__n")
    out = attach(ranged, stored(counts), [*by, "__range"])
    return out.withColumn(name, F.col("__before") + F.col("__mid") - F.col("__first")).drop("__mid", "__range", "__before", "__first")
