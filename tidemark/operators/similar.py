"""Similar days: a day as 24 hourly values, its shape, clusters of shapes, and the earlier days most like a given one.

A day's hours are averaged by one aggregation with map-side partials, so ticks of any density and hours in any order will do, and no
group holds rows.  The shape of a day is its hours less their mean, over their deviation; clusters and distances compare shapes, so a dear
day and a cheap one with the same course are alike.

Defined cases: an hour without a value is NULL in the vector and 0 (the day's mean) in the shape; a day whose hours are all
equal has a shape of zeros; a day without any value keeps its row with NULL level, is in no cluster (NULL) and is like no day; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import materialize
from ..session import PRICE, SERIES, TS

HOURS = 24
_FLAT = 1e-9  # deviations below this share of the level are noise of the sums


def day_vectors(df: DataFrame, keys: Sequence[str] = (SERIES,), ts: str = TS, value: str = PRICE) -> DataFrame:
    """``keys, day, n_present, level, spread, vector, shape``: a row per day with a row in ``df``; arrays have 24 values."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    hours = [F.avg(F.when(F.hour(ts) == h, v)) for h in range(HOURS)]
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.array(*hours).alias("vector"))
    days = days.withColumn("_p", F.filter("vector", lambda x: x.isNotNull())).withColumn("n_present", F.size("_p").cast("long"))
    total = lambda c, fn: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + fn(x))
    days = days.withColumn("level", F.when(F.col("n_present") > 0, total("_p", lambda x: x) / F.col("n_present")))
    days = days.withColumn("spread", F.when(F.col("n_present") > 0, F.sqrt(total("_p", lambda x: (x - F.col("level")) ** 2) / F.col("n_present"))))
    flat = F.coalesce(F.col("spread") <= F.lit(_FLAT) * F.greatest(F.lit(1.0), F.abs("level")), F.lit(True))
    shape = F.transform("vector", lambda x: F.when(flat | x.isNull(), F.lit(0.0)).otherwise((x - F.col("level")) / F.col("spread")))
    return days.select(*keys, "day", "n_present", "level", "spread", "vector", shape.alias("shape"))


def cluster_days(days: DataFrame, k: int = 6, seed: int = 7, max_iter: int = 30) -> DataFrame:
    """``days`` with ``cluster`` (from 0): k-means over the shapes of all series at once."""
    days = materialize(days)
    there = days.filter("n_present > 0")
    none = days.filter("n_present = 0").withColumn("cluster", F.lit(None).cast("int"))
    if there.isEmpty():
        return none
    points = there.withColumn("_x", array_to_vector("shape"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_x", predictionCol="cluster").fit(points)
    return model.transform(points).drop("_x").unionByName(none)


def similar_days(days: DataFrame, k: int = 5, targets: DataFrame | None = None, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """``keys, target, day, place, distance``: the ``k`` days before each target day whose shapes are nearest, ties to the later day.

    ``targets`` (``keys, target``) defaults to the last day with a value of every series.  Distances are Euclidean, compared to nine digits.
    """
    there = days.filter("n_present > 0")
    if targets is None:
        targets = there.groupBy(*keys).agg(F.max("day").alias("target"))
    wanted = targets.join(there.select(*keys, F.col("day").alias("target"), F.col("shape").alias("_to")), [*keys, "target"])
    near = there.select(*keys, "day", "shape").join(wanted, list(keys)).filter(F.col("day") < F.col("target"))
    squares = F.zip_with("shape", "_to", lambda a, b: (a - b) * (a - b))
    near = near.select(*keys, "target", "day", F.round(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)), 9).alias("distance"))
    order = Window.partitionBy(*keys, "target").orderBy("distance", F.desc("day"))  # limited to k before the shuffle
    return near.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k).select(*keys, "target", "day", "place", "distance")
