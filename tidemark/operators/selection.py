"""Choosing inputs by rank correlation with the target: average ranks with ties, Spearman's coefficient, selection.

Ranks are those of the distinct values: rows are first counted per value (combined before the shuffle), the values of a
group are cut at quantiles of a mergeable sketch, and a running count inside a cut plus the counts of the cuts
before it gives the places, so no task holds a group's values in full.  The coefficient is the correlation of the average
ranks over the rows in which both columns are present (NULL and NaN are absent), per series.

Defined cases: fewer than two rows, or a column with one value, give a NULL coefficient, which is never selected; equal
strengths are ordered by name; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import _EDGES, _SKETCH, _edges_below, materialize
from ..session import PRICE, SERIES


def average_ranks(counts: DataFrame, group: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """``counts`` (one row per group and distinct value, ``n`` rows each) with ``rank``: the mean place of the equal rows, from 1."""
    quantiles = F.percentile_approx(value, [i / (_EDGES + 1) for i in range(1, _EDGES + 1)], _SKETCH)
    edges = counts.groupBy(*group).agg(F.array_distinct(quantiles).alias("_edges"))
    d = counts.join(edges, list(group)).withColumn("_cut", _edges_below(F.col("_edges"), F.col(value))).drop("_edges")
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)  # at most _EDGES + 1 rows a group
    cuts = d.groupBy(*group, "_cut").agg(F.sum(n).alias("_cn"))
    cuts = cuts.select(*group, "_cut", F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_cut").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_upto", F.sum(n).over(inside)).join(cuts, [*group, "_cut"])
    return d.withColumn("rank", F.col("_before") + F.col("_upto") - (F.col(n) - 1) / 2.0).drop("_before", "_upto", "_cut")


def spearman(df: DataFrame, features: Sequence[str], target: str = PRICE, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """``keys, feature, n, rho``: Spearman's coefficient of every feature with the target, ties at their average rank."""
    group = [*keys, "feature"]
    present = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0))
    dealt = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), present(f).alias("x"), present(target).alias("y")) for f in features]))
    pairs = df.select(*keys, dealt.alias("_p")).select(*keys, "_p.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    pairs = materialize(pairs.groupBy(*group, "x", "y").agg(F.count(F.lit(1)).alias("n")))
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("x", "y")]))
    values = pairs.select(*group, "n", ends.alias("_e")).groupBy(*group, "_e.side", "_e.value").agg(F.sum("n").alias("n"))
    ranks = materialize(average_ranks(values, [*group, "side"]))
    # the mean rank of n rows is (n + 1) / 2 with any ties, so deviations need no pass of their own
    total = ranks.filter("side = 'x'").groupBy(*group).agg(F.sum("n").alias("_rows"))
    ranks = ranks.join(total, group).withColumn("dev", F.col("rank") - (F.col("_rows") + 1) / 2.0)
    spread = ranks.groupBy(*group).agg(
        F.first("_rows").alias("n"),
        *[F.sum(F.when(F.col("side") == s, F.col("n") * F.col("dev") * F.col("dev"))).alias(f"_s{s}") for s in ("x", "y")],
    )
    of = lambda s: ranks.filter(F.col("side") == s).select(*group, F.col("value").alias(s), F.col("dev").alias(f"_d{s}"))
    both = pairs.join(of("x"), [*group, "x"]).join(of("y"), [*group, "y"])
    shared = both.groupBy(*group).agg(F.sum(F.col("n") * F.col("_dx") * F.col("_dy")).alias("_sxy"))
    rho = F.when((F.col("_sx") > 0) & (F.col("_sy") > 0), F.col("_sxy") / F.sqrt("_sx") / F.sqrt("_sy"))
    return spread.join(shared, group).select(*group, F.col("n").cast("long").alias("n"), rho.alias("rho"))


def select_features(
    df: DataFrame, features: Sequence[str], target: str = PRICE, keys: Sequence[str] = (SERIES,), least: float = 0.0, top: int | None = None
) -> DataFrame:
    """:func:`spearman` with ``place`` (by strength, ties by name) and ``selected``: ``|rho| >= least`` and, if given, among the ``top``."""
    found = spearman(df, features, target, keys)
    order = Window.partitionBy(*keys).orderBy(F.abs("rho").desc_nulls_last(), "feature")  # one row per feature
    found = found.withColumn("place", F.row_number().over(order).cast("long"))
    chosen = F.coalesce(F.abs("rho") >= least, F.lit(False))
    return found.withColumn("selected", chosen & (F.col("place") <= top) if top else chosen)
