"""Exact quantiles per series without sorting or gathering a series (A3).

Linear-interpolated quantiles (pandas ``quantile``, SQL ``quantile_cont``):
for ``n`` values and probability ``p`` the answer lies between the values of
0-based ranks ``floor(p(n-1))`` and ``ceil(p(n-1))``.

Method ``bracket`` (default), two passes and no sort of the data:

1. ``percentile_approx`` (a mergeable sketch, partial-aggregated before the
   shuffle, rank error at most ``n / accuracy``) at ``p -/+ margin`` gives two
   values that bracket both target ranks (series of fewer than
   ``accuracy / 2`` rows take an open bracket).
2. One aggregation over ``(series, p, value)`` where every value below the
   bracket is mapped to one NULL group (its count is the number of smaller
   values), values above are skipped, values inside keep their own group.
   Map-side combining collapses the below-bracket rows before the shuffle.
3. A window over the bracket's distinct values (about ``n / accuracy`` per
   series) turns counts into rank ranges; the two target ranks are looked up.

Method ``rank`` ranks every value with a range partition (exact, but sorts
all data); kept for comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import materialize, row_position
from ..session import SERIES

ACCURACY = 100_000
MARGIN_ERRORS = 8  # bracket half-width in sketch error units


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (SERIES,),
    prefix: str = "q",
    method: str = "bracket",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Output: ``keys, n, <prefix><p*100>`` per prob."""
    v = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    if method == "rank":
        q = _by_rank(v, probs, keys)
    else:
        q = _by_bracket(v, probs, keys, accuracy)
    aggs = [F.first(F.when(F.col("p") == float(p), F.col("qv")), True).alias(f"{prefix}{_label(p)}") for p in probs]
    return q.groupBy(*keys).agg(F.first("n").alias("n"), *aggs)


def _targets(n_df: DataFrame, probs: Sequence[float], keys: Sequence[str], extra=None) -> DataFrame:
    rows = []
    for i, p in enumerate(probs):
        fields = [F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")]
        if extra is not None:
            fields += extra(i)
        rows.append(F.struct(*fields))
    t = n_df.select(*keys, "n", F.explode(F.array(*rows)).alias("_t")).select(*keys, "n", "_t.*")
    return t.withColumn("lo", F.floor("pos").cast("long")).withColumn("hi", F.ceil("pos").cast("long"))


def _by_bracket(v: DataFrame, probs: Sequence[float], keys: Sequence[str], accuracy: int) -> DataFrame:
    m = MARGIN_ERRORS / float(accuracy)
    qs = []
    for p in probs:
        qs += [max(0.0, p - m), min(1.0, p + m)]
    sk = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", qs, accuracy).alias("_b"))
    # A series shorter than ~4/margin rows (at most accuracy/2) gets an open
    # bracket (NULL bounds): the margin would span under one rank there, and
    # all its values fit the exact step anyway.
    short = F.col("n") * F.lit(m) < 4
    t = _targets(
        sk,
        probs,
        keys,
        lambda i: [
            F.when(~short, F.col("_b")[2 * i]).alias("blo"),
            F.when(~short, F.col("_b")[2 * i + 1]).alias("bhi"),
        ],
    )
    # rows pair with each prob of their series; values above the bracket drop out
    j = v.join(t.select(*keys, "p", "blo", "bhi"), list(keys)).filter(F.col("bhi").isNull() | (F.col("_v") <= F.col("bhi")))
    inb = F.col("blo").isNull() | (F.col("_v") >= F.col("blo"))
    grouped = j.groupBy(*keys, "p", F.when(inb, F.col("_v")).alias("bv")).agg(F.count(F.lit(1)).alias("c"))
    # small (one row per bracket value) and read by several branches below
    grouped = materialize(grouped)
    below = grouped.filter(F.col("bv").isNull()).select(*keys, "p", F.col("c").alias("below"))
    inside = grouped.filter(F.col("bv").isNotNull())
    w = Window.partitionBy(*keys, "p").orderBy("bv").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    inside = inside.join(below, [*keys, "p"], "left").withColumn(
        "r0", F.coalesce(F.col("below"), F.lit(0)) + F.col("_before")
    ).withColumn("r1", F.col("r0") + F.col("c") - 1)
    tt = t.select(*keys, "n", "p", "pos", "lo", "hi")
    lo = tt.join(inside.select(*keys, "p", "r0", "r1", F.col("bv").alias("vlo")), [*keys, "p"]).filter(
        (F.col("lo") >= F.col("r0")) & (F.col("lo") <= F.col("r1"))
    ).select(*keys, "p", "vlo")
    hi = tt.join(inside.select(*keys, "p", "r0", "r1", F.col("bv").alias("vhi")), [*keys, "p"]).filter(
        (F.col("hi") >= F.col("r0")) & (F.col("hi") <= F.col("r1"))
    ).select(*keys, "p", "vhi")
    q = tt.join(lo, [*keys, "p"], "left").join(hi, [*keys, "p"], "left")
    return q.withColumn("qv", F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("pos") - F.col("lo")))


def _by_rank(v: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    ranked = row_position(v, ["_v"], keys, "_r")
    n = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = _targets(n, probs, keys)
    need = t.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_r")).distinct()
    picked = ranked.join(need, [*keys, "_r"], "left_semi")
    lo = picked.select(*keys, F.col("_r").alias("lo"), F.col("_v").alias("vlo"))
    hi = picked.select(*keys, F.col("_r").alias("hi"), F.col("_v").alias("vhi"))
    q = t.join(lo, [*keys, "lo"]).join(hi, [*keys, "hi"])
    return q.withColumn("qv", F.col("vlo") + (F.col("vhi") - F.col("vlo")) * (F.col("pos") - F.col("lo")))


def _label(p: float) -> str:
    return f"{p * 100:g}".replace(".", "_")
