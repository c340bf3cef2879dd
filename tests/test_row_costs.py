"""The steps that every row of a dense series passes: one order for the fill, plain columns in the ladder, no decimal per rounding."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans.ordered import carry_present
from tidemark.plans.rolling import Lag, Roll, ordered_features
from tidemark.sources.grids import dense_grid

STATS = ("mean", "std", "min", "max")


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def _series(spark, values):
    pdf = pd.DataFrame({"series_id": "s", "idx": np.arange(len(values), dtype="int64"), "price": values})
    return spark.createDataFrame(pdf).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(idx as int))"))


def test_fill_orders_the_rows_once(spark):
    df = _series(spark, [1.0, np.nan, 3.0])
    plan = carry_present(df, ["price"], "ts")._jdf.queryExecution().executedPlan().toString()
    by_time = [line for line in plan.splitlines() if "Sort [" in line and "ts#" in line]
    assert len(by_time) == 1, plan


def test_ladder_looks_up_plain_columns(spark):
    rolls = [Roll("price", k, tuple((s, f"{s}_{k}") for s in STATS)) for k in (24, 168)]
    plan = _plan(ordered_features(_series(spark, [1.0, 2.0]), [Lag("l", "price", 1)], rolls))
    assert "struct(" not in plan


@pytest.mark.parametrize("k", [66, 168, 720])
def test_ladder_of_equal_and_of_missing_values(spark, k):
    """Equal values have a deviation of exactly 0, also around gaps; a frame without values has no statistics."""
    n = 3 * k
    values = np.full(n, 5.25)
    values[: k + 7] = np.nan
    values[k + 40 : k + 47] = np.nan
    roll = [Roll("price", k, (*((s, s) for s in STATS), ("count", "count"), ("sum", "sum")))]
    got = ordered_features(_series(spark, values), rolls=roll, bucket_rows=k, method="ladder").orderBy("idx").toPandas()
    count = pd.Series(values).notna().rolling(k, min_periods=1).sum().astype(int)
    assert list(got["count"]) == list(count)
    some = count.values > 0
    for c in ("mean", "min", "max"):
        assert (got[c].values[some] == 5.25).all() and got[c].isna().values[~some].all(), c
    assert (got["std"].values[count.values > 1] == 0.0).all() and got["std"].isna().values[count.values < 2].all()
    np.testing.assert_allclose(got["sum"].values[some], 5.25 * count.values[some], rtol=1e-12)


def test_rounding_equals_round(spark):
    from tidemark.plans.registry import rounded

    odd = [float("nan"), float("inf"), -float("inf"), None, 0.0, -1e-9, 0.5e-6, 1.5e-6, -2.5e-6, 1e300, -1e12, 4.5e8, 999999.9999995]
    x = spark.createDataFrame([(v,) for v in odd], "x double")
    x = x.unionByName(spark.range(20_000).select((F.col("id") / 8_000_000.0 - 0.001).alias("x")))  # every fourth one ends on a tie
    x = x.unionByName(spark.range(20_000).select(((F.rand(1) - 0.5) * F.pow(F.lit(10.0), F.rand(2) * 24 - 8)).alias("x")))
    for digits in (2, 4, 6):
        differ = ~rounded(F.col("x"), digits).eqNullSafe(F.round("x", digits))
        assert x.filter(differ).count() == 0


def test_halo_copies_to_both_sides(spark):
    from tidemark.plans.ordered import with_halo

    bounds = spark.sql("select 's' series_id, timestamp_ntz'2024-01-01' t0, timestamp_ntz'2024-01-01 19:00:00' t1")
    got = with_halo(dense_grid(bounds, 3600), 3, 2, 4).toPandas()
    want = {(i, i // 4, False) for i in range(20)}
    want |= {(i, i // 4 + 1, True) for i in range(20) if i % 4 >= 1} | {(i, i // 4 - 1, True) for i in range(20) if i % 4 < 2}
    assert sorted(zip(got["idx"], got["_bucket"], got["_halo"])) == sorted(want)


def test_fill_of_a_row_without_a_stamp(spark):
    """It lies before the series and takes the first stamped value, not that of another row without a stamp."""
    from tidemark.operators.fill import fill_time_linear

    rows = "values (0, null, null), (1, null, 9.0D), (2, '2024-01-01 00:00:00', null), (3, '2024-01-01 01:00:00', 5.0D) as r(k, t, price)"
    df = spark.sql(f"select 's' series_id, k, cast(t as timestamp_ntz) ts, price from {rows}").coalesce(1)
    got = {r.k: r.price for r in fill_time_linear(df).collect()}
    assert got[0] == got[3] == 5.0 and got[1] == 9.0
