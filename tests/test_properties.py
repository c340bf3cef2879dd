"""Seeded property checks: order, independence, invariants, plan shape."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import series_df
from tidemark.operators import features as fe
from tidemark.operators.decompose import decompose
from tidemark.operators.fill import fill_time_linear
from tidemark.operators.resample import resample_mean
from tidemark.plans.ordered import materialize


def _rows(seed, sid, n, null_frac=0.3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = float(rng.normal(40, 8))
        out.append((sid, str(pd.Timestamp("2024-02-01") + pd.Timedelta(hours=i)), None if rng.random() < null_frac else v))
    return out


def _sorted(df, cols):
    return df.select(*cols).orderBy(*cols[:2]).toPandas().reset_index(drop=True)


def test_fill_keeps_present_values_and_leaves_no_null(spark):
    df = series_df(spark, _rows(1, "a", 400))
    out = fill_time_linear(df).toPandas().set_index("ts")
    src = df.toPandas().set_index("ts")
    present = src["price"].notna()
    assert out["price"].isna().sum() == 0
    np.testing.assert_array_equal(out.loc[src.index[present], "price"].values, src.loc[present, "price"].values)


def test_series_together_equal_series_alone(spark):
    a = series_df(spark, _rows(2, "a", 500))
    b = series_df(spark, _rows(3, "b", 200))
    both = fe.rolling_features(fill_time_linear(resample_mean(a.unionByName(b), 3600)), 3600)
    alone = fe.rolling_features(fill_time_linear(resample_mean(a, 3600)), 3600).unionByName(
        fe.rolling_features(fill_time_linear(resample_mean(b, 3600)), 3600)
    )
    cols = ["series_id", "ts", "price", "price_rolling_mean_7d", "price_rolling_std_1d", "price_rolling_max_30d"]
    pd.testing.assert_frame_equal(_sorted(both, cols), _sorted(alone, cols))


def test_input_order_does_not_matter(spark):
    rows = _rows(4, "a", 300) + _rows(5, "b", 250)
    df1 = series_df(spark, rows)
    df2 = series_df(spark, list(reversed(rows))).repartition(7)
    f = lambda d: fe.lag_features(fill_time_linear(resample_mean(d, 3600)), 3600)
    cols = ["series_id", "ts", "price", "price_lag_1h", "price_lag_7d"]
    pd.testing.assert_frame_equal(_sorted(f(df1), cols), _sorted(f(df2), cols))


def test_seasonal_phases_sum_to_zero(spark):
    df = fill_time_linear(resample_mean(series_df(spark, _rows(6, "a", 24 * 15, 0.1)), 3600))
    dec = decompose(df, 3600)
    s = dec.withColumn("ph", F.col("idx") % 168).groupBy("ph").agg(F.first("seasonal").alias("s")).agg(F.sum("s")).first()[0]
    assert abs(s) < 1e-9


def test_feature_pass_shuffles_the_data_once(spark):
    base = materialize(fill_time_linear(resample_mean(series_df(spark, _rows(7, "a", 900)), 3600)))
    out = fe.rolling_features(fe.lag_features(base, 3600), 3600)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    # lags and rolling statistics: one bucketed pass each, every exchange keyed by (series_id, bucket)
    assert all("series_id" in ln and "_bucket" in ln for ln in exchanges), exchanges
    assert len(exchanges) <= 2
