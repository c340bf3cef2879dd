"""Frames over time: irregular stamps against pandas, mixed steps against one plan per step, buckets against no buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import series_df
from tidemark.operators.decompose import decompose, decompose_by_step
from tidemark.operators.features import engineer_features
from tidemark.plans.ordered import BUCKET
from tidemark.plans.spans import SpanLag, SpanRoll, span_features, with_time_halo

HOUR = 3600


def regular(name, step, rows, seed=0):
    rnd = np.random.default_rng(seed)
    stamps = pd.date_range("2023-03-01", periods=rows, freq=f"{step}s")
    return [(name, str(t), float(v), float(i)) for i, (t, v) in enumerate(zip(stamps, rnd.normal(50, 9, rows)))]


def frame_of(spark, rows):
    return series_df(spark, rows, ("idx",)).withColumn("idx", F.col("idx").cast("long"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_irregular_stamps_equal_pandas_time_windows(spark, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for name, spread in (("dense", 40), ("sparse", 90_000), ("bursts", 3_000_000)):
        at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.unique(np.cumsum(rnd.exponential(spread, 150).astype(int) + 1)), unit="s")
        rows += [(name, str(t), None if rnd.random() < 0.1 else float(v)) for t, v in zip(at, rnd.normal(0, 5, len(at)))]
    df = series_df(spark, rows)
    stats = ("mean", "std", "min", "max")
    rolls = [SpanRoll("price", s, tuple((k, f"{k}_{s}") for k in stats)) for s in (600, 86400)]
    got = span_features(df, [SpanLag("lag", "price", 60)], rolls).toPandas().sort_values(["series_id", "ts"])
    for name, g in got.groupby("series_id"):
        g = g.set_index("ts")
        for s in (600, 86400):
            r = g["price"].rolling(f"{s}s", min_periods=1)
            for k in stats:
                np.testing.assert_allclose(g[f"{k}_{s}"].to_numpy(float), getattr(r, k)().to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{name} {k}")
        before = g["price"].reindex(g.index - pd.Timedelta(seconds=60)).to_numpy(float)
        np.testing.assert_allclose(g["lag"].to_numpy(float), before)


def test_a_row_is_copied_at_most_once_per_side_and_buckets_change_nothing(spark):
    df = frame_of(spark, regular("a", HOUR, 500)).withColumn("at", F.col("idx") * 10 - 777)  # positions below zero, too
    placed = with_time_halo(df, "at", 240, 100, 480)
    assert placed.filter(~F.col("_halo")).count() == 500
    assert placed.groupBy("idx").count().agg(F.max("count")).first()[0] <= 3
    for r in placed.filter("_halo").select("at", BUCKET).collect():
        start = r[BUCKET] * 480
        assert start - 240 <= r["at"] < start or start + 480 <= r["at"] < start + 580


def test_null_stamps_equal_stamps_and_no_rows(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 2.0), ("a", "2024-01-01 01:00:00", 5.0), ("a", "2024-01-01 02:00:00", 7.0)]
    df = series_df(spark, rows).unionByName(series_df(spark, [("a", "2024-01-01 00:00:00", 9.0)]).withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    out = span_features(df, [SpanLag("lag", "price", HOUR)], [SpanRoll("price", HOUR + 1, (("mean", "m"), ("count", "n")))])
    got = {(r["ts"].hour if r["ts"] else None, r["price"]): (r["lag"], r["m"], r["n"]) for r in out.collect()}
    assert got == {(0, 1.0): (None, 1.0, 1), (1, 2.0): (1.0, 8 / 3, 3), (1, 5.0): (1.0, 8 / 3, 3), (2, 7.0): (5.0, 14 / 3, 3), (None, 9.0): (None, None, None)}
    assert span_features(df.limit(0), [SpanLag("lag", "price", HOUR)]).count() == 0


def test_decomposition_of_mixed_steps_equals_one_plan_per_step(spark):
    sizes = {"h": (HOUR, 400), "2h": (2 * HOUR, 200), "d": (86400, 40), "short": (HOUR, 300), "odd": (5 * HOUR, 300), "week": (604800, 30)}
    rows = [r for i, (n, (step, k)) in enumerate(sizes.items()) for r in regular(n, step, k, i)]
    df = frame_of(spark, rows)
    step = F.element_at(F.create_map(*[F.lit(x) for n, (s, _) in sizes.items() for x in (n, s)]), F.col("series_id"))
    got = decompose_by_step(df.withColumn("step_seconds", step)).toPandas().sort_values(["series_id", "idx"])
    assert set(got["series_id"]) == {"h", "2h", "d"}
    for n in ("h", "2h", "d"):
        want = decompose(df.filter(F.col("series_id") == n), sizes[n][0]).toPandas().sort_values("idx")
        for c in ("trend", "seasonal", "residual"):
            np.testing.assert_allclose(got[got["series_id"] == n][c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_features_of_mixed_steps_equal_one_plan_per_step(spark):
    sizes = {"h": (HOUR, 900), "2h": (2 * HOUR, 500), "six": (6 * HOUR, 150)}
    df = frame_of(spark, [r for i, (n, (step, k)) in enumerate(sizes.items()) for r in regular(n, step, k, i)])
    df = df.withColumn("load", F.col("price") * 2 + F.col("idx"))
    one = df.limit(0).unionByName(frame_of(spark, [("one", "2024-01-01 00:00:00", 1.0, 0.0)]).withColumn("load", F.lit(1.0)))
    feats, _ = engineer_features(df.unionByName(one), None)
    got = feats.toPandas().sort_values(["series_id", "idx"])
    assert set(got["series_id"]) == set(sizes)  # a series of one stamp has no step and no rows
    for n, (step, _) in sizes.items():
        want = engineer_features(df.filter(F.col("series_id") == n), step)[0].toPandas().sort_values("idx")
        mine = got[got["series_id"] == n]
        assert len(want) and list(mine["idx"]) == list(want["idx"])
        for c in want.columns:
            if c not in ("series_id", "ts"):
                np.testing.assert_allclose(mine[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-8, atol=1e-8, err_msg=f"{n} {c}")
        absent = [c for c in mine.columns if c not in want.columns]
        assert all(mine[c].isna().all() for c in absent)


def test_one_order_for_all_lags_and_frames(spark):
    df = frame_of(spark, regular("a", HOUR, 50))
    rolls = [SpanRoll("price", d * 86400, (("mean", f"m{d}"), ("max", f"x{d}"))) for d in (1, 7, 30)]
    plan = span_features(df, [SpanLag(f"l{h}", "price", h * HOUR) for h in (1, 24)], rolls)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
