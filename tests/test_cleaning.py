"""Fill, resample, outliers, validation against pandas and hand-worked values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import series_df
from tidemark.operators import clean
from tidemark.operators.fill import fill_time_linear
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.resample import resample, resample_interpolate, resample_mean
from tidemark.operators.step import detect_step


def _pd_fill(s: pd.Series) -> pd.Series:
    return s.interpolate(method="time").ffill().bfill()


def test_fill_leading_inner_trailing(spark):
    rows = [
        ("a", "2024-01-01 00:00:00", None),
        ("a", "2024-01-01 01:00:00", 10.0),
        ("a", "2024-01-01 02:00:00", None),
        ("a", "2024-01-01 04:00:00", 16.0),
        ("a", "2024-01-01 05:00:00", None),
        ("b", "2024-01-01 00:00:00", None),
    ]
    out = {(r.series_id, r.ts.hour): r.price for r in fill_time_linear(series_df(spark, rows)).collect()}
    assert out[("a", 0)] == 10.0  # leading gap: next value
    assert out[("a", 2)] == pytest.approx(12.0)  # linear in time (1h of 3h)
    assert out[("a", 5)] == 16.0  # trailing gap: last value
    assert out[("b", 0)] is None  # all NULL stays NULL


def test_fill_matches_pandas(spark):
    rng = np.random.default_rng(5)
    idx = pd.date_range("2024-01-01", periods=200, freq="h").delete(rng.choice(200, 30, replace=False))
    vals = rng.normal(20, 5, len(idx))
    vals[rng.random(len(idx)) < 0.3] = np.nan
    s = pd.Series(vals, index=idx)
    rows = [("x", str(t), None if np.isnan(v) else float(v)) for t, v in s.items()]
    got = fill_time_linear(series_df(spark, rows)).toPandas().set_index("ts")["price"].sort_index()
    want = _pd_fill(s)
    np.testing.assert_allclose(got.values, want.values, rtol=1e-12)


def test_resample_regular_is_identity(spark):
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(i)) for i in range(50)]
    df = series_df(spark, rows)
    out = resample(df, 3600).orderBy("ts").toPandas()
    assert list(out["price"]) == [float(i) for i in range(50)]


def test_resample_mean_and_gaps(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("a", "2024-01-01 02:20:00", 5.0)]
    out = resample_mean(series_df(spark, rows), 3600).orderBy("ts").toPandas()
    assert list(out["price"].fillna(-1)) == [2.0, -1, 5.0]
    assert list(out["idx"]) == [0, 1, 2]


def test_upsample_daily_matches_pandas(spark):
    idx = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-04"])
    s = pd.Series([1.0, 3.0, 9.0], index=idx)
    rows = [("d", str(t), v) for t, v in s.items()]
    got = resample_interpolate(series_df(spark, rows), 3600).orderBy("ts").toPandas()["price"].values
    want = s.resample("h").interpolate(method="time").values
    np.testing.assert_allclose(got, want)


def test_detect_step_tie_takes_smaller(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 03:00:00", 1.0)]
    r = detect_step(series_df(spark, rows)).first()
    assert r.step_seconds == 3600.0 and r.n_steps == 2 and not r.is_regular


def test_quantiles_match_pandas(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(rng.normal())) for i in range(301)]
    df = series_df(spark, rows)
    got = {r.series_id: (r.q25, r.q75) for r in exact_quantiles(df, "price", [0.25, 0.75]).collect()}
    pdf = pd.DataFrame(rows, columns=["series_id", "ts", "price"])
    for sid, g in pdf.groupby("series_id"):
        assert got[sid][0] == pytest.approx(g.price.quantile(0.25))
        assert got[sid][1] == pytest.approx(g.price.quantile(0.75))


def test_outlier_repair_identity_when_nothing_outside(spark):
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(i % 7)) for i in range(60)]
    df = series_df(spark, rows)
    out = clean.repair_outliers(df).orderBy("ts").toPandas()
    assert list(out["price"]) == [float(i % 7) for i in range(60)]


def test_outlier_repaired_by_interpolation(spark):
    vals = [10.0, 11.0, 10.0, 12.0, 1000.0, 12.0, 11.0, 10.0]
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), v) for i, v in enumerate(vals)]
    out = clean.repair_outliers(series_df(spark, rows)).orderBy("ts").toPandas()
    assert out["price"][4] == pytest.approx(12.0)


def test_validate_verdicts(spark):
    raw = spark.createDataFrame(
        [("ok", "2024-01-01 00:00:00", "1.5"), ("ok", "2024-02-05 00:00:00", "2"), ("short", "1/24/24 0:05", "3"),
         ("short", "1/25/24 0:05", "4"), ("badp", "2024-01-01 00:00:00", "abc"), ("badt", "yesterday", "1")],
        "series_id string, timestamp string, price string",
    )
    v = {r.series_id: r for r in clean.validate_series(raw).collect()}
    assert v["ok"].is_valid and v["ok"].span_days == 35
    assert not v["short"].is_valid and v["short"].message.startswith("Data spans only 1 days")
    assert v["badp"].message == clean.MSG_BAD_PRICE
    assert v["badt"].message == clean.MSG_BAD_TS
    missing = clean.validate_series(raw.drop("price")).first()
    assert missing.message == "Missing required column: price"


def test_span_29d23h_vs_30d(spark):
    raw = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", "1"), ("a", "2024-01-30 23:00:00", "1"), ("b", "2024-01-01 00:00:00", "1"), ("b", "2024-01-31 00:00:00", "1")],
        "series_id string, timestamp string, price string",
    )
    v = {r.series_id: r.is_valid for r in clean.validate_series(raw).collect()}
    assert v == {"a": False, "b": True}


def test_null_census_and_extreme(spark):
    rows = [("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 01:00:00", 2e10)]
    df = series_df(spark, rows)
    c = clean.null_census(df).first()
    assert c.n_null == 1 and c.n_rows == 2
    assert clean.flag_extreme(df).first().is_extreme


def test_splits(spark):
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(i)) for i in range(11)]
    df = series_df(spark, rows)
    a = clean.split_chronological(df).filter(F.col("part") == "train").count()
    b = clean.split_xy(df).filter(F.col("part") == "train").count()
    assert a == 8 and b == 8  # floor(11*0.8) = 8; 11 - ceil(2.2) = 8


@pytest.mark.parametrize("method,accuracy", [("bracket", 100), ("bracket", 100_000), ("rank", 0)])
def test_quantiles_exact_in_sketch_error_regime(spark, method, accuracy):
    """A coarse sketch (rank error n/100) must still give exact quartiles, ties included."""
    rng = np.random.default_rng(11)
    n = 20_000
    vals = np.concatenate([np.round(rng.normal(0, 3, n // 2)), rng.exponential(2.0, n // 2)])
    pdf = pd.DataFrame({"series_id": np.where(np.arange(n) % 5 == 0, "small", "big"), "price": vals})
    df = spark.createDataFrame(pdf)
    kw = {"method": method} if method == "rank" else {"method": method, "accuracy": accuracy}
    got = {r.series_id: r for r in exact_quantiles(df, "price", [0.25, 0.5, 0.75], **kw).collect()}
    for sid, g in pdf.groupby("series_id"):
        for p, col in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert getattr(got[sid], col) == pytest.approx(g.price.quantile(p), rel=1e-12, abs=1e-12), (sid, p)


def test_quantiles_short_series_and_nulls(spark):
    rows = []
    for n in (1, 2, 3, 7, 678):
        for i in range(n):
            rows.append((f"n{n}", float((i * 37) % 11) if i % 9 else None))
    pdf = pd.DataFrame(rows, columns=["series_id", "price"])
    got = {r.series_id: r for r in exact_quantiles(spark.createDataFrame(pdf.astype({"price": "float64"})), "price", [0.25, 0.75]).collect()}
    for sid, g in pdf.groupby("series_id"):
        if g.price.notna().any():
            assert got[sid].q25 == pytest.approx(g.price.quantile(0.25))
            assert got[sid].q75 == pytest.approx(g.price.quantile(0.75))


def test_validate_empty_input(spark):
    raw = spark.createDataFrame([], "series_id string, timestamp string, price string")
    assert clean.validate_series(raw).first().message == clean.MSG_EMPTY
