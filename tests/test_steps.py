"""Steps other than five minutes and an hour, stamps in common forms, windows over gaps, series without a forecast."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import series_df
from tidemark.functions.timefn import parse_timestamp
from tidemark.operators.decompose import decompose
from tidemark.operators.features import lag_rows, rows_in
from tidemark.operators.forecast import sequence_windows
from tidemark.sources.grids import forecast_dates, future_grid


def test_only_whole_lags_exist():
    assert rows_in(86400, 2400) == 36 and rows_in(3600, 2400) == 0 and rows_in(3600, 7200) == 0
    assert dict(lag_rows(7200)) == {"6h": 3, "12h": 6, "24h": 12, "7d": 84, "14d": 168, "30d": 360}
    assert dict(lag_rows(86400)) == {"24h": 1, "7d": 7, "14d": 14, "30d": 30}
    assert dict(lag_rows(604800)) == {"7d": 1, "14d": 2}


def test_grids_of_no_rows(spark):
    df = series_df(spark, [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-08 00:00:00", 2.0)])
    assert future_grid(df, 7, 604800).select("h", "ts").collect()[0]["h"] == 0
    assert future_grid(df, 6, 604800).count() == 0
    starts = df.select("series_id", F.col("ts").alias("start")).limit(1)
    assert forecast_dates(starts, days=0).count() == 0 and forecast_dates(starts, days=2).count() == 48


def test_odd_period_equals_pandas(spark):
    prices = [10 + i * 0.3 + [0, 1, 5, -2, 3, 0, -7][i % 7] + (i * 37 % 11) * 0.1 for i in range(60)]
    days = pd.date_range("2024-01-01", periods=60)
    df = series_df(spark, [("a", str(d), p) for d, p in zip(days, prices)]).withColumn("idx", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long"))
    got = decompose(df, 86400).orderBy("idx").toPandas()
    trend = pd.Series(prices).rolling(7, center=True).mean()
    assert (got.trend[3:57].to_numpy() - trend[3:57].to_numpy()).max() < 1e-9
    assert abs(got.seasonal[:7].sum()) < 1e-9 and (got.price - got.trend - got.seasonal - got.residual).abs().max() < 1e-9
    assert decompose(df, 5000).count() == 0


@pytest.mark.parametrize("text", ["1/24/24 0:05", "1/24/2024 0:05", "01/24/2024 00:05:00", "2024/01/24 00:05", "2024-01-24 00:05:00", "2024-01-24T00:05:00", "Jan 24 2024 00:05", "Jan 24, 2024 0:05", "24 Jan 2024 0:05", "1/24/2024 12:05 AM"])
def test_common_forms_of_stamps(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(parse_timestamp("t").cast("string").alias("t")).first()["t"]
    assert got == "2024-01-24 00:05:00"


def test_windows_keep_gaps(spark):
    df = spark.createDataFrame([("a", i, None if i == 3 else float(i)) for i in range(10)], "series_id string, idx long, price double")
    got = {r["idx"]: r["window"] for r in sequence_windows(df, seq_len=4).collect()}
    assert sorted(got) == [4, 5, 6, 7, 8, 9] and got[5] == [1.0, 2.0, None, 4.0]


def test_written_dates(spark):
    import datetime as dt

    from tidemark.functions.timefn import parse_timestamp

    day, minute = dt.datetime(2024, 1, 24), dt.datetime(2024, 1, 24, 0, 5)
    want = {
        "January 24, 2024": day, "24 January 2024": day, "20240124": day, "24/01/2024 00:05": minute, "24.1.2024": day, "1/24/24 0:05": minute,
        "2024-01-24 00:05:00": minute, "Jan 24, 2024 12:05 AM": minute, "3/4/2024": dt.datetime(2024, 3, 4), "13/13/2024": None, "no date": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", parse_timestamp("t").alias("ts"))
    assert {r["t"]: r["ts"] for r in df.collect()} == want


def test_a_series_on_the_step_keeps_its_phase(spark):
    import datetime as dt

    from tidemark.operators.clean import preprocess
    from tidemark.operators.resample import resample

    at = lambda minute, hours: [dt.datetime(2024, 1, 1, 0, minute) + dt.timedelta(hours=i) for i in hours]
    stamps = {"half": at(30, [0, 1, 2, 4, 5]), "seven": at(7, range(6)), "full": at(0, range(4)), "fine": [dt.datetime(2024, 1, 1, 0, 10 * i) for i in range(6)], "one": at(44, [0])}
    rows = [(s, t, float(i)) for s, ts in stamps.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, price double")
    got = {}
    for r in resample(df, 3600).orderBy("ts").collect():
        got.setdefault(r["series_id"], []).append((r["ts"], r["price"], r["idx"]))
    assert got["half"] == [(t, p, i) for i, (t, p) in enumerate(zip(at(30, range(6)), [0.0, 1.0, 2.0, None, 3.0, 4.0]))]
    assert [t for t, _, _ in got["seven"]] == stamps["seven"] and [t for t, _, _ in got["full"]] == stamps["full"]
    assert got["fine"] == [(dt.datetime(2024, 1, 1), 2.5, 0)]
    assert {r["ts"] for r in preprocess(df, 3600).filter("series_id = 'half'").collect()} == set(at(30, range(6)))
