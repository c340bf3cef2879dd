"""Catalog round trip and cascade; the driver contract; plan shape checks."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, series_df


def test_catalog_round_trip_and_cascade(spark, tmp_path):
    from tidemark.operators.catalog import Catalog

    cat = Catalog(spark, str(tmp_path / "cat"))
    assert cat.initialize()
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(i)) for i in range(10)]
    d1 = cat.save_dataset(series_df(spark, rows), "one")
    d2 = cat.save_dataset(series_df(spark, rows), "two")
    assert (d1, d2) == (1, 2)
    assert cat.load_dataset(d1).count() == 10
    fc = series_df(spark, rows).withColumnRenamed("price", "predicted").withColumn("actual", F.col("predicted"))
    f1 = cat.save_forecast(d2, fc, None, None, "fc", 3, 90, ["m1", "m2"])
    assert cat.list_forecasts(d2).first().models_used == "m1,m2"
    assert cat.describe_forecasts().first()["Confidence Interval"] == "90%"
    assert cat.delete_dataset(d2) is True
    assert cat.delete_dataset(d2) is False
    assert cat.list_forecasts().count() == 0  # cascade
    assert cat.load_forecast(f1) == (None, None, None)
    assert cat.load_dataset(d2).count() == 0
    assert [r.id for r in cat.list_datasets().collect()] == [1]
    removed = cat.vacuum()
    assert any("dataset_id=2" in p for p in removed)
    assert cat.describe_datasets().first()["External Features"] == "No"


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["hourly_spike_report", "fill_time_linear", "decompose", "forecast_trend_seasonal", "align_to"])
def test_oracle_agrees_small(spark, name):
    import __spark_entry__ as E

    got = E.queries()[name](spark, SF_SMALL).toPandas()
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = got[cols].sort_values(cols).reset_index(drop=True)
    b = want[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_plan_windows_keyed_and_scan_pruned(spark):
    import __spark_entry__ as E

    df = E.queries()["many_series_features"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # every window is partitioned (series bucket), none over the whole input
    for line in plan.splitlines():
        if line.strip().startswith("+- Window [") or line.strip().startswith("Window ["):
            assert "series_id" in line, line
    # the derivation of the per-user series reads only the three columns it needs
    from pyspark.sql import functions as F

    from tidemark.operators.resample import resample_mean
    from tidemark.sources.fixtures import table

    ev = table(spark, SF_SMALL, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", F.col("value").alias("price"))
    scan = resample_mean(ev, 3600)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in scan


def test_json_column_layout(spark, tmp_path):
    import json

    from tidemark.sources.files import read_series_json

    obj = {"timestamp": {"0": "2024-01-01 00:00:00", "1": "2024-01-01 01:00:00", "2": 1704074400000},
           "price": {"0": 1.5, "1": 2.5, "2": 3.5}, "load": {"0": 10, "1": 11, "2": 12}}
    p = tmp_path / "cols.json"
    p.write_text(json.dumps(obj))
    got = read_series_json(spark, str(p), layout="columns").orderBy("ts").toPandas()
    assert list(got["price"]) == [1.5, 2.5, 3.5]
    assert list(got["load"]) == [10.0, 11.0, 12.0]
    assert str(got["ts"].iloc[2]) == "2024-01-01 02:00:00"


def test_catalog_forecast_delete_and_filter(spark, tmp_path):
    from tidemark.operators.catalog import Catalog

    cat = Catalog(spark, str(tmp_path / "cat2"))
    rows = [("a", str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)), float(i)) for i in range(5)]
    df = series_df(spark, rows)
    d1, d2 = cat.save_dataset(df, "one", step_seconds=3600), cat.save_dataset(df, "two")
    fc = df.withColumnRenamed("price", "predicted").withColumn("actual", F.lit(None).cast("double"))
    f1 = cat.save_forecast(d1, fc, name="f1")
    f2 = cat.save_forecast(d2, fc, name="f2")
    assert {r.id for r in cat.list_forecasts(d1).collect()} == {f1}  # optional filter (P12)
    assert cat.delete_forecast(f1) and not cat.delete_forecast(f1)
    assert {r.id for r in cat.list_forecasts().collect()} == {f2}
    assert cat.get_dataset(d1).first().step_seconds == 3600
    assert cat.load_forecast_with_history(f2).count() == 5  # J7: the dataset rows behind a forecast


def test_facts_of_a_failed_save_do_not_reach_the_next(spark, tmp_path, monkeypatch):
    from tests.conftest import series_df
    from tidemark.operators.catalog import Catalog

    cat = Catalog(spark, str(tmp_path / "cat"))
    five = series_df(spark, [("a", f"2024-01-0{i} 00:00:00", i) for i in range(1, 6)])
    three = five.limit(3)

    def die(*_):
        raise OSError("lost before the header")

    with monkeypatch.context() as m:
        m.setattr(Catalog, "_append", die)
        try:
            cat.initialize()
            cat.save_dataset(five, "lost")
        except OSError:
            pass
    did = cat.save_dataset(three, "kept")
    assert cat.load_dataset(did).count() == 3
    assert cat.save_dataset(five, "again", dataset_id=did) == did
    assert cat.load_dataset(did).count() == 5
