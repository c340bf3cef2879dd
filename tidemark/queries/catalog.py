"""Catalog queries: save, list, describe, load, delete with cascade (whole tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.catalog import Catalog
from ..operators.evaluate import forecast_metrics
from ..plans import sqlref as S
from ..plans.registry import register
from ..session import PRICE, SERIES, TS, shared_path
from ..sources import fixtures as fx


def catalog_scenario(spark, sf_dir):
    """Fresh catalog: dataset 1 = H filled, dataset 2 = D; forecast 1 = F on
    dataset 1, forecast 2 = F on dataset 2; then dataset 2 is deleted
    (its forecast goes with it) and a delete of an absent id is refused."""
    cat = Catalog(spark, shared_path(spark, "catalog", uuid.uuid4().hex))
    cat.initialize()
    hf_full = fx.fixture_h_filled(spark, sf_dir)
    hf = hf_full.select(SERIES, TS, PRICE)
    d1 = cat.save_dataset(hf, "events hourly", "hourly mean value per event type")
    d2 = cat.save_dataset(fx.fixture_d(spark, sf_dir), "orders daily")
    f = fx.fixture_f(spark, sf_dir, hf_full)
    m = forecast_metrics(f).withColumn("model", F.lit("lag24"))
    f1 = cat.save_forecast(d1, f, m, None, "lag24 forecast", 1, 90, ["lag24"])
    cat.save_forecast(d2, f, m, None, "orphan", 1, 80, ["lag24"])
    assert cat.delete_dataset(d2)
    assert not cat.delete_dataset(d2 + 100)
    return cat, d1, f1


@register(
    "catalog_dataset_round_trip",
    S.with_(S.HF) + "SELECT series_id, ts AS \"timestamp\", price FROM hf",
    doubles=("price",),
)
def q_catalog_dataset_round_trip(spark, sf_dir):
    cat, d1, _ = catalog_scenario(spark, sf_dir)
    return cat.load_dataset(d1)


@register(
    "catalog_forecast_round_trip",
    S.with_(S.F) + "SELECT series_id, ts AS \"timestamp\", predicted, actual, lower, upper FROM f",
    doubles=("predicted", "actual", "lower", "upper"),
)
def q_catalog_forecast_round_trip(spark, sf_dir):
    cat, _, f1 = catalog_scenario(spark, sf_dir)
    pts, _, _ = cat.load_forecast(f1)
    return pts


@register(
    "catalog_describe_datasets",
    S.with_(S.HF) + """SELECT CAST(1 AS BIGINT) AS id, 'events hourly' AS name, CAST(count(*) AS BIGINT) AS records,
  strftime(min(ts), '%Y-%m-%d') || ' to ' || strftime(max(ts), '%Y-%m-%d') AS time_range, 'No' AS external_features,
  CAST(count(*) AS BIGINT) AS loaded_rows FROM hf""",
)
def q_catalog_describe_datasets(spark, sf_dir):
    cat, d1, _ = catalog_scenario(spark, sf_dir)
    desc = cat.describe_datasets().select(
        F.col("ID").alias("id"), F.col("Name").alias("name"), F.col("Records").alias("records"),
        F.col("Time Range").alias("time_range"), F.col("External Features").alias("external_features"),
    )
    n = cat.load_forecast_with_history(1).groupBy("dataset_id").agg(F.count(F.lit(1)).cast("long").alias("loaded_rows"))
    return desc.join(n, desc["id"] == n["dataset_id"]).drop("dataset_id")


@register(
    "catalog_describe_forecasts",
    S.with_(S.F)
    + """SELECT CAST(1 AS BIGINT) AS id, 'lag24 forecast' AS name, CAST(1 AS BIGINT) AS dataset_id, 'events hourly' AS dataset,
  CAST(1 AS BIGINT) AS horizon_days, '90%' AS confidence_interval, 'lag24' AS models, avg(MAE) AS MAE, avg(RMSE) AS RMSE,
  avg(MAPE) AS MAPE, avg(Theils_U) AS Theils_U FROM ("""
    + """SELECT series_id, avg(abs(predicted - actual)) AS MAE, sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE,
  avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100.0 AS MAPE,
  CASE WHEN avg((naive - actual) * (naive - actual)) <> 0
    THEN sqrt(avg((predicted - actual) * (predicted - actual))) / sqrt(avg((naive - actual) * (naive - actual))) END AS Theils_U
  FROM (SELECT *, coalesce(lag(actual) OVER (PARTITION BY series_id ORDER BY ts), actual) AS naive FROM f WHERE actual IS NOT NULL)
  GROUP BY series_id)""",
    doubles=("MAE", "RMSE", "MAPE", "Theils_U"),
)
def q_catalog_describe_forecasts(spark, sf_dir):
    cat, _, f1 = catalog_scenario(spark, sf_dir)
    desc = cat.describe_forecasts().select(
        F.col("ID").alias("id"), F.col("Name").alias("name"), F.col("Dataset ID").alias("dataset_id"),
        F.col("Dataset").alias("dataset"), F.col("Horizon (days)").alias("horizon_days"),
        F.col("Confidence Interval").alias("confidence_interval"), F.col("Models").alias("models"),
    )
    _, metrics, _ = cat.load_forecast(f1)
    return desc.join(metrics, "id").drop("forecast_id")


@register(
    "catalog_list_forecasts",
    """SELECT CAST(1 AS BIGINT) AS id, CAST(1 AS BIGINT) AS dataset_id, 'lag24 forecast' AS name, CAST(1 AS BIGINT) AS forecast_horizon,
  CAST(90 AS BIGINT) AS confidence_interval, 'lag24' AS models_used, true AS got WHERE EXISTS (SELECT 1 FROM events)""",
)
def q_catalog_list_forecasts(spark, sf_dir):
    """The live forecasts of one dataset (the other dataset's went with it), and whether each is found by its id."""
    cat, d1, f1 = catalog_scenario(spark, sf_dir)
    got = cat.get_forecast(f1).select("id", F.lit(True).alias("got"))
    rows = cat.list_forecasts(d1).select("id", "dataset_id", "name", "forecast_horizon", "confidence_interval", "models_used")
    return rows.join(got, "id", "left")


@register(
    "catalog_delete_forecast",
    S.with_(S.HF) + "SELECT CAST(0 AS BIGINT) AS forecasts, CAST(count(*) AS BIGINT) AS history_rows FROM hf",
)
def q_catalog_delete_forecast(spark, sf_dir):
    """After a forecast is deleted none is listed, and the history of its dataset stays."""
    cat, d1, f1 = catalog_scenario(spark, sf_dir)
    assert cat.delete_forecast(f1) and not cat.delete_forecast(f1)
    left = cat.list_forecasts(d1).count()
    return cat.load_dataset(d1).agg(F.lit(left).cast("long").alias("forecasts"), F.count(F.lit(1)).alias("history_rows"))


@register(
    "catalog_failed_save",
    S.with_(S.HF) + "SELECT series_id, ts AS \"timestamp\", price FROM hf",
    doubles=("price",),
)
def q_catalog_failed_save(spark, sf_dir):
    """A save that stops after its rows and before its header; the next save takes the same id and loads its own rows only."""
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, PRICE)

    class Lost(Catalog):
        def _append(self, table, df):
            raise OSError("lost before the header")

    root = shared_path(spark, "catalog", uuid.uuid4().hex)
    Catalog(spark, root).initialize()
    try:
        Lost(spark, root).save_dataset(fx.fixture_d(spark, sf_dir), "lost")
    except OSError:
        pass
    cat = Catalog(spark, root)
    return cat.load_dataset(cat.save_dataset(hf, "kept"))
