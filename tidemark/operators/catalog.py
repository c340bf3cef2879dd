"""Saved datasets and forecasts as Parquet tables under one root (S5, K1-K10, P11,
P12, P14, P15, J7, J8, O4, T12, T14).

Layout (no metastore needed):

* ``datasets``, ``forecasts`` - header logs, append-only.  Every save or
  delete appends a record with a larger ``version``; the live view is the
  latest record per id that is not a deletion.  Readers start from the
  headers, and a header is written after its facts, so a half-finished
  save is invisible.
* ``price_data`` partitioned by ``dataset_id``; ``forecast_data`` and
  ``forecast_metrics`` partitioned by ``forecast_id`` - loads read one
  partition (partition pruning).
* Cascade delete: facts and forecasts are kept only through a semi join to
  the live headers; :meth:`Catalog.vacuum` removes dead partitions.

Only single values (next id, row count, JSON text of a few metrics) ever
reach the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import DRIVERS, PRICE, SERIES, TS, shared_path

DATASETS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("start_date", T.TimestampNTZType()),
        T.StructField("end_date", T.TimestampNTZType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("has_external_features", T.BooleanType()),
        T.StructField("step_seconds", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("version", T.LongType()),
    ]
)
FORECASTS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("dataset_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("forecast_horizon", T.LongType()),
        T.StructField("confidence_interval", T.LongType()),
        T.StructField("models_used", T.StringType()),
        T.StructField("error_metrics", T.StringType()),
        T.StructField("feature_importance", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("version", T.LongType()),
    ]
)
PRICE_SCHEMA = T.StructType(
    [T.StructField(SERIES, T.StringType()), T.StructField("timestamp", T.TimestampNTZType()), T.StructField(PRICE, T.DoubleType())]
    + [T.StructField(d, T.DoubleType()) for d in DRIVERS]
    + [T.StructField("dataset_id", T.LongType())]
)
FORECAST_DATA_SCHEMA = T.StructType(
    [
        T.StructField(SERIES, T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("predicted", T.DoubleType()),
        T.StructField("actual", T.DoubleType()),
        T.StructField("lower_bound", T.DoubleType()),
        T.StructField("upper_bound", T.DoubleType()),
        T.StructField("forecast_id", T.LongType()),
    ]
)
METRICS_SCHEMA = T.StructType(
    [
        T.StructField(SERIES, T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("forecast_id", T.LongType()),
    ]
)
TABLES = {
    "datasets": (DATASETS_SCHEMA, None),
    "forecasts": (FORECASTS_SCHEMA, None),
    "price_data": (PRICE_SCHEMA, "dataset_id"),
    "forecast_data": (FORECAST_DATA_SCHEMA, "forecast_id"),
    "forecast_metrics": (METRICS_SCHEMA, "forecast_id"),
}


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get("tidemark.catalog.root", None) or shared_path(spark, "catalog")).rstrip("/")

    # ------------------------------------------------------------ storage

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(self.path(table))
            return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))
        except Exception:  # noqa: BLE001 - no JVM gateway (Spark Connect): probe by reading
            try:
                self._read(table).limit(0).collect()
                return True
            except Exception:  # noqa: BLE001
                return False

    def initialize(self) -> bool:
        """Create each table (empty, fixed schema) where absent."""
        for name, (schema, part) in TABLES.items():
            if not self._exists(name):
                w = self.spark.createDataFrame([], schema).write.mode("ignore")
                if part:
                    w = w.partitionBy(part)
                w.parquet(self.path(name))
        return True

    def _read(self, table: str) -> DataFrame:
        schema, _ = TABLES[table]
        return self.spark.read.schema(schema).parquet(self.path(table))

    def _append(self, table: str, df: DataFrame) -> None:
        schema, part = TABLES[table]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        w = df.write.mode("append")
        if part:
            w = w.partitionBy(part)
        w.parquet(self.path(table))

    def _put(self, table: str, key: int, df: DataFrame) -> None:
        """Write the facts of one id: the partition is replaced, so what a failed save left behind never joins the next one."""
        schema, part = TABLES[table]
        fields = [f for f in schema.fields if f.name != part]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        df.write.mode("overwrite").parquet(f"{self.path(table)}/{part}={int(key)}")

    @staticmethod
    def _version() -> int:
        return time.time_ns() // 1000

    def _live(self, table: str) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.col("version").desc())
        latest = self._read(table).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
        return latest.filter(~F.col("deleted"))

    def _next_id(self, table: str) -> int:
        m = self._read(table).agg(F.max("id")).first()[0]
        return int(m or 0) + 1

    # ------------------------------------------------------------ datasets

    def save_dataset(
        self, data: DataFrame, name: str, description: str | None = None, dataset_id: int | None = None, step_seconds: int | None = None
    ) -> int:
        """Facts first (partition ``dataset_id``), header last; returns the id."""
        self.initialize()
        ts = TS if TS in data.columns else "timestamp"
        rows = data.select(
            (F.col(SERIES) if SERIES in data.columns else F.lit("series")).alias(SERIES),
            F.col(ts).cast("timestamp_ntz").alias("timestamp"),
            F.col(PRICE).cast("double").alias(PRICE),
            *[F.col(d).cast("double").alias(d) for d in DRIVERS if d in data.columns],
        )
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
        did = int(dataset_id) if dataset_id is not None else self._next_id("datasets")
        self._put("price_data", did, rows)
        header = self.spark.createDataFrame(
            [
                (
                    did, name, description, None, stats["a"], stats["b"], int(stats["n"]),
                    any(d in data.columns for d in DRIVERS), step_seconds, False, self._version(),
                )
            ],
            DATASETS_SCHEMA,
        ).withColumn("created_at", F.localtimestamp().cast("timestamp_ntz"))
        self._append("datasets", header)
        return did

    def list_datasets(self) -> DataFrame:
        return self._live("datasets").drop("deleted", "version")

    def get_dataset(self, dataset_id: int) -> DataFrame:
        return self.list_datasets().filter(F.col("id") == dataset_id).limit(1)

    def load_dataset(self, dataset_id: int) -> DataFrame:
        """Rows of a live dataset; optional columns NULL on every row are dropped."""
        live = self._live("datasets").filter(F.col("id") == dataset_id).select(F.col("id").alias("dataset_id"))
        rows = self._read("price_data").filter(F.col("dataset_id") == dataset_id).join(live, "dataset_id", "left_semi")
        present = rows.agg(*[F.count(d).alias(d) for d in DRIVERS]).first()
        keep = [d for d in DRIVERS if present[d]]
        return rows.select(SERIES, "timestamp", PRICE, *keep)

    def delete_dataset(self, dataset_id: int) -> bool:
        """Append a deletion record; forecasts and rows of the dataset go with it."""
        cur = self._live("datasets").filter(F.col("id") == dataset_id)
        if cur.limit(1).count() == 0:
            return False
        self._append("datasets", cur.withColumn("deleted", F.lit(True)).withColumn("version", F.lit(self._version())))
        return True

    def describe_datasets(self) -> DataFrame:
        d = self.list_datasets()
        return d.select(
            F.col("id").alias("ID"),
            F.col("name").alias("Name"),
            F.col("description").alias("Description"),
            F.col("record_count").alias("Records"),
            F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("Created"),
            F.concat_ws(" to ", F.date_format("start_date", "yyyy-MM-dd"), F.date_format("end_date", "yyyy-MM-dd")).alias("Time Range"),
            F.when(F.col("has_external_features"), "Yes").otherwise("No").alias("External Features"),
        )

    # ------------------------------------------------------------ forecasts

    def save_forecast(
        self,
        dataset_id: int,
        forecast: DataFrame,
        metrics: DataFrame | None = None,
        importance: DataFrame | None = None,
        name: str = "forecast",
        horizon_days: int = 7,
        confidence_interval: int = 90,
        models_used: Sequence[str] = ("model",),
        forecast_id: int | None = None,
    ) -> int:
        """Points, metrics (long form), header with metric means and importances as JSON text."""
        self.initialize()
        fid = int(forecast_id) if forecast_id is not None else self._next_id("forecasts")
        ts = TS if TS in forecast.columns else "timestamp"
        pts = forecast.select(
            (F.col(SERIES) if SERIES in forecast.columns else F.lit("series")).alias(SERIES),
            F.col(ts).cast("timestamp_ntz").alias("timestamp"),
            "predicted",
            "actual",
            F.col("lower").alias("lower_bound") if "lower" in forecast.columns else F.lit(None).cast("double").alias("lower_bound"),
            F.col("upper").alias("upper_bound") if "upper" in forecast.columns else F.lit(None).cast("double").alias("upper_bound"),
        )
        self._put("forecast_data", fid, pts)
        metrics_json = None
        if metrics is not None:
            cols = [c for c in ("MAE", "RMSE", "MAPE", "Theils_U") if c in metrics.columns]
            mdf = metrics if "model" in metrics.columns else metrics.withColumn("model", F.lit(models_used[0]))
            if SERIES not in mdf.columns:
                mdf = mdf.withColumn(SERIES, F.lit("series"))
            self._put("forecast_metrics", fid, mdf.unpivot([SERIES, "model"], cols, "metric", "value"))
            metrics_json = metrics.agg(F.to_json(F.struct(*[F.avg(c).alias(c) for c in cols]))).first()[0]
        else:
            self._put("forecast_metrics", fid, self.spark.createDataFrame([], METRICS_SCHEMA))
        importance_json = None
        if importance is not None:
            importance_json = importance.agg(
                F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("feature"), F.col("importance").cast("double")))))
            ).first()[0]
        header = self.spark.createDataFrame(
            [
                (
                    fid, int(dataset_id), name, None, int(horizon_days), int(confidence_interval),
                    ",".join(models_used), metrics_json, importance_json, False, self._version(),
                )
            ],
            FORECASTS_SCHEMA,
        ).withColumn("created_at", F.localtimestamp().cast("timestamp_ntz"))
        self._append("forecasts", header)
        return fid

    def _live_forecasts(self) -> DataFrame:
        ds = self._live("datasets").select(F.col("id").alias("dataset_id"))
        return self._live("forecasts").join(ds, "dataset_id", "left_semi")

    def list_forecasts(self, dataset_id: int | None = None) -> DataFrame:
        f = self._live_forecasts().drop("deleted", "version")
        return f if dataset_id is None else f.filter(F.col("dataset_id") == dataset_id)

    def get_forecast(self, forecast_id: int) -> DataFrame:
        return self.list_forecasts().filter(F.col("id") == forecast_id).limit(1)

    def load_forecast(self, forecast_id: int):
        """``(points, metrics, importance)``; three Nones for an absent id.

        ``metrics`` is a one-row DataFrame parsed back from the header JSON,
        ``importance`` a ``feature, importance`` DataFrame.
        """
        head = self.get_forecast(forecast_id)
        if head.count() == 0:
            return None, None, None
        pts = (
            self._read("forecast_data")
            .filter(F.col("forecast_id") == forecast_id)
            .select(SERIES, "timestamp", "predicted", "actual", F.col("lower_bound").alias("lower"), F.col("upper_bound").alias("upper"))
        )
        metrics = head.select(
            "id", F.from_json("error_metrics", "MAE double, RMSE double, MAPE double, Theils_U double").alias("m")
        ).select("id", "m.*")
        imp = head.select(F.explode(F.from_json("feature_importance", "map<string,double>")).alias("feature", "importance"))
        return pts, metrics, imp

    def load_metrics(self, forecast_id: int) -> DataFrame:
        return self._read("forecast_metrics").filter(F.col("forecast_id") == forecast_id).drop("forecast_id")

    def delete_forecast(self, forecast_id: int) -> bool:
        cur = self._live("forecasts").filter(F.col("id") == forecast_id)
        if cur.limit(1).count() == 0:
            return False
        self._append("forecasts", cur.withColumn("deleted", F.lit(True)).withColumn("version", F.lit(self._version())))
        return True

    def describe_forecasts(self) -> DataFrame:
        f = self.list_forecasts()
        names = self.list_datasets().select(F.col("id").alias("dataset_id"), F.col("name").alias("Dataset"))
        return f.join(names, "dataset_id", "left").select(
            F.col("id").alias("ID"),
            F.col("name").alias("Name"),
            F.col("dataset_id").alias("Dataset ID"),
            "Dataset",
            F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("Created"),
            F.col("forecast_horizon").alias("Horizon (days)"),
            F.concat(F.col("confidence_interval").cast("string"), F.lit("%")).alias("Confidence Interval"),
            F.col("models_used").alias("Models"),
        )

    def load_forecast_with_history(self, forecast_id: int) -> DataFrame:
        """The price rows of the dataset a forecast was made from."""
        head = self.get_forecast(forecast_id).select("dataset_id").first()
        rows = self._read("price_data")  # the filter prunes to one partition
        return rows.filter(F.col("dataset_id") == head[0]) if head else rows.filter(F.lit(False))

    # ------------------------------------------------------------ upkeep

    def vacuum(self) -> list[str]:
        """Delete fact partitions of dead datasets and forecasts; returns the removed paths."""
        live_ds = {r[0] for r in self._live("datasets").select("id").collect()}
        live_fc = {r[0] for r in self._live_forecasts().select("id").collect()}
        removed = []
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for table, part, live in (("price_data", "dataset_id", live_ds), ("forecast_data", "forecast_id", live_fc), ("forecast_metrics", "forecast_id", live_fc)):
            root = jvm.org.apache.hadoop.fs.Path(self.path(table))
            fs = root.getFileSystem(conf)
            if not fs.exists(root):
                continue
            for st in fs.listStatus(root):
                nm = st.getPath().getName()
                if nm.startswith(f"{part}="):
                    pid = int(nm.split("=", 1)[1])
                    if pid not in live:
                        fs.delete(st.getPath(), True)
                        removed.append(str(st.getPath()))
        return removed
