"""Incremental hourly mean of arriving prices.

Two forms.  :func:`streaming_hourly_mean` reads what is there, in any order and any
number of files: each micro-batch is reduced to partial sums per (series, hour) and
written under its batch id; partial sums are merged on reading.  It keeps no state and
drops no tick, however late.

:func:`hourly_mean` is the live form with bounded state: a file source of ticks -> watermark
-> hourly tumbling window per series -> running mean.  ``update`` mode emits a window whenever
it changes; state for windows older than the watermark is dropped, so state
stays bounded however long the stream runs.  Each micro-batch is appended
(with its batch id) to a Parquet table in the shared folder via
``foreachBatch``; :func:`latest_windows` keeps the last version per window.

Failure behaviour: the query's progress and state live in the checkpoint
folder (shared storage), so a restarted query resumes where it stopped.  A
micro-batch re-run after a lost executor appends the same rows under the same
batch id again; :func:`latest_windows` takes one row per (series, hour, latest
batch), so such duplicates never change the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import PRICE, SERIES, shared_path


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, series_col: str, ts_col: str, value_col: str,
                max_files_per_trigger: int | None = None, file_glob: str | None = None) -> DataFrame:
    """Ticks from Parquet files arriving in the folder ``path`` (optionally only names matching ``file_glob``)."""
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = reader.parquet(path)
    # watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session time zone is UTC
    return s.select(
        F.col(series_col).cast("string").alias(SERIES),
        F.col(ts_col).cast("timestamp").alias("ts"),
        F.col(value_col).cast("double").alias(PRICE),
    )


def hourly_mean(ticks: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Running hourly mean per series, tolerant to ``lateness`` of late ticks."""
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy(F.col(SERIES), F.window("ts", width))
        .agg(F.sum(PRICE).alias("sum_price"), F.count(F.lit(1)).alias("n"))
        .select(SERIES, F.col("window.start").alias("ts"), "sum_price", "n")
    )


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Start the stream; each batch is appended to ``out_path`` with its batch id."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def raise_on_drops(query) -> None:
    """Fail if the watermark of a live query dropped rows (their count is in its progress)."""
    dropped = sum(int(op.get("numRowsDroppedByWatermark") or 0) for p in query.recentProgress for op in p.get("stateOperators", []))
    if dropped:
        raise RuntimeError(f"{dropped} ticks came later than the watermark allows and were dropped")


def run_partials(ticks: DataFrame, out_path: str, checkpoint: str, width: str = "1 hour", available_now: bool = True):
    """Start the stateless form: every batch overwrites its own folder with its partial sums."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(F.col(SERIES), F.window("ts", width).alias("w")).agg(F.sum(PRICE).alias("sum_price"), F.count(F.lit(1)).alias("n"))
        sums.select(SERIES, F.col("w.start").alias("ts"), "sum_price", "n").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    w = ticks.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def merged_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Hourly means over all batches written so far."""
    sums = spark.read.parquet(out_path).groupBy(SERIES, "ts").agg(F.sum("sum_price").alias("s"), F.sum("n").alias("n"))
    return sums.select(SERIES, F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("s") / F.col("n")).alias(PRICE), F.col("n").cast("long").alias("n"))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def latest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """Last emitted version of every (series, hour): the current hourly means."""
    rows = spark.read.parquet(out_path)
    w = Window.partitionBy(SERIES, "ts").orderBy(F.col("batch_id").desc())
    last = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return last.select(SERIES, F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("sum_price") / F.col("n")).alias(PRICE), F.col("n").cast("long").alias("n"))


def streaming_hourly_mean(spark: SparkSession, path: str, schema: T.StructType, run_id: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The event table ``path`` (a file, or a folder of part files) as a stream of ticks keyed by event type; runs to completion."""
    base = shared_path(spark, "streams", run_id)
    folder, glob = (path, "*.parquet") if is_folder(spark, path) else path.rsplit("/", 1)
    ticks = tick_stream(spark, folder, schema, "event_type", "ts", "value", max_files_per_trigger=max_files_per_trigger, file_glob=glob)
    q = run_partials(ticks, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return merged_windows(spark, f"{base}/out")
