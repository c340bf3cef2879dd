"""The streaming hourly mean equals the batch hourly mean of the same ticks."""

import uuid

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidemark.sources.fixtures import table
from tidemark.streaming.hourly import streaming_hourly_mean


def test_stream_equals_batch(spark):
    schema = table(spark, SF_SMALL, "events").schema
    got = streaming_hourly_mean(spark, f"{SF_SMALL}/events.parquet", schema, uuid.uuid4().hex)
    ev = table(spark, SF_SMALL, "events")
    want = ev.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.avg("value").alias("price"), F.count(F.lit(1)).alias("n")
    )
    a = got.select("series_id", "ts", F.round("price", 9).alias("p"), "n")
    b = want.select("series_id", "ts", F.round("price", 9).alias("p"), "n")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_interleaved_files_lose_no_tick(spark):
    from tidemark.queries.streams import q_streaming_interleaved

    ev = table(spark, SF_SMALL, "events")
    assert q_streaming_interleaved(spark, SF_SMALL).agg(F.sum("n")).first()[0] == ev.count()
