"""Streaming query: incremental hourly mean of arriving ticks."""

from __future__ import annotations

import uuid

from ..plans import sqlref as S
from ..plans.registry import register
from ..session import shared_path
from ..sources import fixtures as fx
from ..streaming.hourly import streaming_hourly_mean


@register(
    "streaming_hourly_mean",
    S.with_("hb AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)")
    + "SELECT series_id, ts, price, n FROM hb",
    doubles=("price",),
)
def q_streaming_hourly_mean(spark, sf_dir):
    """events read as a file stream: partial sums of each micro-batch, merged; every tick counts."""
    schema = fx.table(spark, sf_dir, "events").schema
    return streaming_hourly_mean(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema, uuid.uuid4().hex)


@register(
    "streaming_interleaved",
    S.with_("hb AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)")
    + "SELECT series_id, ts, price, n FROM hb",
    doubles=("price",),
)
def q_streaming_interleaved(spark, sf_dir):
    """The same over a folder of four files whose ticks interleave, one file a micro-batch."""
    ev = fx.table(spark, sf_dir, "events")
    run_id = uuid.uuid4().hex
    path = shared_path(spark, "streams", run_id, "in", "events.parquet")
    ev.repartition(4, "event_id").write.parquet(path)
    return streaming_hourly_mean(spark, path, ev.schema, run_id, max_files_per_trigger=1)
