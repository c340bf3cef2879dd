"""Series derived from the driver's tables (see FIXTURES.md).

All are plain Spark jobs over the parquet tables, so their work grows with
the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fill import fill_time_linear
from ..operators.resample import floor_to_step, on_grid, resample_mean
from ..plans.ordered import materialize
from ..plans.rolling import Lag, ordered_features
from ..session import IDX, PRICE, SERIES, TS

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events as price ticks keyed by event type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias(SERIES), F.col("ts"), F.col("value").alias(PRICE))


def fixture_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H: hourly mean of ``value`` per event type on the dense hourly grid (gaps NULL).

    Each fixture is a series table a user would keep: it is written once to
    the shared checkpoint folder, so the operators downstream (which read
    their input more than once) never re-derive it from the raw events.
    """
    return materialize(resample_mean(events_series(spark, sf_dir), HOUR))


def fixture_h_filled(spark: SparkSession, sf_dir: str, h: DataFrame | None = None) -> DataFrame:
    """H after the time-linear fill."""
    return materialize(fill_time_linear(h if h is not None else fixture_h(spark, sf_dir)))


def fixture_hx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HX: H plus drivers ``load`` (events per hour) and ``temperature`` (mean ``k`` of props)."""
    ev = table(spark, sf_dir, "events")
    agg = ev.groupBy(F.col("event_type").alias(SERIES), floor_to_step("ts", HOUR).alias(TS)).agg(
        F.avg("value").alias(PRICE),
        F.count(F.lit(1)).cast("double").alias("load"),
        F.avg(F.get_json_object("props", "$.k").try_cast("double")).alias("temperature"),
    )
    return materialize(on_grid(agg, HOUR))


def fixture_hx_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HX after the time-linear fill of price and drivers."""
    return materialize(fill_time_linear(fixture_hx(spark, sf_dir)))


def fixture_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: daily total order price per order priority (irregular: days without orders are absent)."""
    o = table(spark, sf_dir, "orders")
    return materialize(
        o.groupBy(F.col("o_orderpriority").alias(SERIES), F.col("o_orderdate").cast("timestamp_ntz").alias(TS)).agg(
            F.sum("o_totalprice").alias(PRICE)
        )
    )


def fixture_m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: all events as one series, 5-minute mean on the dense grid."""
    ev = table(spark, sf_dir, "events").select(F.lit("all").alias(SERIES), "ts", F.col("value").alias(PRICE))
    return materialize(resample_mean(ev, 300))


def fixture_bursty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ticks per type whose first one (by id) is stamped in 2000 and whose every third price is missing."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias(SERIES), "ts", "value")
    first = ev.groupBy(SERIES).agg(F.min("event_id").alias("_first"))
    early = F.when(F.col("event_id") == F.col("_first"), F.lit("2000-01-01").cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz"))
    price = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return materialize(ev.join(first, SERIES).select("event_id", SERIES, early.alias(TS), price.alias(PRICE)))


def fixture_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: hourly mean per user on each user's dense grid (many series)."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias(SERIES), "ts", F.col("value").alias(PRICE)
    )
    return materialize(resample_mean(ev, HOUR))


Z_REF = 1.96  # fixed value: the reference's band multiplier


def forecast_from_filled(hf: DataFrame, lag_rows: int = 24, z: float = Z_REF) -> DataFrame:
    """F: a forecast table over filled series (keeps the grid position ``idx``).

    History part: ``actual = price``, ``predicted`` = price ``lag_rows`` rows
    before (rows without it dropped), bands ``predicted -/+ z * stddev_pop(error)``.
    Future part: the last ``lag_rows`` rows moved on by one day, ``actual`` NULL,
    ``predicted`` = their price, bands ``-/+ z * 0.1 * |predicted|``.
    """
    lagged = ordered_features(hf.select(SERIES, TS, IDX, PRICE), lags=[Lag("predicted", PRICE, lag_rows)])
    hist = lagged.filter(F.col("predicted").isNotNull()).select(
        SERIES, TS, IDX, F.col(PRICE).alias("actual"), "predicted"
    )
    sd = hist.groupBy(SERIES).agg(F.stddev_pop(F.col("actual") - F.col("predicted")).alias("_sd"))
    hist = hist.join(sd, SERIES).select(
        SERIES,
        TS,
        IDX,
        "actual",
        "predicted",
        (F.col("predicted") - z * F.col("_sd")).alias("lower"),
        (F.col("predicted") + z * F.col("_sd")).alias("upper"),
    )
    last = hf.groupBy(SERIES).agg(F.max(IDX).alias("_last"))
    fut = (
        hf.join(last, SERIES)
        .filter(F.col(IDX) > F.col("_last") - lag_rows)
        .select(
            SERIES,
            F.timestamp_add("DAY", F.lit(1), F.col(TS)).alias(TS),
            # the grid continues: one day on is lag_rows rows on for the hourly fixture
            (F.col(IDX) + lag_rows).alias(IDX),
            F.lit(None).cast("double").alias("actual"),
            F.col(PRICE).alias("predicted"),
        )
    )
    fut = fut.withColumn("lower", F.col("predicted") - z * 0.1 * F.abs("predicted")).withColumn(
        "upper", F.col("predicted") + z * 0.1 * F.abs("predicted")
    )
    return hist.unionByName(fut)


def fixture_f(spark: SparkSession, sf_dir: str, hf: DataFrame | None = None) -> DataFrame:
    return materialize(forecast_from_filled(hf if hf is not None else fixture_h_filled(spark, sf_dir)))


def fixture_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW: text input as a user would upload it, derived from ``events``.

    ``click`` and ``view`` stamps are written ``m/d/yy h:mm``, the others
    ``yyyy-MM-dd HH:mm:ss``; ``error`` rows carry their JSON props as price
    text (not a number).
    """
    ev = table(spark, sf_dir, "events")
    ts_text = F.when(F.col("event_type").isin("click", "view"), F.date_format("ts", "M/d/yy H:mm")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    price_text = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    return ev.select("event_id", F.col("event_type").alias(SERIES), ts_text.alias("timestamp"), price_text.alias("price"))


def fixture_raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals as upload text (passes the 30-day check)."""
    d = fixture_d(spark, sf_dir)
    return d.select(
        SERIES, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col(PRICE).cast("string").alias("price")
    )
