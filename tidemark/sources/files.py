"""File sources and sinks: CSV, JSON, JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import coerce_numeric, format_export, parse_timestamp
from ..session import DRIVERS, PRICE, SERIES, TS
from .jsontext import read_columns, read_records


def _typed(raw: DataFrame, series: str | None, default_series: str) -> DataFrame:
    cols = {c.strip().lower(): c for c in raw.columns}
    sid = F.col(cols[series.lower()]).cast("string") if series and series.lower() in cols else F.lit(default_series)
    out = [sid.alias(SERIES), parse_timestamp(F.col(cols["timestamp"])).alias(TS), coerce_numeric(F.col(cols["price"])).alias(PRICE)]
    out += [coerce_numeric(F.col(cols[d])).alias(d) for d in DRIVERS if d in cols]
    return raw.select(*out)


def read_series_csv(spark: SparkSession, path: str, series: str | None = SERIES, default_series: str = "series") -> DataFrame:
    """CSV with a header; every column read as text and bound by name (never by
    position), then ``timestamp``/``price``/drivers are parsed; bad values become NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return _typed(raw, series, default_series)


def read_series_json(
    spark: SparkSession, path: str, series: str | None = SERIES, default_series: str = "series", layout: str = "records"
) -> DataFrame:
    """JSON records: a JSON array of flat objects (``records``) or one object per line
    (``lines``); ``columns`` = one object of ``{column: {row: value}}`` maps.  All three are
    split over tasks (``jsontext``).  Numeric stamps are epoch seconds or milliseconds by magnitude."""
    wanted = ["timestamp", PRICE, *DRIVERS, *([series.lower()] if series else [])]
    if layout == "columns":
        raw = read_columns(spark, path, wanted)
    elif layout == "records":
        raw = read_records(spark, path, wanted)
    else:
        raw = spark.read.json(path)
        raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    t = F.col("timestamp")
    num = t.try_cast("double")
    as_epoch = F.when(num.isNull(), None).when(F.abs(num) > 1e11, F.timestamp_millis(num.cast("long"))).otherwise(
        F.timestamp_seconds(num.cast("long"))
    )
    raw = raw.withColumn("timestamp", F.coalesce(F.date_format(as_epoch.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSS"), t))
    return _typed(raw, series, default_series)


def write_forecast_csv(df: DataFrame, path: str, ts: str = TS, mode: str = "overwrite") -> str:
    """Write with a header, stamps as ``yyyy-MM-dd HH:mm:ss`` in a ``timestamp`` column, no index."""
    out = df.withColumn(ts, format_export(ts)).withColumnRenamed(ts, "timestamp") if ts != "timestamp" else df.withColumn(ts, format_export(ts))
    out.write.mode(mode).option("header", True).csv(path)
    return path


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None, **extra) -> dict:
    """Options for ``spark.read/write.format('jdbc')`` (SQLite or PostgreSQL URLs)."""
    opts = {"url": url, "dbtable": table}
    if user:
        opts["user"] = user
    if password:
        opts["password"] = password
    if url.startswith("jdbc:postgresql"):
        opts.setdefault("driver", "org.postgresql.Driver")
    elif url.startswith("jdbc:sqlite"):
        opts.setdefault("driver", "org.sqlite.JDBC")
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_series_jdbc(spark: SparkSession, url: str, table: str, series: str | None = None, partition_column: str | None = None,
                     lower: int | None = None, upper: int | None = None, num_partitions: int | None = None, **kw) -> DataFrame:
    """Typed series from a JDBC table; a numeric ``partition_column`` splits the read."""
    opts = jdbc_options(url, table, **kw)
    if partition_column:
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(num_partitions or 8))
    raw = spark.read.format("jdbc").options(**opts).load()
    raw = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return _typed(raw, series, "series")


def write_forecast_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **kw) -> None:
    df.write.format("jdbc").options(**jdbc_options(url, table, **kw)).mode(mode).save()


def select_known(df: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    return df.select(*[c for c in [*keys, TS, PRICE, *DRIVERS] if c in df.columns])
