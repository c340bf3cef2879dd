"""Queries for sources, validation, resampling, filling and outliers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clean, fill, resample, step
from ..operators.detect import flag_moves
from ..plans import sqlref as S
from ..plans.ordered import previous_time, time_position, with_time_buckets
from ..plans.registry import register
from ..session import IDX, PRICE, SERIES, TS
from ..sources import fixtures as fx
from ..functions import timefn as tf

# ---------------------------------------------------------------- flagship


FLAGSHIP_SQL = S.with_(S.HF, """
b AS (SELECT *, avg(price) OVER w AS band_mean, stddev_samp(price) OVER w AS band_std FROM hf
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
fl AS (SELECT *, coalesce(price > band_mean + 3 * band_std, false) AS is_spike,
  coalesce(price < band_mean - 3 * band_std, false) AS is_drop FROM b)""") + """
SELECT series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(price) AS price_mean, avg(band_mean) AS band_mean,
  CAST(count_if(is_spike) AS BIGINT) AS n_spikes, CAST(count_if(is_drop) AS BIGINT) AS n_drops,
  CAST(count(*) AS BIGINT) AS n_hours
FROM fl GROUP BY ALL"""


def hourly_spike_report(spark, sf_dir):
    """events -> hourly grid per type -> time fill -> 24-hour band -> spike/drop flags -> daily roll-up."""
    hf = fx.fixture_h_filled(spark, sf_dir)
    flagged = flag_moves(hf, 3.0, col=PRICE, rows=24)
    return flagged.groupBy(SERIES, F.to_date(TS).cast("timestamp_ntz").alias(TS)).agg(
        F.avg(PRICE).alias("price_mean"),
        F.avg("band_mean").alias("band_mean"),
        F.count_if("is_spike").cast("long").alias("n_spikes"),
        F.count_if("is_drop").cast("long").alias("n_drops"),
        F.count(F.lit(1)).cast("long").alias("n_hours"),
    )


register("hourly_spike_report", FLAGSHIP_SQL, doubles=("price_mean", "band_mean"))(hourly_spike_report)

# ---------------------------------------------------------------- overview


@register(
    "series_overview",
    S.with_(S.H) + """SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
  CAST(count(price) AS BIGINT) AS n_price, 'series_id,ts,idx,price' AS columns FROM h GROUP BY series_id""",
)
def q_series_overview(spark, sf_dir):
    h = fx.fixture_h(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    out = clean.series_overview(h)
    return out.select(SERIES, F.col("n_rows").cast("long"), "first_ts", "last_ts", F.col("n_price").cast("long"), "columns")


@register(
    "preview",
    S.with_(S.D) + """SELECT series_id, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM d) WHERE rn <= 5""",
    doubles=("price",),
    digits=2,
)
def q_preview(spark, sf_dir):
    return clean.preview(fx.fixture_d(spark, sf_dir), 5).select(SERIES, TS, PRICE)


# ---------------------------------------------------------------- parsing and validation

_VALIDATE_SQL = S.with_(S.RAW, S.D, """
ro AS (SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", CAST(price AS VARCHAR) AS price FROM d),
allraw AS (SELECT series_id, "timestamp", price FROM raw UNION ALL SELECT * FROM ro),
p AS (SELECT series_id, "timestamp", price,
  coalesce(try_strptime("timestamp", '%Y-%m-%d %H:%M:%S'), try_strptime("timestamp", '%m/%d/%y %H:%M')) AS t,
  TRY_CAST(trim(price) AS DOUBLE) AS v FROM allraw),
a AS (SELECT series_id, count(*) AS n_rows,
  count_if("timestamp" IS NOT NULL AND trim("timestamp") <> '' AND t IS NULL) AS n_bad_ts,
  count_if(price IS NOT NULL AND trim(price) <> '' AND v IS NULL) AS n_bad_price,
  CAST(floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000) AS BIGINT) AS span_days FROM p GROUP BY series_id),
m AS (SELECT *, CASE WHEN n_bad_ts > 0 THEN 'Error converting timestamp column to datetime'
  WHEN n_bad_price > 0 THEN 'Error converting price column to numeric'
  WHEN coalesce(span_days, 0) < 30 THEN printf('Data spans only %d days. At least %d days of data is recommended.', coalesce(span_days, 0), 30)
  ELSE 'Data validation successful.' END AS message FROM a)""") + """
SELECT series_id, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_bad_ts AS BIGINT) AS n_bad_ts,
  CAST(n_bad_price AS BIGINT) AS n_bad_price, span_days, message = 'Data validation successful.' AS is_valid, message FROM m"""


@register("validate_series", _VALIDATE_SQL)
def q_validate_series(spark, sf_dir):
    raw = fx.fixture_raw(spark, sf_dir).select(SERIES, "timestamp", "price").unionByName(fx.fixture_raw_orders(spark, sf_dir))
    return clean.validate_series(raw, 30)


@register(
    "parse_timestamp",
    S.with_(S.RAW) + """SELECT event_id, series_id,
  coalesce(try_strptime("timestamp", '%Y-%m-%d %H:%M:%S'), try_strptime("timestamp", '%m/%d/%y %H:%M')) AS ts FROM raw""",
)
def q_parse_timestamp(spark, sf_dir):
    raw = fx.fixture_raw(spark, sf_dir)
    return raw.select("event_id", SERIES, tf.parse_timestamp("timestamp").alias(TS))


@register(
    "coerce_numeric",
    S.with_(S.RAW) + """SELECT event_id, series_id, TRY_CAST(trim(price) AS DOUBLE) AS price,
  TRY_CAST(trim(price) AS DOUBLE) IS NULL AS is_bad FROM raw""",
    doubles=("price",),
)
def q_coerce_numeric(spark, sf_dir):
    raw = fx.fixture_raw(spark, sf_dir)
    v = tf.coerce_numeric("price")
    return raw.select("event_id", SERIES, v.alias(PRICE), v.isNull().alias("is_bad"))


# ---------------------------------------------------------------- step detection

_STEP_SQL = S.with_(S.D, S.H, S.M5, """
src AS (SELECT 'D' AS fixture, series_id, ts FROM d UNION ALL SELECT 'H', series_id, ts FROM h
  UNION ALL SELECT 'M5', series_id, ts FROM m5),
dl AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY fixture, series_id ORDER BY ts))) / 1e6 AS delta FROM src),
c AS (SELECT fixture, series_id, delta, count(*) AS n FROM dl WHERE delta IS NOT NULL GROUP BY ALL),
mo AS (SELECT fixture, series_id, arg_max(delta, (n, -delta)) AS step_seconds, count(*) AS n_steps FROM c GROUP BY ALL),
sp AS (SELECT fixture, series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM src GROUP BY ALL)""") + """
SELECT sp.fixture, sp.series_id, CAST(n_rows AS BIGINT) AS n_rows, first_ts, last_ts, CAST(step_seconds AS DOUBLE) AS step_seconds,
  CAST(coalesce(n_steps, 0) AS BIGINT) AS n_steps, coalesce(n_steps, 0) = 1 AS is_regular,
  (epoch_us(last_ts) - epoch_us(first_ts)) / 1e6 / n_rows AS mean_step_seconds,
  CAST(floor(86400.0 / step_seconds) AS BIGINT) AS periods_per_day
FROM sp LEFT JOIN mo USING (fixture, series_id)"""


@register("detect_step", _STEP_SQL, doubles=("mean_step_seconds",), digits=4)
def q_detect_step(spark, sf_dir):
    parts = []
    for name, f in (("D", fx.fixture_d), ("H", fx.fixture_h), ("M5", fx.fixture_m5)):
        s = f(spark, sf_dir).select(F.concat_ws("|", F.lit(name), SERIES).alias(SERIES), TS)
        parts.append(s)
    allp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = step.detect_step(allp)
    k = F.split(SERIES, r"\|", 2)
    return out.select(k[0].alias("fixture"), k[1].alias(SERIES), *[c for c in out.columns if c != SERIES])


# ---------------------------------------------------------------- null census

@register(
    "null_census",
    S.with_(S.HX) + """SELECT series_id, "column", CAST(n_rows AS BIGINT) AS n_rows, CAST(n_null AS BIGINT) AS n_null FROM (
  SELECT series_id, count(*) AS n_rows, count_if(price IS NULL) AS price, count_if(load IS NULL) AS load,
    count_if(temperature IS NULL) AS temperature FROM hx GROUP BY series_id)
  UNPIVOT (n_null FOR "column" IN (price, load, temperature))""",
)
def q_null_census(spark, sf_dir):
    hx = fx.fixture_hx(spark, sf_dir).select(SERIES, TS, IDX, PRICE, "load", "temperature")
    return clean.null_census(hx)


# ---------------------------------------------------------------- resampling and fill

@register(
    "resample_mean",
    S.with_(S.H, S.M5) + """SELECT 'H' AS fixture, series_id, ts, idx, price FROM h UNION ALL SELECT 'M5', series_id, ts, idx, price FROM m5""",
    doubles=("price",),
)
def q_resample_mean(spark, sf_dir):
    h = fx.fixture_h(spark, sf_dir).select(F.lit("H").alias("fixture"), SERIES, TS, IDX, PRICE)
    m5 = fx.fixture_m5(spark, sf_dir).select(F.lit("M5").alias("fixture"), SERIES, TS, IDX, PRICE)
    return h.unionByName(m5)


_D_HOURLY = S.D + """,
dh_g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM d GROUP BY series_id),
dh0 AS (SELECT g.series_id, g.ts, d.price FROM dh_g g LEFT JOIN d ON g.series_id = d.series_id AND g.ts = d.ts),""" + S.fill_cte(
    "dh", "dh0", ["price"]
)


@register(
    "resample_interpolate",
    S.with_(_D_HOURLY) + "SELECT series_id, ts, price FROM dh",
    doubles=("price",),
    digits=2,
)
def q_resample_interpolate(spark, sf_dir):
    d = fx.fixture_d(spark, sf_dir)
    return resample.resample_interpolate(d, 3600).select(SERIES, TS, PRICE)


@register(
    "resample_to_hourly",
    S.with_(_D_HOURLY, S.M5, """
m5h AS (SELECT series_id, date_trunc('hour', ts) AS ts, avg(price) AS price FROM m5 GROUP BY ALL)""")
    + """SELECT 'D' AS fixture, series_id, ts, price FROM dh UNION ALL SELECT 'M5', series_id, ts, price FROM m5h""",
    doubles=("price",),
    digits=2,
)
def q_resample_to_hourly(spark, sf_dir):
    d = fx.fixture_d(spark, sf_dir).select(F.concat_ws("|", F.lit("D"), SERIES).alias(SERIES), TS, PRICE)
    m5 = fx.fixture_m5(spark, sf_dir).select(F.concat_ws("|", F.lit("M5"), SERIES).alias(SERIES), TS, PRICE)
    out = resample.resample_to_hourly(d.unionByName(m5))
    k = F.split(SERIES, r"\|", 2)
    return out.select(k[0].alias("fixture"), k[1].alias(SERIES), TS, PRICE)


@register("fill_time_linear", S.with_(S.HF) + "SELECT series_id, ts, idx, price FROM hf", doubles=("price",))
def q_fill_time_linear(spark, sf_dir):
    return fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)


# ---------------------------------------------------------------- outliers and cleaning

_BOUNDS = S.H + """,
qb AS (SELECT series_id, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75 FROM h GROUP BY series_id),
fb AS (SELECT series_id, q25, q75, q25 - 3 * (q75 - q25) AS lower_fence, q75 + 3 * (q75 - q25) AS upper_fence FROM qb),
fo AS (SELECT h.*, q25, q75, lower_fence, upper_fence,
  coalesce(price < lower_fence OR price > upper_fence, false) AS is_outlier FROM h LEFT JOIN fb USING (series_id))"""


@register(
    "flag_outliers",
    S.with_(_BOUNDS) + "SELECT series_id, ts, price, q25, q75, lower_fence, upper_fence, is_outlier FROM fo",
    doubles=("price", "q25", "q75", "lower_fence", "upper_fence"),
)
def q_flag_outliers(spark, sf_dir):
    h = fx.fixture_h(spark, sf_dir)
    return clean.flag_outliers(h).select(SERIES, TS, PRICE, "q25", "q75", "lower_fence", "upper_fence", "is_outlier")


@register(
    "repair_outliers",
    S.with_(_BOUNDS, """
rc AS (SELECT series_id, ts, CASE WHEN is_outlier THEN NULL ELSE price END AS price FROM fo),""" + S.fill_cte("rp", "rc", ["price"]))
    + "SELECT series_id, ts, price FROM rp",
    doubles=("price",),
)
def q_repair_outliers(spark, sf_dir):
    return clean.repair_outliers(fx.fixture_h(spark, sf_dir)).select(SERIES, TS, PRICE)


_PRE = S.HF + """,
pq AS (SELECT series_id, quantile_cont(price, 0.25) AS q25, quantile_cont(price, 0.75) AS q75 FROM hf GROUP BY series_id),
pc AS (SELECT series_id, ts, CASE WHEN price < q25 - 3 * (q75 - q25) OR price > q75 + 3 * (q75 - q25) THEN NULL ELSE price END AS price
  FROM hf JOIN pq USING (series_id)),""" + S.fill_cte("pp", "pc", ["price"])


@register("preprocess", S.with_(_PRE) + "SELECT series_id, ts, price FROM pp", doubles=("price",))
def q_preprocess(spark, sf_dir):
    """Typed events (irregular ticks) -> hourly per type, filled, de-outliered."""
    h = fx.fixture_h(spark, sf_dir).select(SERIES, TS, PRICE)
    return clean.preprocess(h, 3600).select(SERIES, TS, PRICE)


@register(
    "flag_extreme",
    S.with_(S.H) + """SELECT series_id, min(price) AS min_price, max(price) AS max_price,
  coalesce(max(abs(price)) > 1e10, false) AS is_extreme FROM h GROUP BY series_id""",
    doubles=("min_price", "max_price"),
)
def q_flag_extreme(spark, sf_dir):
    return clean.flag_extreme(fx.fixture_h(spark, sf_dir))


@register(
    "split_chronological",
    S.with_(S.H) + """SELECT series_id, ts, price, CASE WHEN idx < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM h)""",
    doubles=("price",),
)
def q_split_chronological(spark, sf_dir):
    return clean.split_chronological(fx.fixture_h(spark, sf_dir)).select(SERIES, TS, PRICE, "part")


@register(
    "split_xy",
    S.with_(S.HF) + """SELECT series_id, ts, price AS y, CASE WHEN idx < n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hf)""",
    doubles=("y",),
)
def q_split_xy(spark, sf_dir):
    return clean.split_xy(fx.fixture_h_filled(spark, sf_dir)).select(SERIES, TS, "y", "part")


@register(
    "fill_constant",
    S.with_(S.HX) + "SELECT series_id, ts, coalesce(price, 0.0) AS price, coalesce(load, 0.0) AS load, coalesce(temperature, 0.0) AS temperature FROM hx",
    doubles=("price", "load", "temperature"),
)
def q_fill_constant(spark, sf_dir):
    hx = fx.fixture_hx(spark, sf_dir).select(SERIES, TS, PRICE, "load", "temperature")
    return fill.fill_constant(hx, 0.0, [PRICE, "load", "temperature"])


@register(
    "drop_incomplete",
    S.with_(S.HX) + "SELECT series_id, ts, price, load, temperature FROM hx WHERE price IS NOT NULL AND load IS NOT NULL AND temperature IS NOT NULL",
    doubles=("price", "load", "temperature"),
)
def q_drop_incomplete(spark, sf_dir):
    hx = fx.fixture_hx(spark, sf_dir).select(SERIES, TS, PRICE, "load", "temperature")
    return fill.drop_incomplete(hx)


# ---------------------------------------------------------------- grids that keep their phase


@register(
    "resample_phase",
    S.with_(
        S.H
        + """, ph_b AS (SELECT series_id, ts + CASE WHEN series_id IN ('click', 'view') THEN INTERVAL 30 MINUTE ELSE INTERVAL 7 MINUTE END AS ts, price
  FROM h WHERE price IS NOT NULL AND idx % 5 <> 3),"""
        + S.grid_cte("ph", "ph_b", "1 HOUR", ["price"])
    )
    + "SELECT series_id, ts, idx, price FROM ph",
    doubles=("price",),
)
def q_resample_phase(spark, sf_dir):
    """Hourly series stamped at :30 and at :07, with hours missing, brought to an hourly step: every stamp stays."""
    h = fx.fixture_h(spark, sf_dir).filter(F.col(PRICE).isNotNull() & (F.col(IDX) % 5 != 3))
    late = F.when(F.col(SERIES).isin("click", "view"), F.lit(30)).otherwise(F.lit(7))
    moved = h.select(SERIES, F.timestamp_add("MINUTE", late, F.col(TS)).alias(TS), PRICE)
    return resample.resample(moved, 3600, [PRICE]).select(SERIES, TS, IDX, PRICE)


# ---------------------------------------------------------------- written dates

#: How the event with this remainder of its id writes its stamp, and what is left of the stamp.
_WRITTEN = ["MMMM d, yyyy", "yyyyMMdd", "d/M/yyyy H:mm", "d MMMM yyyy H:mm:ss", "MMM d yyyy h:mm a", "d.M.yyyy"]
_LEFT = ["day", "day", "minute", "second", "minute", "day"]


@register(
    "parse_written_dates",
    "SELECT event_id, CASE "
    + " ".join(f"WHEN event_id % {len(_LEFT)} = {i} THEN date_trunc('{part}', CAST(ts AS TIMESTAMP))" for i, part in enumerate(_LEFT))
    + " END::TIMESTAMP AS ts FROM events WHERE day(ts) > 12",
)
def q_parse_written_dates(spark, sf_dir):
    """Stamps written with month names, without separators and day first (after the 12th, where that is no month) read back."""
    ev = fx.table(spark, sf_dir, "events").where(F.dayofmonth("ts") > 12)
    text = F.coalesce(*[F.when(F.col("event_id") % len(_WRITTEN) == i, F.date_format("ts", form)) for i, form in enumerate(_WRITTEN)])
    return ev.select("event_id", tf.parse_timestamp(text).alias(TS))


# ---------------------------------------------------------------- bursty series: equi-depth time buckets

#: Rows a bucket is made for: small, so that the series of every scale are cut.
_BURST_ROWS = 64


@register(
    "bursty_buckets",
    S.with_(S.BURSTY) + "SELECT series_id, count(*) AS n_rows, true AS even_counts, true AS monotone FROM bursty GROUP BY series_id",
)
def q_bursty_buckets(spark, sf_dir):
    """Whether no time bucket of a series with one stamp in 2000 holds over four times its target, and buckets follow each other in time."""
    d = with_time_buckets(fx.fixture_bursty(spark, sf_dir), TS, rows_per_bucket=_BURST_ROWS)
    per = d.groupBy(SERIES, "_tb").agg(F.count(F.lit(1)).alias("n"), F.min(TS).alias("a"), F.max(TS).alias("b"))
    before = Window.partitionBy(SERIES).orderBy("_tb")
    per = per.withColumn("after", F.coalesce(F.col("a") > F.lag("b", 1).over(before), F.lit(True)))
    return per.groupBy(SERIES).agg(
        F.sum("n").alias("n_rows"), (F.max("n") <= 4 * _BURST_ROWS).alias("even_counts"), F.bool_and("after").alias("monotone")
    )


@register(
    "bursty_positions",
    S.with_(S.BURSTY)
    + """SELECT series_id, event_id, row_number() OVER w - 1 AS idx, CAST(coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), -1) AS BIGINT) AS since_micros
  FROM bursty WINDOW w AS (PARTITION BY series_id ORDER BY ts, event_id)""",
)
def q_bursty_positions(spark, sf_dir):
    """Position and time since the row before (-1 on the first) of every tick of a bursty series."""
    d = time_position(fx.fixture_bursty(spark, sf_dir), TS, tie=["event_id"], rows_per_bucket=_BURST_ROWS)
    d = previous_time(d, TS, rows_per_bucket=_BURST_ROWS)
    return d.select(SERIES, "event_id", IDX, F.coalesce(tf.epoch_micros(TS) - tf.epoch_micros("_prev_ts"), F.lit(-1).cast("long")).alias("since_micros"))


@register(
    "fill_bursty",
    S.with_(S.BURSTY + "," + S.fill_cte("filled", "bursty", ["price"])) + "SELECT series_id, event_id, ts, price FROM filled",
    doubles=("price",),
)
def q_fill_bursty(spark, sf_dir):
    """Time-linear fill of ticks without a grid position, one of them 24 years before the others."""
    d = fx.fixture_bursty(spark, sf_dir)
    return fill.fill_time_linear(d, [PRICE], carry_rows=_BURST_ROWS).select(SERIES, "event_id", TS, PRICE)
