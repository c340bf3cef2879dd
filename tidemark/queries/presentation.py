"""Queries for alignment, chart tables and file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import charts
from ..operators.align import align_to
from ..operators.decompose import decompose
from ..operators.evaluate import forecast_metrics
from ..plans import sqlref as S
from ..plans.registry import register
from ..session import IDX, PRICE, SERIES, TS, shared_path
from ..sources import files
from ..sources import fixtures as fx

_FH = "fh AS (SELECT series_id, ts, actual AS price FROM f WHERE actual IS NOT NULL)"


@register(
    "align_to",
    S.with_(S.F, _FH)
    + """SELECT 'semi' AS mode, series_id, ts, price FROM h WHERE EXISTS (SELECT 1 FROM fh WHERE fh.series_id = h.series_id AND fh.ts = h.ts)
UNION ALL SELECT 'left', fh.series_id, fh.ts, h.price FROM fh LEFT JOIN h ON fh.series_id = h.series_id AND fh.ts = h.ts
UNION ALL SELECT 'pad', hf.series_id, hf.ts, coalesce(p.price, l.lastp) FROM hf
  LEFT JOIN (SELECT series_id, price, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS pos FROM fh) p
    ON p.series_id = hf.series_id AND p.pos = hf.idx
  LEFT JOIN (SELECT series_id, arg_max(price, ts) AS lastp FROM fh GROUP BY series_id) l ON l.series_id = hf.series_id""",
    doubles=("price",),
)
def q_align_to(spark, sf_dir):
    h_full = fx.fixture_h(spark, sf_dir)
    hf_full = fx.fixture_h_filled(spark, sf_dir, h_full)
    h = h_full.select(SERIES, TS, PRICE)
    hf = hf_full.select(SERIES, TS, IDX, PRICE)
    fh = fx.fixture_f(spark, sf_dir, hf_full).filter(F.col("actual").isNotNull()).select(SERIES, TS, F.col("actual").alias(PRICE))
    semi = align_to(h, fh, "semi").select(F.lit("semi").alias("mode"), SERIES, TS, PRICE)
    left = align_to(h, fh, "left").select(F.lit("left").alias("mode"), SERIES, TS, PRICE)
    pad = align_to(fh, hf, "pad").select(F.lit("pad").alias("mode"), SERIES, TS, PRICE)
    return semi.unionByName(left).unionByName(pad)


_SPLIT = """sf AS (SELECT f.*, CASE WHEN fs IS NULL OR ts < fs THEN 'history' ELSE 'future' END AS part FROM f
  JOIN (SELECT series_id, min(CASE WHEN actual IS NULL THEN ts END) AS fs FROM f GROUP BY series_id) USING (series_id))"""


@register(
    "split_forecast",
    S.with_(S.F, _SPLIT) + "SELECT series_id, ts, actual, predicted, part FROM sf",
    doubles=("actual", "predicted"),
)
def q_split_forecast(spark, sf_dir):
    return charts.split_forecast(fx.fixture_f(spark, sf_dir)).select(SERIES, TS, "actual", "predicted", "part")


_PRESET_SQL = S.with_(
    S.H,
    """lt AS (SELECT series_id, max(ts) AS last FROM h GROUP BY series_id),
cu AS (SELECT series_id, '1w' AS preset, last - INTERVAL 7 DAY AS cutoff FROM lt
  UNION ALL SELECT series_id, '2w', last - INTERVAL 14 DAY FROM lt
  UNION ALL SELECT series_id, '1m', last - INTERVAL 1 MONTH FROM lt
  UNION ALL SELECT series_id, '3m', last - INTERVAL 3 MONTH FROM lt
  UNION ALL SELECT series_id, '6m', last - INTERVAL 6 MONTH FROM lt
  UNION ALL SELECT series_id, '1y', last - INTERVAL 12 MONTH FROM lt
  UNION ALL SELECT series_id, 'all', CAST(NULL AS TIMESTAMP) FROM lt)""",
)


@register(
    "range_preset",
    _PRESET_SQL
    + """SELECT h.series_id, cu.preset, CAST(count(*) AS BIGINT) AS n_rows, min(h.ts) AS first_ts, max(h.ts) AS last_ts
FROM h JOIN cu ON cu.series_id = h.series_id AND (cu.cutoff IS NULL OR h.ts >= cu.cutoff) GROUP BY ALL""",
)
def q_range_preset(spark, sf_dir):
    h = fx.fixture_h(spark, sf_dir).select(SERIES, TS, PRICE)
    cut = charts.preset_cutoffs(h)
    j = h.join(cut, SERIES).filter(F.col("cutoff").isNull() | (F.col(TS) >= F.col("cutoff")))
    return j.groupBy(SERIES, "preset").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")
    )


@register(
    "chart_history",
    S.with_(S.H) + "SELECT series_id, ts, price FROM h WHERE ts >= (SELECT max(ts) FROM h h2 WHERE h2.series_id = h.series_id) - INTERVAL 7 DAY",
    doubles=("price",),
)
def q_chart_history(spark, sf_dir):
    return charts.chart_history(fx.fixture_h(spark, sf_dir), "1w").select(SERIES, TS, PRICE)


@register(
    "chart_forecast",
    S.with_(S.F, _SPLIT)
    + """SELECT * FROM (SELECT series_id, ts, part, trace, y FROM sf UNPIVOT (y FOR trace IN (actual, predicted, lower, upper)))
  WHERE NOT (trace = 'actual' AND part = 'future')""",
    doubles=("y",),
)
def q_chart_forecast(spark, sf_dir):
    return charts.chart_forecast(fx.fixture_f(spark, sf_dir)).select(SERIES, TS, "part", "trace", "y")


@register(
    "chart_metrics",
    "SELECT model, series_id, metric, value FROM ("
    + S.with_(S.F)
    + """SELECT 'lag24' AS model, * FROM (SELECT series_id, avg(abs(predicted - actual)) AS MAE,
  sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE,
  avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100.0 AS MAPE,
  CASE WHEN avg((naive - actual) * (naive - actual)) <> 0
    THEN sqrt(avg((predicted - actual) * (predicted - actual))) / sqrt(avg((naive - actual) * (naive - actual))) END AS Theils_U
  FROM (SELECT *, coalesce(lag(actual) OVER (PARTITION BY series_id ORDER BY ts), actual) AS naive FROM f WHERE actual IS NOT NULL)
  GROUP BY series_id)) UNPIVOT (value FOR metric IN (MAE, RMSE, MAPE, Theils_U))""",
    doubles=("value",),
)
def q_chart_metrics(spark, sf_dir):
    m = forecast_metrics(fx.fixture_f(spark, sf_dir)).withColumn("model", F.lit("lag24"))
    return charts.chart_metrics(m).select("model", SERIES, "metric", "value")


@register(
    "chart_decomposition",
    S.with_(S.HF, S.decompose_cte("dec", "hf", 168))
    + "SELECT series_id, ts, component, value FROM (SELECT series_id, ts, price, trend, seasonal, residual FROM dec) UNPIVOT (value FOR component IN (price, trend, seasonal, residual))",
    doubles=("value",),
)
def q_chart_decomposition(spark, sf_dir):
    dec = decompose(fx.fixture_h_filled(spark, sf_dir), 3600)
    return charts.chart_decomposition(dec).select(SERIES, TS, "component", "value")


def _scratch(spark, what: str) -> str:
    return shared_path(spark, "io", f"{what}-{uuid.uuid4().hex}")


@register(
    "csv_round_trip",
    S.with_(S.F) + "SELECT series_id, ts, price FROM (SELECT series_id, ts, predicted AS price FROM f)",
    doubles=("price",),
)
def q_csv_round_trip(spark, sf_dir):
    """write_forecast_csv of F, then read_series_csv of the files (text bound by header name)."""
    f = fx.fixture_f(spark, sf_dir).select(SERIES, TS, F.col("predicted").alias(PRICE), "lower", "upper")
    path = files.write_forecast_csv(f, _scratch(spark, "csv"))
    return files.read_series_csv(spark, path).select(SERIES, TS, PRICE)


@register(
    "json_round_trip",
    S.with_(S.HX) + "SELECT series_id, ts, price, temperature, load FROM hx",
    doubles=("price", "temperature", "load"),
)
def q_json_round_trip(spark, sf_dir):
    """HX written as JSON lines with text stamps, read back with read_series_json."""
    hx = fx.fixture_hx(spark, sf_dir).select(
        SERIES, F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), PRICE, "temperature", "load"
    )
    path = _scratch(spark, "json")
    hx.write.json(path)
    return files.read_series_json(spark, path, layout="lines").select(SERIES, TS, PRICE, "temperature", "load")


def _monthly(spark, sf_dir, layout: str):
    """HX written as one JSON value per series and month, read back."""
    hx = fx.fixture_hx(spark, sf_dir).withColumn("timestamp", F.date_format(TS, "MMM d, yyyy HH:mm:ss"))
    columns = [SERIES, "timestamp", PRICE, "temperature", "load"]
    by = hx.withColumns({"part_s": F.col(SERIES), "part_m": F.date_format(TS, "yyyyMM")}).groupBy("part_s", "part_m")  # at most a month's hours
    if layout == "records":
        value = F.to_json(F.sort_array(F.collect_list(F.struct(IDX, *columns))))
    else:
        cells = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(IDX).cast("string"), c))))
        value = F.to_json(F.struct(*[cells(c).alias(c) for c in columns]))
    path = _scratch(spark, f"json-{layout}")
    by.agg(value.alias("value")).write.partitionBy("part_s", "part_m").text(path)
    return files.read_series_json(spark, path, layout=layout).select(SERIES, TS, PRICE, "temperature", "load")


_HX_SQL = S.with_(S.HX) + "SELECT series_id, ts, price, temperature, load FROM hx"


@register("json_records", _HX_SQL, doubles=("price", "temperature", "load"))
def q_json_records(spark, sf_dir):
    """Arrays of records with commas in their stamps, read in pieces."""
    return _monthly(spark, sf_dir, "records")


@register("json_columns", _HX_SQL, doubles=("price", "temperature", "load"))
def q_json_columns(spark, sf_dir):
    """Objects of columns with commas in their stamps, read in pieces."""
    return _monthly(spark, sf_dir, "columns")
