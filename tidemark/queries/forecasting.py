"""Queries for evaluation, bands, detectors, roll-ups, future features and forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefn as tf
from ..operators import detect, evaluate as ev, forecast as fc
from ..operators.rollup import aggregate_daily
from ..plans import sqlref as S
from ..plans.ordered import time_position
from ..plans.registry import register
from ..plans.rolling import Lag, ordered_features
from ..session import IDX, PRICE, SERIES, TS
from ..sources import fixtures as fx
from ..sources.grids import forecast_dates, future_grid

_FROWS = "f WHERE actual IS NOT NULL"


@register(
    "naive_forecast",
    S.with_(S.F) + f"""SELECT series_id, ts, actual,
  coalesce(lag(actual) OVER (PARTITION BY series_id ORDER BY ts), actual) AS naive FROM {_FROWS}""",
    doubles=("actual", "naive"),
)
def q_naive_forecast(spark, sf_dir):
    f = fx.fixture_f(spark, sf_dir).filter(F.col("actual").isNotNull())
    return ev.naive_forecast(f).select(SERIES, TS, "actual", "naive")


_METRICS_SQL = """
SELECT series_id, CAST(count(*) AS BIGINT) AS n, avg(abs(predicted - actual)) AS MAE,
  avg((predicted - actual) * (predicted - actual)) AS MSE, sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE,
  avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100.0 AS MAPE,
  CASE WHEN avg((naive - actual) * (naive - actual)) <> 0
    THEN sqrt(avg((predicted - actual) * (predicted - actual))) / sqrt(avg((naive - actual) * (naive - actual))) END AS Theils_U
FROM (SELECT *, coalesce(lag(actual) OVER (PARTITION BY series_id ORDER BY ts), actual) AS naive FROM {src} WHERE actual IS NOT NULL)
GROUP BY series_id"""
_MCOLS = ("MAE", "MSE", "RMSE", "MAPE", "Theils_U")


@register("forecast_metrics", S.with_(S.F) + _METRICS_SQL.format(src="f"), doubles=_MCOLS)
def q_forecast_metrics(spark, sf_dir):
    return ev.forecast_metrics(fx.fixture_f(spark, sf_dir))


@register(
    "historical_bands",
    S.with_(S.F) + """SELECT series_id, ts, predicted, predicted - 1.96 * sd AS lower, predicted + 1.96 * sd AS upper
  FROM f JOIN (SELECT series_id, stddev_pop(actual - predicted) AS sd FROM f WHERE actual IS NOT NULL GROUP BY series_id) USING (series_id)
  WHERE actual IS NOT NULL""",
    doubles=("predicted", "lower", "upper"),
)
def q_historical_bands(spark, sf_dir):
    f = fx.fixture_f(spark, sf_dir).filter(F.col("actual").isNotNull()).drop("lower", "upper")
    return ev.historical_bands(f, 1.96).select(SERIES, TS, "predicted", "lower", "upper")


@register(
    "future_bands",
    S.with_(S.F) + """SELECT series_id, ts, predicted, predicted - 1.96 * 0.1 * abs(predicted) AS lower,
  predicted + 1.96 * 0.1 * abs(predicted) AS upper FROM f WHERE actual IS NULL""",
    doubles=("predicted", "lower", "upper"),
)
def q_future_bands(spark, sf_dir):
    f = fx.fixture_f(spark, sf_dir).filter(F.col("actual").isNull()).drop("lower", "upper")
    return ev.future_bands(f, 1.96).select(SERIES, TS, "predicted", "lower", "upper")


def _flag_sql(op: str, name: str) -> str:
    return S.with_(S.F) + f"""SELECT series_id, ts, predicted, coalesce(predicted {op} (m {'+' if op == '>' else '-'} 3 * s), false) AS {name}
FROM (SELECT *, avg(predicted) OVER w AS m, stddev_samp(predicted) OVER w AS s FROM f
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@register("detect_spikes", _flag_sql(">", "is_spike"), doubles=("predicted",))
def q_detect_spikes(spark, sf_dir):
    return detect.detect_spikes(fx.fixture_f(spark, sf_dir), 3.0).select(SERIES, TS, "predicted", "is_spike")


@register("detect_drops", _flag_sql("<", "is_drop"), doubles=("predicted",))
def q_detect_drops(spark, sf_dir):
    return detect.detect_drops(fx.fixture_f(spark, sf_dir), 3.0).select(SERIES, TS, "predicted", "is_drop")


@register(
    "aggregate_daily",
    S.with_(S.F) + """SELECT series_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(predicted) AS predicted, avg(actual) AS actual,
  avg(lower) AS lower, avg(upper) AS upper FROM f GROUP BY ALL""",
    doubles=("predicted", "actual", "lower", "upper"),
)
def q_aggregate_daily(spark, sf_dir):
    return aggregate_daily(fx.fixture_f(spark, sf_dir))


@register(
    "pct_change",
    S.with_(S.F) + """SELECT series_id, ts, predicted, CASE WHEN prev = 0 THEN 0 ELSE (predicted - prev) / prev * 100.0 END AS pct_change
  FROM (SELECT *, lag(predicted) OVER (PARTITION BY series_id ORDER BY ts) AS prev FROM f)""",
    doubles=("predicted", "pct_change"),
)
def q_pct_change(spark, sf_dir):
    f = time_position(fx.fixture_f(spark, sf_dir), TS)
    f = ordered_features(f, lags=[Lag("_prev", "predicted", 1)])
    return f.select(SERIES, TS, "predicted", tf.pct_change("predicted", "_prev").alias("pct_change"))


@register(
    "format_timestamp",
    S.with_(S.F) + """SELECT series_id, ts, strftime(ts, '%Y-%m-%d %H:%M') AS ts_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_export FROM f""",
)
def q_format_timestamp(spark, sf_dir):
    f = fx.fixture_f(spark, sf_dir)
    return f.select(SERIES, TS, tf.format_timestamp(TS).alias("ts_text"), tf.format_export(TS).alias("ts_export"))


@register(
    "forecast_dates",
    S.with_(S.H) + """SELECT series_id, CAST(range AS BIGINT) AS h, start + to_hours(range) AS ts
  FROM (SELECT series_id, max(ts) AS start FROM h GROUP BY series_id) CROSS JOIN range(0, 720)""",
)
def q_forecast_dates(spark, sf_dir):
    starts = fx.fixture_h(spark, sf_dir).groupBy(SERIES).agg(F.max(TS).alias("start"))
    return forecast_dates(starts, 30).select(SERIES, "h", TS)


@register(
    "future_grid",
    S.with_(S.HF) + """SELECT series_id, CAST(range AS BIGINT) AS h, last + to_hours(range + 1) AS ts
  FROM (SELECT series_id, max(ts) AS last FROM hf GROUP BY series_id) CROSS JOIN range(0, 168)""",
)
def q_future_grid(spark, sf_dir):
    return future_grid(fx.fixture_h_filled(spark, sf_dir), 7, 3600).select(SERIES, "h", TS)


@register(
    "future_grid_steps",
    S.with_(S.D) + """SELECT series_id, step, CAST(range AS BIGINT) AS h, last + to_seconds((range + 1) * step) AS ts
  FROM (SELECT series_id, max(ts) AS last FROM d GROUP BY series_id) CROSS JOIN (VALUES (7200), (86400), (604800), (1209600)) s(step)
  CROSS JOIN range(0, 200) WHERE range < 10 * 86400 // step""",
)
def q_future_grid_steps(spark, sf_dir):
    """Ten days ahead by two hours, a day, a week (one row) and two weeks (none)."""
    d = fx.fixture_d(spark, sf_dir)
    out = [future_grid(d, 10, k).select(SERIES, F.lit(k).alias("step"), "h", TS) for k in (7200, 86400, 604800, 1209600)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_FF_LAGS = S.lag_list(1, 24)


def _future_features_sql() -> str:
    joins = []
    cols = []
    for i, (name, k) in enumerate(_FF_LAGS):
        a = f"l{i}"
        joins.append(
            f"LEFT JOIN hf {a} ON {a}.series_id = g.series_id AND {a}.idx = greatest(0, least(g.n - 1, g.n + g.h - {k}))"
        )
        cols.append(f"{a}.price AS {name}")
    roll = []
    for d in (1, 7, 30):
        roll += [
            f"s.m AS price_rolling_mean_{d}d",
            f"s.sd AS price_rolling_std_{d}d",
            f"s.mn AS price_rolling_min_{d}d",
            f"s.mx AS price_rolling_max_{d}d",
            f"s.mx - s.mn AS price_rolling_range_{d}d",
        ]
    return (
        S.with_(
            S.HF,
            """ffn AS (SELECT series_id, count(*) AS n, max(idx) AS last, max(ts) AS last_ts FROM hf GROUP BY series_id),
g0 AS (SELECT series_id, CAST(range AS BIGINT) AS h, last_ts + to_hours(range + 1) AS ts, n FROM ffn CROSS JOIN range(0, 168)),
s AS (SELECT hf.series_id, avg(price) AS m, stddev_pop(price) AS sd, min(price) AS mn, max(price) AS mx
  FROM hf JOIN ffn USING (series_id) WHERE idx > last - 100 GROUP BY hf.series_id)""",
        )
        + f"""SELECT g.series_id, g.h, g.ts, {S.temporal_sql('g.ts')}, {', '.join(cols)}, {', '.join(roll)}
FROM g0 g {' '.join(joins)} LEFT JOIN s ON s.series_id = g.series_id"""
    )


_FF_DBL = [n for n, _ in _FF_LAGS] + S.rolling_names() + S.CAL_DBL


@register("future_features", _future_features_sql(), doubles=tuple(_FF_DBL))
def q_future_features(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    out = fc.future_features(hf, 7, 3600)
    return out.select(SERIES, "h", TS, *S.CAL_INT, *_FF_DBL)


@register(
    "extend_history",
    S.with_(S.F) + """SELECT series_id, ts, arg_min(price, prio) AS price FROM (
  SELECT series_id, ts, price, 0 AS prio FROM hf UNION ALL SELECT series_id, ts, predicted, 1 FROM f) GROUP BY ALL""",
    doubles=("price",),
)
def q_extend_history(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir)
    return fc.extend_history(hf, fx.fixture_f(spark, sf_dir, hf))


@register(
    "combine_forecast",
    S.with_(S.F) + "SELECT series_id, ts, actual, predicted, lower, upper FROM f",
    doubles=("actual", "predicted", "lower", "upper"),
)
def q_combine_forecast(spark, sf_dir):
    f = fx.fixture_f(spark, sf_dir)
    tested = f.filter(F.col("actual").isNotNull())
    future = f.filter(F.col("actual").isNull()).drop("actual")
    return fc.combine_forecast(tested, future).select(SERIES, TS, "actual", "predicted", "lower", "upper")


@register(
    "sequence_windows",
    S.with_(S.HF) + """SELECT series_id, ts, CAST(c AS BIGINT) AS n_window, s AS window_sum FROM (
  SELECT *, count(price) OVER w AS c, sum(price) OVER w AS s FROM hf
  WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)) WHERE idx >= 72""",
    doubles=("window_sum",),
)
def q_sequence_windows(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    w = fc.sequence_windows(hf, PRICE, 72)
    return w.select(
        SERIES,
        TS,
        F.size("window").cast("long").alias("n_window"),
        F.aggregate("window", F.lit(0.0), lambda acc, x: acc + x).alias("window_sum"),
    )


@register(
    "scaler_round_trip",
    S.with_(S.HF, """sc AS (SELECT series_id, avg(price) AS mu, CASE WHEN coalesce(stddev_pop(price), 0) = 0 THEN 1.0 ELSE stddev_pop(price) END AS sd
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hf) WHERE idx < n - ceil(n * 0.2) GROUP BY series_id)""")
    + """SELECT series_id, ts, price, (price - mu) / sd AS scaled, ((price - mu) / sd) * sd + mu AS restored, mu, sd FROM hf JOIN sc USING (series_id)""",
    doubles=("price", "scaled", "restored", "mu", "sd"),
)
def q_scaler_round_trip(spark, sf_dir):
    """fit_scaler on the train part, apply_scaler to all rows, invert_scaler back."""
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    n = hf.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n"))
    train = hf.join(n, SERIES).filter(F.col(IDX) < F.col("_n") - F.ceil(F.col("_n") * 0.2))
    sc = fc.fit_scaler(train, [PRICE])
    scaled = fc.apply_scaler(hf, sc, [PRICE], suffix="_s").withColumnRenamed("price_s", "scaled")
    back = fc.invert_scaler(scaled.select(SERIES, TS, F.col("scaled").alias(PRICE)), sc, [PRICE], suffix="")
    back = back.withColumnRenamed(PRICE, "restored")
    out = scaled.select(SERIES, TS, PRICE, "scaled").join(back.select(SERIES, TS, "restored"), [SERIES, TS])
    return out.join(sc.select(SERIES, F.col("price__mean").alias("mu"), F.col("price__sd").alias("sd")), SERIES)


_SN_SQL = S.with_(
    S.HF,
    """sp AS (SELECT series_id, count(*) AS n, count(*) - ceil(count(*) * 0.2) AS m, max(ts) AS last FROM hf GROUP BY series_id HAVING count(*) >= 168),
t AS (SELECT a.series_id, a.ts, a.price AS actual, b.price AS predicted FROM hf a JOIN sp USING (series_id)
  JOIN hf b ON b.series_id = a.series_id AND b.idx = a.idx - 168 WHERE a.idx >= sp.m),
sd AS (SELECT series_id, stddev_pop(actual - predicted) AS sd FROM t GROUP BY series_id),
fg AS (SELECT series_id, range AS h, last + to_hours(range + 1) AS ts, n FROM sp CROSS JOIN range(0, 168)),
fu AS (SELECT fg.series_id, fg.ts, b.price AS predicted FROM fg JOIN hf b ON b.series_id = fg.series_id AND b.idx = fg.n - 168 + (fg.h % 168))""",
)
_SN_FC = _SN_SQL + """SELECT series_id, ts, actual, predicted, predicted - 1.96 * sd AS lower, predicted + 1.96 * sd AS upper, 'seasonal_naive' AS model
FROM t JOIN sd USING (series_id)
UNION ALL SELECT series_id, ts, NULL, predicted, predicted - 1.96 * 0.1 * abs(predicted), predicted + 1.96 * 0.1 * abs(predicted), 'seasonal_naive' FROM fu"""
_FC_DBL = ("actual", "predicted", "lower", "upper")


@register("forecast_seasonal_naive", _SN_FC, doubles=_FC_DBL)
def q_forecast_seasonal_naive(spark, sf_dir):
    out, _ = fc.forecast_seasonal_naive(fx.fixture_h_filled(spark, sf_dir), 7, 3600)
    return out.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


_TS_SQL = S.with_(
    S.HF,
    """sp AS (SELECT series_id, count(*) AS n, count(*) - ceil(count(*) * 0.2) AS m, max(ts) AS last FROM hf GROUP BY series_id),
tr AS (SELECT hf.series_id, hf.ts, hf.idx, hf.price FROM hf JOIN sp USING (series_id) WHERE hf.idx < sp.m),"""
    + S.decompose_cte("dec", "tr", 168)
    + """,
ln AS (SELECT series_id, regr_slope(trend, idx) AS b, regr_intercept(trend, idx) AS a
  FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS mx FROM dec) WHERE idx > mx - 336 GROUP BY series_id),
ph AS (SELECT DISTINCT series_id, idx % 168 AS ph, seasonal FROM dec),
t AS (SELECT hf.series_id, hf.ts, hf.price AS actual, ln.a + ln.b * hf.idx + ph.seasonal AS predicted
  FROM hf JOIN sp USING (series_id) JOIN ln ON ln.series_id = hf.series_id JOIN ph ON ph.series_id = hf.series_id AND ph.ph = hf.idx % 168
  WHERE hf.idx >= sp.m),
sd AS (SELECT series_id, stddev_pop(actual - predicted) AS sd FROM t GROUP BY series_id),
fg AS (SELECT series_id, range AS h, last + to_hours(range + 1) AS ts, n + range AS idx FROM sp CROSS JOIN range(0, 168)),
fu AS (SELECT fg.series_id, fg.ts, ln.a + ln.b * fg.idx + ph.seasonal AS predicted FROM fg JOIN ln ON ln.series_id = fg.series_id
  JOIN ph ON ph.series_id = fg.series_id AND ph.ph = fg.idx % 168)""",
)
_TS_FC = _TS_SQL + """SELECT series_id, ts, actual, predicted, predicted - 1.96 * sd AS lower, predicted + 1.96 * sd AS upper, 'trend_seasonal' AS model
FROM t JOIN sd USING (series_id)
UNION ALL SELECT series_id, ts, NULL, predicted, predicted - 1.96 * 0.1 * abs(predicted), predicted + 1.96 * 0.1 * abs(predicted), 'trend_seasonal' FROM fu"""


@register("forecast_trend_seasonal", _TS_FC, doubles=_FC_DBL)
def q_forecast_trend_seasonal(spark, sf_dir):
    out, _ = fc.forecast_trend_seasonal(fx.fixture_h_filled(spark, sf_dir), 7, 3600)
    return out.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


@register(
    "backend_metrics",
    "SELECT * FROM ("
    + _SN_SQL
    + _METRICS_SQL.format(src="t").replace("SELECT series_id,", "SELECT 'seasonal_naive' AS model, series_id,", 1)
    + ") UNION ALL SELECT * FROM ("
    + _TS_SQL
    + _METRICS_SQL.format(src="t").replace("SELECT series_id,", "SELECT 'trend_seasonal' AS model, series_id,", 1)
    + ")",
    doubles=_MCOLS,
)
def q_backend_metrics(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir)
    _, m1 = fc.forecast_seasonal_naive(hf, 7, 3600)
    _, m2 = fc.forecast_trend_seasonal(hf, 7, 3600)
    cols = ["model", SERIES, "n", *_MCOLS]
    return m1.select(*cols).unionByName(m2.select(*cols))
