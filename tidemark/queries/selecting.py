"""Queries for rank-correlation selection of inputs, walk-forward evaluation and similar days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators.backtest import fold_metrics, walk_forward
from ..operators.resample import resample_interpolate
from ..operators.selection import select_features
from ..operators.similar import cluster_days, day_vectors, similar_days
from ..plans import sqlref as S
from ..plans.registry import register
from ..session import IDX, PRICE, SERIES, TS
from ..sources import fixtures as fx
from .features import _dense_d_sql

_INPUTS = ["price_lag_24h", "price_lag_7d", "price_lag_30d", "price_rolling_mean_7d", "price_rolling_std_30d", "price_rolling_max_30d",
           "day", "day_of_week", "month", "quarter", "is_weekend", "month_sin"]
_WEEK, _MONTH = ({s: f"price_rolling_{s}_{d}d" for s in ("mean", "std", "min", "max")} for d in (7, 30))


def _spearman_sql() -> str:
    ranked = lambda c: f"rank() OVER (PARTITION BY series_id, feature ORDER BY {c}) + (count(*) OVER (PARTITION BY series_id, feature, {c}) - 1) / 2.0"
    pairs = " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, price AS y FROM feats WHERE {c} IS NOT NULL AND price IS NOT NULL" for c in _INPUTS
    )
    return S.with_(
        S.D, _dense_d_sql("dd", 86400),
        f"""feats AS (SELECT series_id, ts, price, lag(price, 1) OVER w AS price_lag_24h, lag(price, 7) OVER w AS price_lag_7d, lag(price, 30) OVER w AS price_lag_30d,
  {S.roll_sql("price", 7, _WEEK)}, {S.roll_sql("price", 30, _MONTH)}, {S.temporal_sql()} FROM dd WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
pairs AS ({pairs}),
ranks AS (SELECT series_id, feature, {ranked("x")} AS rx, {ranked("y")} AS ry FROM pairs),
found AS (SELECT series_id, feature, count(*) AS n, corr(rx, ry) AS rho FROM ranks GROUP BY ALL)""",
    ) + "SELECT *, abs(rho) >= 0.05 AS selected FROM found"


@register("select_features_spearman", _spearman_sql(), doubles=("rho",))
def q_select_features_spearman(spark, sf_dir):
    """Spearman's coefficient of lags, rolling statistics and calendar columns (with many ties) with the daily price."""
    daily = resample_interpolate(fx.fixture_d(spark, sf_dir), 86400).select(SERIES, TS, IDX, PRICE)
    feats = fe.temporal_features(fe.rolling_features(fe.lag_features(daily, 86400), 86400))
    return select_features(feats, _INPUTS, least=0.05).select(SERIES, "feature", "n", "rho", "selected")


_FOLDS = 5


def _walk_sql() -> str:
    line = f"""line AS (SELECT t.series_id, t.idx, t.fold, t.price AS actual, any_value(m.a) + any_value(m.b) * t.idx AS predicted
  FROM rows_ t JOIN (SELECT k.series_id, k.fold, regr_slope(r.price, r.idx) AS b, regr_intercept(r.price, r.idx) AS a
    FROM (SELECT DISTINCT series_id, fold FROM rows_ WHERE fold > 0) k JOIN rows_ r ON r.series_id = k.series_id AND r.fold < k.fold GROUP BY ALL) m
  ON t.series_id = m.series_id AND t.fold = m.fold GROUP BY t.series_id, t.idx, t.fold, t.price)"""
    phase = """phase AS (SELECT t.series_id, t.idx, t.fold, t.price AS actual, m.p AS predicted
  FROM rows_ t JOIN (SELECT k.series_id, k.fold, r.idx % 168 AS ph, avg(r.price) AS p
    FROM (SELECT DISTINCT series_id, fold FROM rows_ WHERE fold > 0) k JOIN rows_ r ON r.series_id = k.series_id AND r.fold < k.fold GROUP BY ALL) m
  ON t.series_id = m.series_id AND t.fold = m.fold AND t.idx % 168 = m.ph)"""
    score = lambda m: f"""SELECT series_id, '{m}' AS model, CAST(fold AS BIGINT) AS fold, count(*) AS n, avg(abs(predicted - actual)) AS MAE,
  sqrt(avg((predicted - actual) * (predicted - actual))) AS RMSE,
  avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100.0 AS MAPE FROM {m} GROUP BY series_id, fold"""  # noqa: E731
    return S.with_(
        S.HF,
        f"""rows_ AS (SELECT series_id, idx, price, greatest(0, floor((idx - (n - {_FOLDS} * (n // {_FOLDS + 1}))) / (n // {_FOLDS + 1})) + 1) AS fold
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM hf))""",
        line, phase,
    ) + score("line") + " UNION ALL " + score("phase")


@register("walk_forward", _walk_sql(), doubles=("MAE", "RMSE", "MAPE"))
def q_walk_forward(spark, sf_dir):
    """Five expanding folds of every hourly series by two models whose fits are merges of fold statistics."""
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    out = fold_metrics(walk_forward(hf, _FOLDS, "line")).unionByName(fold_metrics(walk_forward(hf, _FOLDS, "phase", 168)))
    return out.select(SERIES, "model", "fold", "n", "MAE", "RMSE", "MAPE")


_DAYS = S.with_(
    S.H,
    "hours AS (SELECT series_id, CAST(ts AS DATE) AS day, hour(ts) AS slot, avg(price) AS x FROM h GROUP BY ALL)",
    """days AS (SELECT series_id, day, count(x) AS n_present, avg(x) AS level, stddev_pop(x) AS spread FROM hours GROUP BY ALL)""",
    """slots AS (SELECT d.series_id, d.day, CAST(j AS INTEGER) AS slot, n_present,
  CASE WHEN x IS NULL OR spread <= 1e-9 * greatest(1.0, abs(level)) THEN 0.0 ELSE (x - level) / spread END AS z
  FROM days d CROSS JOIN (SELECT unnest(range(24)) AS j) LEFT JOIN hours o ON o.series_id = d.series_id AND o.day = d.day AND o.slot = j)""",
)


@register(
    "day_vectors",
    _DAYS
    + """SELECT d.series_id, CAST(d.day AS VARCHAR) AS day, any_value(d.n_present) AS n_present, any_value(level) AS level, any_value(spread) AS spread,
  sum((slot + 1) * z) AS weighted, max(z) FILTER (slot = 7) AS hour_7 FROM days d JOIN slots s ON s.series_id = d.series_id AND s.day = d.day GROUP BY d.series_id, d.day""",
    doubles=("level", "spread", "weighted", "hour_7"),
)
def q_day_vectors(spark, sf_dir):
    """Every day of every series as 24 values: its level, spread and shape (order-sensitive sum)."""
    days = day_vectors(fx.fixture_h(spark, sf_dir))
    weighted = F.aggregate(F.transform("shape", lambda z, j: (j + 1) * z), F.lit(0.0), lambda acc, x: acc + x)
    return days.select(SERIES, F.col("day").cast("string").alias("day"), "n_present", "level", "spread", weighted.alias("weighted"), F.get("shape", F.lit(7)).alias("hour_7"))


@register(
    "similar_days",
    _DAYS
    + """, t AS (SELECT series_id, max(day) AS target FROM days WHERE n_present > 0 GROUP BY series_id),
near AS (SELECT t.series_id, t.target, b.day, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 9) AS distance
  FROM t JOIN slots a ON a.series_id = t.series_id AND a.day = t.target
  JOIN slots b ON b.series_id = t.series_id AND b.slot = a.slot AND b.day < t.target AND b.n_present > 0 GROUP BY ALL)
SELECT series_id, CAST(target AS VARCHAR) AS target, CAST(day AS VARCHAR) AS day, place, distance
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, target ORDER BY distance, day DESC) AS place FROM near) WHERE place <= 5""",
    doubles=("distance",),
)
def q_similar_days(spark, sf_dir):
    """The five earlier days whose course is most like that of a series' last day."""
    found = similar_days(day_vectors(fx.fixture_h(spark, sf_dir)), 5)
    return found.select(SERIES, F.col("target").cast("string").alias("target"), F.col("day").cast("string").alias("day"), "place", "distance")


@register("day_clusters", None, notes="k-means over day shapes; tested on planted shapes and against the nearest centre")
def q_day_clusters(spark, sf_dir):
    """The cluster of every day of every series."""
    days = cluster_days(day_vectors(fx.fixture_h(spark, sf_dir)))
    return days.select(SERIES, F.col("day").cast("string").alias("day"), "n_present", "cluster")
