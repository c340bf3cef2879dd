"""Learned forecasters (pyspark.ml) and their inputs.

Tree models and wide linear fits are checked by rows only; the sequence inputs, the future inputs and a linear fit small
enough for closed normal equations have SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.charts import top_features
from ..operators import forecast as fc
from ..operators.mlforecast import MLForecaster
from ..operators.sequences import future_examples, last_rows, sequence_blocks, sequence_examples
from ..plans import sqlref as S
from ..plans.registry import register
from ..session import IDX, PRICE, SERIES, TS
from ..sources import fixtures as fx
from ..sources.grids import future_grid


@register("forecast_linear", None, notes="pyspark.ml LinearRegression over all series; rows-only check")
def q_forecast_linear(spark, sf_dir):
    fc, _ = MLForecaster("linear", 7, 3600).fit(fx.fixture_h_filled(spark, sf_dir)).forecast()
    return fc.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


@register("forecast_gbt", None, notes="pyspark.ml GBTRegressor with validation early stop; rows-only check")
def q_forecast_gbt(spark, sf_dir):
    fc, _ = MLForecaster("gbt", 7, 3600, max_iter=20).fit(fx.fixture_h_filled(spark, sf_dir)).forecast()
    return fc.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


@register(
    "forecast_skipped",
    """SELECT series_id, reason FROM (VALUES ('extreme', 'extreme_price'), ('short', 'no_complete_train_row')) t(series_id, reason)
  WHERE EXISTS (SELECT 1 FROM events)""",
)
def q_forecast_skipped(spark, sf_dir):
    """Series without a forecast, and why: one has an extreme price, one is shorter than the longest lag."""
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    one = hf.filter(F.col(SERIES) == hf.agg(F.min(SERIES)).first()[0])
    odd = one.withColumn(SERIES, F.lit("extreme")).withColumn(PRICE, F.when(F.col(IDX) == 5, F.lit(1e11)).otherwise(F.col(PRICE)))
    short = one.filter(F.col(IDX) < 100).withColumn(SERIES, F.lit("short"))
    m = MLForecaster("linear", 1, 3600, max_iter=5).fit(hf.unionByName(odd).unionByName(short))
    return m.skipped.select(SERIES, "reason")


@register("feature_importance", None, notes="standardised linear coefficients as importance shares")
def q_feature_importance(spark, sf_dir):
    return MLForecaster("linear", 7, 3600).fit(fx.fixture_h_filled(spark, sf_dir)).feature_importance()


@register("top_features", None, notes="top 15 GBT importances, ties by name")
def q_top_features(spark, sf_dir):
    m = MLForecaster("gbt", 7, 3600, max_iter=20).fit(fx.fixture_h_filled(spark, sf_dir))
    return top_features(m.feature_importance(), 15)


@register("learned_metrics", None, notes="MAE/RMSE/MAPE/Theil's U of both learned backends per series")
def q_learned_metrics(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir)
    _, m1 = MLForecaster("linear", 7, 3600).fit(hf).forecast()
    _, m2 = MLForecaster("gbt", 7, 3600, max_iter=20).fit(hf).forecast()
    cols = ["model", SERIES, "n", "MAE", "RMSE", "MAPE", "Theils_U"]
    return m1.select(*cols).unionByName(m2.select(*cols))


# ---------------------------------------------------------------- inputs over all features

_SEQ_COLS = ["price", "load", "temperature"]


def _seq_sql(src: str, seq_len: int) -> str:
    """Order-sensitive sums over the window lists: every place of the tensor has its own weight."""
    lists = ", ".join(f"list({c}) OVER w AS l_{c}" for c in _SEQ_COLS)
    weighted = " + ".join(f"list_sum([(3 * j + {i + 1}) * coalesce(l_{c}[j + 1], 0) FOR j IN range({seq_len})])" for i, c in enumerate(_SEQ_COLS))
    nulls = " + ".join(f"len(list_filter(l_{c}, lambda v: v IS NULL))" for c in _SEQ_COLS)
    return f"""SELECT series_id, ts, idx, len(l_price) AS n_rows, {nulls} AS n_nulls, {weighted} AS weighted,
  l_price[1] AS oldest, l_temperature[{seq_len}] AS newest, price AS y
FROM (SELECT *, {lists} FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {seq_len} PRECEDING AND 1 PRECEDING))
WHERE idx >= {seq_len}"""


def _weighted(x, seq_len: int):
    """The same sums over an array of rows."""
    flat = F.flatten(x)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(3 * seq_len - 1)), F.lit(0.0), lambda acc, p: acc + (p + 1) * F.coalesce(F.get(flat, p), F.lit(0.0)))
    return total, F.size(F.filter(flat, lambda v: v.isNull())).cast("long")


@register("sequence_tensor", S.with_(S.HX) + _seq_sql("hx", 72), doubles=("weighted", "oldest", "newest", "y"))
def q_sequence_tensor(spark, sf_dir):
    """The 72 rows of price and drivers before every row, and its price, of series with gaps."""
    blocks = sequence_blocks(fx.fixture_hx(spark, sf_dir), _SEQ_COLS, PRICE, 72)
    ex = sequence_examples(blocks, 72)
    weighted, nulls = _weighted(F.col("X"), 72)
    first, last = F.get("X", F.lit(0)), F.get("X", F.lit(71))
    return ex.select(
        SERIES, TS, IDX, F.size("X").cast("long").alias("n_rows"), nulls.alias("n_nulls"), weighted.alias("weighted"),
        F.get(first, F.lit(0)).alias("oldest"), F.get(last, F.lit(2)).alias("newest"), "y",
    )


@register(
    "sequence_future",
    S.with_(
        S.HX,
        """n AS (SELECT series_id, count(*) AS n, max(ts) AS last FROM hx GROUP BY series_id HAVING count(*) >= 72),
g AS (SELECT series_id, n, CAST(range AS BIGINT) AS h, last + to_hours(range + 1) AS ts FROM n CROSS JOIN range(0, 168)),
x AS (SELECT g.series_id, g.h, g.ts, j, hx.price, hx.load, hx.temperature FROM g CROSS JOIN (SELECT unnest(range(72)) AS j)
  JOIN hx ON hx.series_id = g.series_id AND hx.idx = least(g.n - 1, g.n + g.h - 72 + j))""",
    )
    + """SELECT series_id, h, ts, sum((3 * j + 1) * coalesce(price, 0) + (3 * j + 2) * coalesce(load, 0) + (3 * j + 3) * coalesce(temperature, 0)) AS weighted,
  CAST(count(*) * 3 - count(price) - count(load) - count(temperature) AS BIGINT) AS n_nulls FROM x GROUP BY ALL""",
    doubles=("weighted",),
)
def q_sequence_future(spark, sf_dir):
    """The 72 rows before every future row, those beyond the history being its last one."""
    hx = fx.fixture_hx(spark, sf_dir)
    out = future_examples(future_grid(hx, 7, 3600), last_rows(hx, _SEQ_COLS, 72), 72, flat=False)
    weighted, nulls = _weighted(F.col("X"), 72)
    return out.select(SERIES, "h", TS, weighted.alias("weighted"), nulls.alias("n_nulls"))


_DRIVERS = ["load", "temperature"]
_FFD_LAGS = [*((n, "price", k) for n, k in S.lag_list(1, 24)), *((f"{c}_lag_24h", c, 24) for c in _DRIVERS)]


def _future_drivers_sql() -> str:
    joins = " ".join(f"LEFT JOIN hxf l{i} ON l{i}.series_id = g.series_id AND l{i}.idx = greatest(0, least(g.n - 1, g.n + g.h - {k}))" for i, (_, _, k) in enumerate(_FFD_LAGS))
    cols = ", ".join(f"l{i}.{c} AS {name}" for i, (name, c, _) in enumerate(_FFD_LAGS))
    rolls = ", ".join(f"avg({c}) AS {c}_rolling_mean_1d, stddev_pop({c}) AS {c}_rolling_std_1d" for c in _DRIVERS)
    return S.with_(
        S.HXF,
        f"""n AS (SELECT series_id, count(*) AS n, max(idx) AS last, max(ts) AS last_ts FROM hxf GROUP BY series_id),
g AS (SELECT series_id, CAST(range AS BIGINT) AS h, last_ts + to_hours(range + 1) AS ts, n FROM n CROSS JOIN range(0, 72)),
s AS (SELECT hxf.series_id, {rolls}, avg(price) AS price_rolling_mean_7d, arg_max(load, idx) AS load, arg_max(temperature, idx) AS temperature
  FROM hxf JOIN n USING (series_id) WHERE idx > last - 100 GROUP BY hxf.series_id)""",
    ) + f"SELECT g.series_id, g.h, g.ts, {cols}, s.* EXCLUDE (series_id) FROM g JOIN s ON s.series_id = g.series_id {joins}"


_FFD_DBL = [n for n, _, _ in _FFD_LAGS] + [f"{c}_rolling_{s}_1d" for c in _DRIVERS for s in ("mean", "std")] + ["price_rolling_mean_7d", *_DRIVERS]


@register("future_features_drivers", _future_drivers_sql(), doubles=tuple(_FFD_DBL))
def q_future_features_drivers(spark, sf_dir):
    """Future features with drivers: clamped lags and recent statistics of their own, last values carried on."""
    out = fc.future_features(fx.fixture_hx_filled(spark, sf_dir), 3, 3600, carry_cols=_DRIVERS)
    return out.select(SERIES, "h", TS, *_FFD_DBL)


_FIT_SQL = S.with_(
    S.HXF,
    """sp AS (SELECT series_id, count(*) AS n, count(*) - ceil(count(*) * 0.2) AS m, max(ts) AS last, arg_max(price, idx) AS p_last, arg_max(load, idx) AS l_last
  FROM hxf GROUP BY series_id),
x AS (SELECT *, lag(price) OVER w AS x1, lag(load) OVER w AS x2 FROM hxf WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
c AS (SELECT avg(price) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12,
  covar_pop(x1, price) AS c1, covar_pop(x2, price) AS c2 FROM x JOIN sp USING (series_id) WHERE x.idx >= 1 AND x.idx < sp.m),
b AS (SELECT (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2, my, m1, m2 FROM c),
k AS (SELECT b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM b)""",
)


def _sequence_linear(spark, sf_dir):
    return MLForecaster("linear", 7, 3600, seq_len=1, drivers=["load"], context=False, reg=0.0).fit(fx.fixture_hx_filled(spark, sf_dir))


@register(
    "sequence_linear_fit",
    _FIT_SQL + "SELECT 'price_t-1' AS feature, b1 AS coefficient FROM k UNION ALL SELECT 'load_t-1', b2 FROM k UNION ALL SELECT 'intercept', b0 FROM k",
    doubles=("coefficient",),
)
def q_sequence_linear_fit(spark, sf_dir):
    """Coefficients of the linear backend over the row before of price and load, against the normal equations."""
    return _sequence_linear(spark, sf_dir).coefficients()


@register(
    "forecast_sequence_linear",
    _FIT_SQL
    + """, t AS (SELECT x.series_id, x.ts, x.price AS actual, b0 + b1 * x1 + b2 * x2 AS predicted FROM x JOIN sp USING (series_id), k WHERE x.idx >= sp.m),
sd AS (SELECT series_id, stddev_pop(actual - predicted) AS sd FROM t GROUP BY series_id),
fu AS (SELECT series_id, last + to_hours(range + 1) AS ts, b0 + b1 * p_last + b2 * l_last AS predicted FROM sp CROSS JOIN range(0, 168), k)
SELECT series_id, ts, actual, predicted, predicted - 1.96 * sd AS lower, predicted + 1.96 * sd AS upper, 'linear' AS model FROM t JOIN sd USING (series_id)
UNION ALL SELECT series_id, ts, NULL, predicted, predicted - 1.96 * 0.1 * abs(predicted), predicted + 1.96 * 0.1 * abs(predicted), 'linear' FROM fu""",
    doubles=("actual", "predicted", "lower", "upper"),
)
def q_forecast_sequence_linear(spark, sf_dir):
    """Test and future part of the linear backend over sequences of price and a driver."""
    out, _ = _sequence_linear(spark, sf_dir).forecast()
    return out.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


@register("forecast_sequences_72", None, notes="linear backend over 72 rows of price and two drivers; tested against least squares")
def q_forecast_sequences_72(spark, sf_dir):
    m = MLForecaster("linear", 7, 3600, seq_len=72, drivers=_DRIVERS).fit(fx.fixture_hx_filled(spark, sf_dir))
    out, _ = m.forecast()
    return out.select(SERIES, TS, "actual", "predicted", "lower", "upper", "model")


@register(
    "loss_history_linear",
    _FIT_SQL
    + """SELECT 'linear' AS backend, CASE WHEN x.idx < sp.m THEN 'train' ELSE 'test' END AS part, CAST(1 AS BIGINT) AS iteration,
  avg((price - b0 - b1 * x1 - b2 * x2) * (price - b0 - b1 * x1 - b2 * x2)) AS loss, true AS best FROM x JOIN sp USING (series_id), k WHERE x.idx >= 1 GROUP BY ALL""",
    doubles=("loss",),
)
def q_loss_history_linear(spark, sf_dir):
    """Loss of the linear backend on its train and test part."""
    return _sequence_linear(spark, sf_dir).loss_history()


@register("loss_history_gbt", None, notes="loss after every tree on the train, validation and test part; tested against sums of trees")
def q_loss_history_gbt(spark, sf_dir):
    """Loss of the tree backend after every iteration; the last is the best on the validation part."""
    return MLForecaster("gbt", 7, 3600, max_iter=20).fit(fx.fixture_h_filled(spark, sf_dir)).loss_history()
