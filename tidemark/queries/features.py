"""Queries for calendar, lag, rolling, driver and decomposition features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators.decompose import add_decomposition_features, decompose
from ..operators.fill import fill_time_linear
from ..operators.resample import resample_interpolate
from ..plans import sqlref as S
from ..plans.ordered import materialize
from ..plans.registry import register
from ..session import IDX, PRICE, SERIES, TS
from ..sources import fixtures as fx


@register(
    "temporal_features",
    S.with_(S.H) + f"SELECT series_id, ts, {S.temporal_sql()} FROM h",
    doubles=tuple(S.CAL_DBL),
)
def q_temporal_features(spark, sf_dir):
    h = fx.fixture_h(spark, sf_dir).select(SERIES, TS)
    return fe.temporal_features(h)


_LAGS_H = S.lag_list(1, 24)
_LAGS_M5 = S.lag_list(12, 288)
_LAG_NAMES = [n for n, _ in _LAGS_H]


@register(
    "lag_features",
    S.with_(S.HF, S.M5)
    + f"SELECT 'H' AS fixture, series_id, ts, price, {S.lags_sql(_LAGS_H)} FROM hf UNION ALL "
    + f"SELECT 'M5', series_id, ts, price, {S.lags_sql(_LAGS_M5)} FROM m5",
    doubles=("price", *_LAG_NAMES),
)
def q_lag_features(spark, sf_dir):
    hf = fe.lag_features(fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE), 3600)
    m5 = fe.lag_features(fx.fixture_m5(spark, sf_dir).select(SERIES, TS, IDX, PRICE), 300)
    cols = [SERIES, TS, PRICE, *_LAG_NAMES]
    return hf.select(F.lit("H").alias("fixture"), *cols).unionByName(m5.select(F.lit("M5").alias("fixture"), *cols))


_ROLL_NAMES = S.rolling_names()


@register(
    "rolling_features",
    S.with_(S.HF, S.M5)
    + f"SELECT 'H' AS fixture, series_id, ts, price, {', '.join(_ROLL_NAMES)} FROM (SELECT *, {S.ranges_sql()} FROM (SELECT series_id, ts, price, {S.rolls_sql(24)} FROM hf)) "
    + f"UNION ALL SELECT 'M5', series_id, ts, price, {', '.join(_ROLL_NAMES)} FROM (SELECT *, {S.ranges_sql()} FROM (SELECT series_id, ts, price, {S.rolls_sql(288)} FROM m5))",
    doubles=("price", *_ROLL_NAMES),
)
def q_rolling_features(spark, sf_dir):
    hf = fe.rolling_features(fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE), 3600)
    m5 = fe.rolling_features(fx.fixture_m5(spark, sf_dir).select(SERIES, TS, IDX, PRICE), 300)
    cols = [SERIES, TS, PRICE, *_ROLL_NAMES]
    return hf.select(F.lit("H").alias("fixture"), *cols).unionByName(m5.select(F.lit("M5").alias("fixture"), *cols))


_HXF = S.HX + "," + S.fill_cte("hxf", "hx", ["price", "load", "temperature"])
_EXT_NAMES = [f"{c}_{s}" for c in ("temperature", "load") for s in ("rolling_mean_1d", "rolling_std_1d", "lag_24h")]


def _ext_sql() -> str:
    parts = []
    for c in ("temperature", "load"):
        parts.append(S.roll_sql(c, 24, {"mean": f"{c}_rolling_mean_1d", "std": f"{c}_rolling_std_1d"}))
        parts.append(f"lag({c}, 24) OVER (PARTITION BY series_id ORDER BY idx) AS {c}_lag_24h")
    return ", ".join(parts)


@register(
    "add_external_features",
    S.with_(_HXF) + f"SELECT series_id, ts, price, temperature, load, {_ext_sql()} FROM hxf",
    doubles=("price", "temperature", "load", *_EXT_NAMES),
)
def q_add_external_features(spark, sf_dir):
    hxf = fill_time_linear(fx.fixture_hx(spark, sf_dir))
    out = fe.add_external_features(hxf.select(SERIES, TS, IDX, PRICE, "temperature", "load"), 3600)
    return out.select(SERIES, TS, PRICE, "temperature", "load", *_EXT_NAMES)


@register(
    "decompose",
    S.with_(S.HF, S.decompose_cte("dec", "hf", 168)) + "SELECT series_id, ts, price, trend, seasonal, residual FROM dec",
    doubles=("price", "trend", "seasonal", "residual"),
)
def q_decompose(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir)
    return decompose(hf, 3600).select(SERIES, TS, PRICE, "trend", "seasonal", "residual")


@register(
    "add_decomposition_features",
    S.with_(S.HF, S.decompose_cte("dec", "hf", 168))
    + f"SELECT hf.series_id, hf.ts, hf.price, {S.decomp_features_sql('dec')} FROM hf LEFT JOIN dec ON hf.series_id = dec.series_id AND hf.idx = dec.idx",
    doubles=("price", *S.DECOMP_NAMES),
)
def q_add_decomposition_features(spark, sf_dir):
    hf = fx.fixture_h_filled(spark, sf_dir).select(SERIES, TS, IDX, PRICE)
    return add_decomposition_features(hf, decompose(hf, 3600)).select(SERIES, TS, PRICE, *fe.DECOMP_COLS)


def d_hourly(spark, sf_dir):
    """D upsampled to hours by time interpolation (about 57,700 rows per priority)."""
    return resample_interpolate(fx.fixture_d(spark, sf_dir), 3600)


_DH_IDX = """dhi AS (SELECT series_id, ts, price, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS idx FROM dh)"""
_FEAT_NAMES = _LAG_NAMES + _ROLL_NAMES + S.CAL_DBL + S.DECOMP_NAMES


def _engineer_sql() -> str:
    lags = S.lags_sql(_LAGS_H)
    rolls = S.rolls_sql(24)
    required = " AND ".join(f"{c} IS NOT NULL" for c in _LAG_NAMES + _ROLL_NAMES)
    return (
        S.with_(
            _D_HOURLY_SQL,
            _DH_IDX,
            S.decompose_cte("dec", "dhi", 168),
            f"""ef0 AS (SELECT series_id, ts, idx, price, {lags}, {rolls}, {S.temporal_sql()} FROM dhi),
ef1 AS (SELECT *, {S.ranges_sql()} FROM ef0)""",
        )
        + f"""SELECT ef1.series_id, ef1.ts, ef1.price, {', '.join('ef1.' + c for c in _LAG_NAMES + _ROLL_NAMES + S.CAL_DBL + S.CAL_INT)},
  {S.decomp_features_sql('dec')}
FROM ef1 LEFT JOIN dec ON ef1.series_id = dec.series_id AND ef1.idx = dec.idx WHERE {required.replace('price_', 'ef1.price_')}"""
    )


_D_HOURLY_SQL = S.D + """,
dh_g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM d GROUP BY series_id),
dh0 AS (SELECT g.series_id, g.ts, d.price FROM dh_g g LEFT JOIN d ON g.series_id = d.series_id AND g.ts = d.ts),""" + S.fill_cte(
    "dh", "dh0", ["price"]
)


_SMALL = (*S.CAL_DBL, *[c for c in S.DECOMP_NAMES if c.endswith("_pct")])


@register("engineer_features", _engineer_sql(), doubles=("price", *_FEAT_NAMES), digits=2, fine=_SMALL)
def q_engineer_features(spark, sf_dir):
    feats, _ = fe.engineer_features(d_hourly(spark, sf_dir), 3600)
    return feats.select(SERIES, TS, PRICE, *_LAG_NAMES, *_ROLL_NAMES, *S.CAL_DBL, *S.CAL_INT, *fe.DECOMP_COLS)


_UF = S.U + "," + S.fill_cte("uf", "u", ["price"])
_U_COLS = ["price_lag_1h", "price_lag_24h", "price_lag_7d"] + [
    f"price_rolling_{s}_{d}d" for d in (1, 7) for s in ("mean", "std", "min", "max")
]


@register(
    "many_series_features",
    S.with_(_UF)
    + "SELECT series_id, ts, price, "
    + "lag(price, 1) OVER w0 AS price_lag_1h, lag(price, 24) OVER w0 AS price_lag_24h, lag(price, 168) OVER w0 AS price_lag_7d, "
    + S.roll_sql("price", 24, {s: f"price_rolling_{s}_1d" for s in ("mean", "std", "min", "max")})
    + ", "
    + S.roll_sql("price", 168, {s: f"price_rolling_{s}_7d" for s in ("mean", "std", "min", "max")})
    + " FROM uf WINDOW w0 AS (PARTITION BY series_id ORDER BY idx)",
    doubles=("price", *_U_COLS),
)
def q_many_series_features(spark, sf_dir):
    """Every user's hourly series: fill, then lags and 1/7-day rolling statistics in one bucketed pass."""
    from ..plans.rolling import Lag, Roll, ordered_features

    uf = fill_time_linear(fx.fixture_u(spark, sf_dir)).select(SERIES, TS, IDX, PRICE)
    rolls = [
        Roll(PRICE, 24, tuple((s, f"price_rolling_{s}_1d") for s in ("mean", "std", "min", "max"))),
        Roll(PRICE, 168, tuple((s, f"price_rolling_{s}_7d") for s in ("mean", "std", "min", "max"))),
    ]
    lags = [Lag("price_lag_1h", PRICE, 1), Lag("price_lag_24h", PRICE, 24), Lag("price_lag_7d", PRICE, 168)]
    return ordered_features(uf, lags=lags, rolls=rolls).select(SERIES, TS, PRICE, *_U_COLS)


_D5 = S.D + """,
d5_g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 5 MINUTE)) AS ts FROM d GROUP BY series_id),
d5_0 AS (SELECT g.series_id, g.ts, d.price FROM d5_g g LEFT JOIN d ON g.series_id = d.series_id AND g.ts = d.ts),""" + S.fill_cte(
    "d5f", "d5_0", ["price"]
) + """,
d5 AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS idx FROM d5f)"""
_L_COLS = ["price_lag_1h", "price_lag_1d"] + [f"price_rolling_{s}_1d" for s in ("mean", "std", "min", "max")]


@register(
    "long_series_features",
    S.with_(_D5)
    + "SELECT series_id, ts, price, lag(price, 12) OVER w0 AS price_lag_1h, lag(price, 288) OVER w0 AS price_lag_1d, "
    + S.roll_sql("price", 288, {s: f"price_rolling_{s}_1d" for s in ("mean", "std", "min", "max")})
    + " FROM d5 WINDOW w0 AS (PARTITION BY series_id ORDER BY idx)",
    doubles=("price", *_L_COLS),
    digits=2,
)
def q_long_series_features(spark, sf_dir):
    """Daily order totals upsampled to 5-minute rows (~690,000 per priority): lags and 1-day (288-row) rolling stats."""
    from ..plans.rolling import Lag, Roll, ordered_features

    d5 = resample_interpolate(fx.fixture_d(spark, sf_dir), 300)
    rolls = [Roll(PRICE, 288, tuple((s, f"price_rolling_{s}_1d") for s in ("mean", "std", "min", "max")))]
    lags = [Lag("price_lag_1h", PRICE, 12), Lag("price_lag_1d", PRICE, 288)]
    return ordered_features(d5, lags=lags, rolls=rolls).select(SERIES, TS, PRICE, *_L_COLS)


# ------------------------------------------------ steps other than 5 minutes and an hour

_STEP_SECONDS = {"2h": 7200, "40min": 2400, "daily": 86400}


def _dense_d_sql(name: str, seconds: int) -> str:
    return f"""
{name}_g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL {seconds} SECOND)) AS ts FROM d GROUP BY series_id),
{name}_0 AS (SELECT g.series_id, g.ts, d.price FROM {name}_g g LEFT JOIN d ON g.series_id = d.series_id AND g.ts = d.ts),""" + S.fill_cte(f"{name}_f", f"{name}_0", ["price"]) + f""",
{name} AS (SELECT series_id, ts, price, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS idx FROM {name}_f)"""


def _whole_lags(seconds: int) -> dict[str, int]:
    spans = {f"{h}h": h * 3600 for h in fe.LAG_HOURS} | {f"{d}d": d * 86400 for d in fe.LAG_DAYS}
    return {f"price_lag_{n}": s // seconds for n, s in spans.items() if s % seconds == 0}


def _steps_lag_sql() -> str:
    def one(name: str, seconds: int) -> str:
        have = _whole_lags(seconds)
        cols = [f"lag(price, {have[c]}) OVER (PARTITION BY series_id ORDER BY idx) AS {c}" if c in have else f"CAST(NULL AS DOUBLE) AS {c}" for c in _LAG_NAMES]
        return f"SELECT '{name}' AS fixture, series_id, ts, price, {', '.join(cols)} FROM s_{name}"

    return S.with_(S.D + "," + ",".join(_dense_d_sql(f"s_{n}", k) for n, k in _STEP_SECONDS.items())) + " UNION ALL ".join(one(n, k) for n, k in _STEP_SECONDS.items())


@register("lag_features_steps", _steps_lag_sql(), doubles=("price", *_LAG_NAMES))
def q_lag_features_steps(spark, sf_dir):
    """Lags of 2-hour, 40-minute and daily series; a lag that is no whole number of steps is left out (NULL here)."""
    out = None
    for name, seconds in _STEP_SECONDS.items():
        df = fe.lag_features(resample_interpolate(fx.fixture_d(spark, sf_dir), seconds).select(SERIES, TS, IDX, PRICE), seconds)
        df = df.select(F.lit(name).alias("fixture"), SERIES, TS, PRICE, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in _LAG_NAMES])
        out = df if out is None else out.unionByName(df)
    return out


@register(
    "decompose_daily",
    S.with_(S.D + "," + _dense_d_sql("s_daily", 86400), S.decompose_cte("dec", "s_daily", 7)) + "SELECT series_id, ts, price, trend, seasonal, residual FROM dec",
    doubles=("price", "trend", "seasonal", "residual"),
    digits=4,
)
def q_decompose_daily(spark, sf_dir):
    """A daily series: the odd period of seven rows."""
    return decompose(resample_interpolate(fx.fixture_d(spark, sf_dir), 86400), 86400).select(SERIES, TS, PRICE, "trend", "seasonal", "residual")


@register(
    "decompose_5min",
    S.with_(S.M5 + "," + S.fill_cte("m5f0", "m5", ["price"]) + """,
m5f AS (SELECT series_id, ts, price, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS BIGINT) AS idx FROM m5f0)""", S.decompose_cte("dec", "m5f", 2016))
    + "SELECT series_id, ts, price, trend, seasonal, residual FROM dec",
    doubles=("price", "trend", "seasonal", "residual"),
)
def q_decompose_5min(spark, sf_dir):
    """A 5-minute series: the long period of 2,016 rows (running sums)."""
    m5 = fill_time_linear(fx.fixture_m5(spark, sf_dir))
    return decompose(m5.select(SERIES, TS, IDX, PRICE), 300).select(SERIES, TS, PRICE, "trend", "seasonal", "residual")


# ------------------------------------------------ series of several steps in one plan

_MIXED_SECONDS = {"2h": 7200, "daily": 86400, "2d": 172800}


def _mixed_sql() -> str:
    spans = {f"price_lag_{h}h": h * 3600 for h in fe.LAG_HOURS} | {f"price_lag_{d}d": d * 86400 for d in fe.LAG_DAYS}
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

    def one(name: str, seconds: int) -> tuple[str, str]:
        owed, cols = [], []
        for c, span in spans.items():
            cols.append(f"max(price) OVER (o RANGE BETWEEN INTERVAL {span} SECOND PRECEDING AND INTERVAL {span} SECOND PRECEDING) AS {c}")
            owed += [c] if span % seconds == 0 else []
        for d in fe.ROLL_DAYS:
            for stat, f in fn.items():
                c = f"price_rolling_{stat}_{d}d"
                frame = f"{f}(price) OVER (o RANGE BETWEEN INTERVAL {d * 86400 - 1} SECOND PRECEDING AND CURRENT ROW) AS {c}"
                cols.append(frame if d * 86400 % seconds == 0 else f"CAST(NULL AS DOUBLE) AS {c}")
                owed += [c] if d * 86400 % seconds == 0 and (stat != "std" or seconds < d * 86400) else []
        period = 7 * 86400 // seconds if 7 * 86400 % seconds == 0 else 0
        dec = S.decompose_cte(f"dec_{name}", f"s_{name}", period) + "," if period else ""
        shares = S.decomp_features_sql(f"dec_{name}") if period else ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in S.DECOMP_NAMES)
        join = f"LEFT JOIN dec_{name} ON e.series_id = dec_{name}.series_id AND e.idx = dec_{name}.idx" if period else ""
        ctes = f"""{dec}
e0_{name} AS (SELECT series_id, ts, idx, price, {", ".join(cols)}, {S.temporal_sql()} FROM s_{name} WINDOW o AS (PARTITION BY series_id ORDER BY ts)),
e_{name} AS (SELECT *, {S.ranges_sql()} FROM e0_{name} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ["price", *owed])})"""
        rows = f"""SELECT '{name}/' || e.series_id AS series_id, e.ts, e.price, {", ".join("e." + c for c in _LAG_NAMES + _ROLL_NAMES + S.CAL_DBL + S.CAL_INT)},
  {shares} FROM e_{name} e {join}"""
        return ctes, rows

    parts = [one(n, k) for n, k in _MIXED_SECONDS.items()]
    grids = [_dense_d_sql(f"s_{n}", _MIXED_SECONDS[n]) for n in ("2h", "daily")]
    grids.append("s_2d AS (SELECT series_id, ts, price, idx // 2 AS idx FROM s_daily WHERE idx % 2 = 0)")
    return S.with_(S.D, *grids, *[c for c, _ in parts]) + " UNION ALL ".join(r for _, r in parts)


def mixed_steps(spark, sf_dir):
    """D on grids of two hours and of a day, and every second day of the latter, as one relation of 15 series."""
    named = lambda name, df: df.select(F.concat(F.lit(f"{name}/"), SERIES).alias(SERIES), TS, IDX, PRICE)
    fine, daily = (resample_interpolate(fx.fixture_d(spark, sf_dir), _MIXED_SECONDS[n]) for n in ("2h", "daily"))
    daily = materialize(daily)
    other = daily.filter(F.col(IDX) % 2 == 0).withColumn(IDX, F.expr(f"{IDX} div 2"))
    return named("2h", fine).unionByName(named("daily", daily)).unionByName(named("2d", other))


@register("engineer_features_steps", _mixed_sql(), doubles=("price", *_FEAT_NAMES), digits=2, fine=_SMALL)
def q_engineer_features_steps(spark, sf_dir):
    """The whole feature composition over series of three steps: one plan, frames over time."""
    feats, _ = fe.engineer_features(mixed_steps(spark, sf_dir), None)
    return feats.select(SERIES, TS, PRICE, *_LAG_NAMES, *_ROLL_NAMES, *S.CAL_DBL, *S.CAL_INT, *fe.DECOMP_COLS)
