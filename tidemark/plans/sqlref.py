"""Independent SQL statements of the fixtures and operators, for the DuckDB oracle.

These are plain whole-series window SQL - the textbook definition each Spark
operator must reproduce - written against the driver's tables.  They are
used only to check results, never to compute them.
"""

from __future__ import annotations

DRIVER_COLS = ["temperature", "wind_speed", "solar_irradiance", "precipitation", "load"]


def grid_cte(name: str, src: str, step: str, cols: list[str]) -> str:
    """Dense grid min..max per series, left-joined with ``src`` (which has series_id, ts, cols)."""
    sel = ", ".join(f"b.{c}" for c in cols)
    return f"""
{name}_g AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {src} GROUP BY series_id),
{name} AS (SELECT g.series_id, g.ts, {sel},
    CAST(row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS BIGINT) AS idx
  FROM {name}_g g LEFT JOIN {src} b ON g.series_id = b.series_id AND g.ts = b.ts)"""


def fill_cte(name: str, src: str, cols: list[str], keys: str = "series_id") -> str:
    """Time-linear fill, then forward, then backward, per column (pandas interpolate(method='time'))."""
    inner = []
    outer = []
    for c in cols:
        inner.append(
            f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER wp AS _pt_{c}, "
            f"last_value({c} IGNORE NULLS) OVER wp AS _pv_{c}, "
            f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER wn AS _nt_{c}, "
            f"first_value({c} IGNORE NULLS) OVER wn AS _nv_{c}"
        )
        outer.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN _pt_{c} IS NULL THEN _nv_{c} WHEN _nt_{c} IS NULL THEN _pv_{c} "
            f"WHEN _nt_{c} = _pt_{c} THEN _pv_{c} "
            f"ELSE (_nv_{c} - _pv_{c}) / CAST(_nt_{c} - _pt_{c} AS DOUBLE) * CAST(epoch_us(ts) - _pt_{c} AS DOUBLE) + _pv_{c} END AS {c}"
        )
    drop = ", ".join(f"_pt_{c}, _pv_{c}, _nt_{c}, _nv_{c}" for c in cols)
    return f"""
{name}_w AS (SELECT *, {', '.join(inner)} FROM {src}
  WINDOW wp AS (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wn AS (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(outer)}) FROM {name}_w)"""


H = (
    """h_b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price FROM events GROUP BY ALL),"""
    + grid_cte("h", "h_b", "1 HOUR", ["price"])
)
HF = H + "," + fill_cte("hf", "h", ["price"])
HX = (
    """hx_b AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price,
  CAST(count(*) AS DOUBLE) AS load, avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS temperature
  FROM events GROUP BY ALL),"""
    + grid_cte("hx", "hx_b", "1 HOUR", ["price", "load", "temperature"])
)
HXF = HX + "," + fill_cte("hxf", "hx", ["price", "load", "temperature"])
D = """d AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, sum(o_totalprice) AS price
  FROM orders GROUP BY ALL)"""
M5 = (
    """m5_b AS (SELECT 'all' AS series_id, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, avg(value) AS price FROM events GROUP BY ALL),"""
    + grid_cte("m5", "m5_b", "5 MINUTE", ["price"])
)
U = (
    """u_b AS (SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS price FROM events GROUP BY ALL),"""
    + grid_cte("u", "u_b", "1 HOUR", ["price"])
)

BURSTY = """bursty AS (SELECT event_id, event_type AS series_id,
  CASE WHEN event_id = min(event_id) OVER (PARTITION BY event_type) THEN TIMESTAMP '2000-01-01' ELSE CAST(ts AS TIMESTAMP) END AS ts,
  CASE WHEN event_id % 3 <> 0 THEN value END AS price FROM events)"""

# F: forecast table over filled H (history: lag-24 prediction, bands by stddev_pop;
# future: last 24 hours a day on, actual NULL, bands 10 % of the prediction).
F = (
    HF
    + """,
f_l AS (SELECT series_id, ts, idx, price AS actual,
  lag(price, 24) OVER (PARTITION BY series_id ORDER BY idx) AS predicted FROM hf),
f_h0 AS (SELECT * FROM f_l WHERE predicted IS NOT NULL),
f_sd AS (SELECT series_id, stddev_pop(actual - predicted) AS sd FROM f_h0 GROUP BY series_id),
f_h AS (SELECT a.series_id, a.ts, a.actual, a.predicted, a.predicted - 1.96 * s.sd AS lower,
  a.predicted + 1.96 * s.sd AS upper FROM f_h0 a JOIN f_sd s USING (series_id)),
f_f AS (SELECT series_id, ts + INTERVAL 1 DAY AS ts, CAST(NULL AS DOUBLE) AS actual, price AS predicted,
  price - 1.96 * 0.1 * abs(price) AS lower, price + 1.96 * 0.1 * abs(price) AS upper
  FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS _last FROM hf) WHERE idx > _last - 24),
f AS (SELECT * FROM f_h UNION ALL SELECT * FROM f_f)"""
)

RAW = """raw AS (SELECT event_id, event_type AS series_id,
  CASE WHEN event_type IN ('click', 'view') THEN strftime(ts, '%-m/%-d/%y %-H:%M') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "timestamp",
  CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END AS price FROM events)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


# ---------------------------------------------------------------- feature SQL

TWO_PI = "6.283185307179586::DOUBLE"
CAL_INT = ["hour", "day", "day_of_week", "month", "quarter", "year", "is_weekend", "is_business_hour"]
CAL_DBL = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]


def temporal_sql(ts: str = "ts") -> str:
    hour = f"CAST(hour({ts}) AS BIGINT)"
    dow = f"CAST(isodow({ts}) - 1 AS BIGINT)"
    month = f"CAST(month({ts}) AS BIGINT)"
    wk = f"({dow} IN (5, 6))"
    return ", ".join(
        [
            f"{hour} AS hour",
            f"CAST(day({ts}) AS BIGINT) AS day",
            f"{dow} AS day_of_week",
            f"{month} AS month",
            f"CAST(quarter({ts}) AS BIGINT) AS quarter",
            f"CAST(year({ts}) AS BIGINT) AS year",
            f"sin({TWO_PI} * {hour} / 24) AS hour_sin",
            f"cos({TWO_PI} * {hour} / 24) AS hour_cos",
            f"sin({TWO_PI} * {dow} / 7) AS day_of_week_sin",
            f"cos({TWO_PI} * {dow} / 7) AS day_of_week_cos",
            f"sin({TWO_PI} * {month} / 12) AS month_sin",
            f"cos({TWO_PI} * {month} / 12) AS month_cos",
            f"CAST({wk} AS BIGINT) AS is_weekend",
            f"CAST(({hour} BETWEEN 8 AND 18) AND NOT {wk} AS BIGINT) AS is_business_hour",
        ]
    )


def lag_list(per_hour: int, per_day: int, col: str = "price") -> list[tuple[str, int]]:
    out = [(f"{col}_lag_{h}h", h * per_hour) for h in (1, 3, 6, 12, 24) if h * per_hour >= 1]
    out += [(f"{col}_lag_{d}d", d * per_day) for d in (7, 14, 30)]
    return out


def lags_sql(lags: list[tuple[str, int]], col: str = "price", part: str = "series_id") -> str:
    return ", ".join(f"lag({col}, {k}) OVER (PARTITION BY {part} ORDER BY idx) AS {name}" for name, k in lags)


def roll_sql(col: str, k: int, names: dict, part: str = "series_id") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return ", ".join(f"{fn[s]}({col}) {w} AS {n}" for s, n in names.items())


def rolling_list(per_day: int, col: str = "price") -> list[tuple[int, dict]]:
    return [
        (d * per_day, {s: f"{col}_rolling_{s}_{d}d" for s in ("mean", "std", "min", "max")}) for d in (1, 7, 30)
    ]


def rolls_sql(per_day: int, col: str = "price", part: str = "series_id") -> str:
    return ", ".join(roll_sql(col, k, names, part) for k, names in rolling_list(per_day, col))


def ranges_sql(col: str = "price") -> str:
    return ", ".join(
        f"{col}_rolling_max_{d}d - {col}_rolling_min_{d}d AS {col}_rolling_range_{d}d" for d in (1, 7, 30)
    )


def rolling_names(col: str = "price") -> list[str]:
    return [f"{col}_rolling_{s}_{d}d" for d in (1, 7, 30) for s in ("mean", "std", "min", "max")] + [
        f"{col}_rolling_range_{d}d" for d in (1, 7, 30)
    ]


def decompose_cte(name: str, src: str, p: int, col: str = "price") -> str:
    h = p // 2
    middle = f"sum({col}) OVER wc - 0.5 * (lag({col}, {h}) OVER w0 + lead({col}, {h}) OVER w0)" if p % 2 == 0 else f"sum({col}) OVER wc"
    return f"""
{name}_n AS (SELECT series_id, ts, idx, {col}, count(*) OVER (PARTITION BY series_id) AS n FROM {src}),
{name}_m AS (SELECT *, CASE WHEN idx >= {h} AND idx < n - {h} THEN
    ({middle}) / {p} END AS tmid
  FROM {name}_n WHERE n >= {2 * p}
  WINDOW wc AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING),
         w0 AS (PARTITION BY series_id ORDER BY idx)),
{name}_l AS (SELECT series_id,
  regr_slope(tmid, idx) FILTER (WHERE idx >= {h} AND idx < least({h + p}, n - {h} - 1)) AS bl,
  regr_intercept(tmid, idx) FILTER (WHERE idx >= {h} AND idx < least({h + p}, n - {h} - 1)) AS al,
  regr_slope(tmid, idx) FILTER (WHERE idx >= greatest({h}, n - {h} - 1 - {p}) AND idx < n - {h} - 1) AS br,
  regr_intercept(tmid, idx) FILTER (WHERE idx >= greatest({h}, n - {h} - 1 - {p}) AND idx < n - {h} - 1) AS ar
  FROM {name}_m GROUP BY series_id),
{name}_t AS (SELECT m.*, CASE WHEN tmid IS NOT NULL THEN tmid WHEN idx < {h} THEN al + bl * idx ELSE ar + br * idx END AS trend
  FROM {name}_m m JOIN {name}_l USING (series_id)),
{name}_p AS (SELECT series_id, idx % {p} AS ph, avg({col} - trend) AS pm FROM {name}_t GROUP BY ALL),
{name}_s AS (SELECT series_id, ph, pm - avg(pm) OVER (PARTITION BY series_id) AS seasonal FROM {name}_p),
{name} AS (SELECT t.series_id, t.ts, t.idx, t.{col}, t.trend, s.seasonal, t.{col} - t.trend - s.seasonal AS residual
  FROM {name}_t t JOIN {name}_s s ON t.series_id = s.series_id AND t.idx % {p} = s.ph)"""


def decomp_features_sql(dec: str) -> str:
    return (
        f"{dec}.trend, {dec}.seasonal, {dec}.residual, "
        + ", ".join(
            f"coalesce(CASE WHEN {dec}.price = 0 THEN NULL ELSE {dec}.{c} / {dec}.price END, 0) AS {c}_pct"
            for c in ("trend", "seasonal", "residual")
        )
    )


DECOMP_NAMES = ["trend", "seasonal", "residual", "trend_pct", "seasonal_pct", "residual_pct"]
