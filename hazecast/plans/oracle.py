"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Views ``events orders lineitem ...`` are pre-registered by the checker.  The
stand-in observation panel of ``sources.tables`` is spelled out once here as
CTE text and reused.
"""

from __future__ import annotations

import re

from hazecast.plans import oracle_features as FT
from hazecast.plans.oracle_features import HORIZONS

# ---------------------------------------------------------------------------
# shared CTEs
# ---------------------------------------------------------------------------

K_EXPR = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

#: A station holds 150 users.
STATION = "'st' || (user_id // 150)"

AIR = f"""
air AS (
  SELECT {STATION} AS series_id, date_trunc('hour', ts) AS ts,
         avg(CASE WHEN event_type = 'click' THEN value END) AS PM25,
         avg(CASE WHEN event_type = 'view' THEN value END) AS PM10,
         avg(CASE WHEN event_type = 'purchase' THEN value END) AS NO2,
         avg(CASE WHEN event_type = 'signup' THEN value END) AS O3,
         avg(CASE WHEN event_type = 'error' THEN value END) * 10.0 AS CO,
         avg(value) AS SO2
  FROM events GROUP BY 1, 2)"""

WEATHER = f"""
weather AS (
  SELECT {STATION} AS series_id, date_trunc('hour', ts) AS ts,
         avg({K_EXPR}) / 4.0 AS Temperature,
         sum(CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END) * 100.0 / count(*) AS Relative_Humidity,
         1000.0 + count(*) AS Pressure,
         (max(value) - min(value)) / 20.0 AS Wind_Speed,
         avg({K_EXPR}) * 3.6 AS Wind_Direction,
         sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 100.0 / count(*) AS Clouds,
         greatest(max(value) - 150.0, 0.0) / 20.0 AS Precipitation,
         avg(CASE WHEN event_type = 'signup' THEN value END) * 10.0 AS BLH
  FROM events GROUP BY 1, 2)"""


def r1(x: str, d: int = 1) -> str:
    """round half away from zero on the scaled double (matches numeric.round_dp)."""
    s = float(10 ** d)
    return f"(round(({x}) * {s}) / {s})"


def _seg(x: str, table, above: int, below: int = 0) -> str:
    parts = [f"CASE WHEN {x} IS NULL THEN NULL"]
    for lo, hi, ilo, ihi in table:
        parts.append(
            f" WHEN {x} >= {lo} AND {x} <= {hi} THEN CAST(round_even("
            f"({float(ihi - ilo)} / {float(hi - lo)}) * ({x} - {float(lo)}) + {float(ilo)}, 0) AS INTEGER)")
    parts.append(f" WHEN {x} > {table[-1][1]} THEN {above} ELSE {below} END")
    return "".join(parts)


# Low and high concentration, low and high index of each segment.
AQI_SEGMENTS = {
    "PM25": [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300),
             (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)],
    "PM10": [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300),
             (425, 504, 301, 400), (505, 604, 401, 500)],
    "O3": [(0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150), (86, 105, 151, 200), (106, 200, 201, 300)],
    "NO2": [(0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150), (361, 649, 151, 200), (650, 1249, 201, 300),
            (1250, 1649, 301, 400), (1650, 2049, 401, 500)],
    "CO": [(0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300),
           (30.5, 40.4, 301, 400), (40.5, 50.4, 401, 500)],
    "SO2": [(0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150), (186, 304, 151, 200), (305, 604, 201, 300),
            (605, 804, 301, 400), (805, 1004, 401, 500)],
}
SIMPLE_SEGMENTS = [*AQI_SEGMENTS["PM25"][:5], (250.5, 500.4, 301, 500)]
DIVISOR = {"O3": 1.9957, "NO2": 1.8816, "CO": 1145.0, "SO2": 2.6196}
SLOT_OFFSETS = [(d - 1, 24 * d + h) for d in (1, 2) for h in range(0, 24, 3)]


def sub_index_sql(col: str, pollutant: str) -> str:
    x = f"(CASE WHEN isnan({col}) THEN NULL ELSE CAST({col} AS DOUBLE) END)"
    if pollutant == "PM25":
        x = f"(round_even({x} * 10.0, 0) / 10.0)"
    elif pollutant == "PM10":
        x = f"trunc({x})"
    else:
        x = f"({x} / {DIVISOR[pollutant]})"
    return _seg(x, AQI_SEGMENTS[pollutant], 300 if pollutant == "O3" else 500)


def _overall_cte() -> str:
    subs = ",\n         ".join(
        f"{sub_index_sql(p, p)} AS s_{p}" for p in ["PM25", "PM10", "O3", "NO2", "CO", "SO2"])
    return f"""
subs AS (
  SELECT w.*, a.PM25, a.PM10, a.NO2, a.O3, a.CO, a.SO2,
         {subs}
  FROM weather w JOIN air a USING (series_id, ts)),
obs AS (
  SELECT series_id, ts,
         greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) AS AQI,
         CASE WHEN s_PM25 = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'PM2.5'
              WHEN s_PM10 = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'PM10'
              WHEN s_O3 = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'O3'
              WHEN s_NO2 = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'NO2'
              WHEN s_CO = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'CO'
              WHEN s_SO2 = greatest(s_PM25, s_PM10, s_O3, s_NO2, s_CO, s_SO2) THEN 'SO2' END
           AS AQI_Pollutant,
         CO, NO2, O3, PM10, PM25, SO2, Clouds, Precipitation, Pressure,
         Relative_Humidity, Temperature, Wind_Speed, Wind_Direction, BLH
  FROM subs)"""


OBS = "WITH " + AIR + "," + WEATHER + "," + _overall_cte()

ROLL_FIELDS = ["AQI", "PM25", "PM10", "NO2", "O3", "CO", "SO2"]


def exact_mean(x: str, d: int = 1) -> str:
    """Mean of the values' decimal texts, half away from zero, by integers in
    units of 1e-18."""
    s = f"CAST(replace(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18))) AS VARCHAR), '.', '') AS HUGEINT)"
    n = f"count({x})"
    u = f"CAST({10 ** (18 - d)} AS HUGEINT)"
    return (f"(CASE WHEN {n} > 0 THEN CAST(sign({s}) * ((2 * abs({s}) + {n} * {u}) // (2 * {n} * {u})) AS DOUBLE)"
            f" / CAST({float(10 ** d)} AS DOUBLE) END)")


def _roll(keys: str, group: str) -> str:
    aggs = ", ".join(f"{exact_mean(f)} AS {f}" for f in ROLL_FIELDS)
    anyv = "count(coalesce(" + ", ".join(ROLL_FIELDS) + "))"
    return (f"{OBS}\nSELECT {keys}, {aggs} FROM obs WHERE CAST(ts AS DATE) >= DATE '2000-01-01' "
            f"GROUP BY {group} HAVING {anyv} > 0")


SQL: dict[str, str] = {}

SQL["daily_rollup"] = _roll("series_id, strftime(ts, '%Y-%m-%d') AS date", "1, 2")
SQL["hourly_rollup"] = _roll("series_id, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour",
                             "1, 2, 3")


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------

def r4(x: str) -> str:
    """Snap to the 2^-20 grid (matches numeric.snap)."""
    return f"(round(({x}) * 1048576.0) / 1048576.0)"


LONG = "long AS (SELECT event_type AS series_id, ts, event_id, value AS PM25 FROM events)"
LONG_ORDER = "ts, event_id"

HOURLY_LONG = """hourly_long AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def _calendar_sql() -> dict:
    pi = 3.14159265             # as the training features write it
    c24, c12, c180 = repr(2 * pi / 24), repr(2 * pi / 12), repr(pi / 180.0)
    h, m = "CAST(hour(ts) AS INTEGER)", "CAST(month(ts) AS INTEGER)"
    return {
        "hour": h, "month": m,
        "is_rainy_season": f"CAST({m} BETWEEN 5 AND 10 AS INTEGER)",
        "is_burn_season": f"CAST({m} IN (4, 5, 6, 10, 11, 12) AS INTEGER)",
        "is_april": f"CAST({m} = 4 AS INTEGER)",
        "is_rush_hour": f"CAST({h} IN (7, 8, 9, 17, 18, 19) AS INTEGER)",
        "is_night": f"CAST({h} >= 22 OR {h} <= 5 AS INTEGER)",
        "is_weekend": "CAST(dayofweek(ts) IN (0, 6) AS INTEGER)",
        "hour_sin": f"sin({h} * {c24})", "hour_cos": f"cos({h} * {c24})",
        "month_sin": f"sin({m} * {c12})", "month_cos": f"cos({m} * {c12})",
        "days_since_start": "CAST(datediff('day', DATE '2022-08-11', CAST(ts AS DATE)) AS DOUBLE)",
        "wind_dir_sin": f"sin(Wind_Direction * {c180})",
        "wind_dir_cos": f"cos(Wind_Direction * {c180})",
    }


IMPUTE = """
med AS (SELECT series_id, hour(ts) AS h, month(ts) AS m, quantile_disc(BLH, 0.5) AS seasonal_med
        FROM base WHERE BLH IS NOT NULL GROUP BY 1, 2, 3),
gmed AS (SELECT series_id, quantile_disc(BLH, 0.5) AS series_med
         FROM base WHERE BLH IS NOT NULL GROUP BY 1),
imp AS (SELECT b.* REPLACE (coalesce(b.BLH, med.seasonal_med, gmed.series_med) AS BLH)
        FROM base b LEFT JOIN med ON b.series_id = med.series_id AND hour(b.ts) = med.h
                                  AND month(b.ts) = med.m
                    LEFT JOIN gmed ON b.series_id = gmed.series_id)"""


def feature_sql(names, wide: bool, horizons=(), out_cols=None, int_cols=()) -> str:
    """Features of the catalogue by their written-out formulas."""
    order = "ts" if wide else LONG_ORDER
    if wide:
        head = OBS + ",\nbase AS (SELECT * FROM obs WHERE PM25 IS NOT NULL AND NOT isnan(PM25))," + IMPUTE
        src = "imp"
    else:
        head = "WITH " + LONG + ",\nbase AS (SELECT * FROM long WHERE PM25 IS NOT NULL AND NOT isnan(PM25))"
        src = "base"
    cal = _calendar_sql()
    l0 = ["PM25 AS pm25_current"] + [f"{v} AS {k}" for k, v in cal.items()
                                     if wide or not k.startswith("wind_dir")]
    formulas = FT.formulas(order)
    l1 = [f"{formulas[n]} AS {n}" for n in names if n in formulas]
    over = f"OVER (PARTITION BY series_id ORDER BY {order})"
    for k in horizons:
        l1.append(f"lead(PM25, {k}) {over} AS label_raw__k{k}")
        l1.append(f"ln(1 + lead(PM25, {k}) {over}) AS label__k{k}")
        l1.append(f"lag(PM25, {k}) {over} AS pm25_lagK__k{k}")
        for c in FT.WEATHER_LEAD:
            l1.append(f"lead({c}, {k}) {over} AS {c}_atK__k{k}")
    sql = head + f",\nl0 AS (SELECT *, {', '.join(l0)} FROM {src})"
    sql += f",\nl1 AS (SELECT *{', ' if l1 else ''}{', '.join(l1)} FROM l0)"
    sql += ",\nl2 AS (SELECT * FROM l1)\n"
    if out_cols is not None:
        sql += f"SELECT {out_cols} FROM l2"
    else:
        keys = "series_id, ts" + ("" if wide else ", event_id")
        sel = [n if n in int_cols else f"{r4(n)} AS {n}" for n in names]
        sql += f"SELECT {keys}, {', '.join(sel)} FROM l2"
    return sql


INT_FEATURES = {"is_spike", "rain_washout", "hour", "month", "is_rainy_season", "is_burn_season",
                "is_april", "is_rush_hour", "is_night", "is_weekend"}


def _feat(names, wide):
    return feature_sql(names, wide, int_cols=INT_FEATURES)


# ---------------------------------------------------------------------------
# rollups
# ---------------------------------------------------------------------------

SQL["daily_rollup"] = _roll("series_id, strftime(ts, '%Y-%m-%d') AS date", "1, 2")

SQL["hourly_rollup"] = f"""WITH {LONG}
SELECT series_id, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour,
       {exact_mean('PM25')} AS PM25
FROM long WHERE CAST(ts AS DATE) >= DATE '2000-01-01' GROUP BY 1, 2, 3 HAVING count(PM25) > 0"""

SQL["last_n_days"] = f"""WITH {LONG},
d AS (SELECT series_id, strftime(ts, '%Y-%m-%d') AS date, {exact_mean('PM25')} AS PM25
      FROM long WHERE CAST(ts AS DATE) >= DATE '2000-01-01' GROUP BY 1, 2 HAVING count(PM25) > 0)
SELECT series_id, date, PM25 FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS rn FROM d) WHERE rn <= 7"""


def _orders_aqi() -> str:
    return ("oa AS (SELECT o_orderpriority AS series_id, o_orderdate AS ts, "
            f"{sub_index_sql('(o_totalprice / 1000.0)', 'PM25')} AS AQI FROM orders)")


SQL["monthly_yearly_rollup"] = f"""WITH {_orders_aqi()},
m AS (SELECT series_id, strftime(ts, '%Y-%m') AS month, avg(AQI) AS mean, max(AQI) AS mx
      FROM oa WHERE AQI IS NOT NULL GROUP BY 1, 2)
SELECT series_id, 'year' AS grain, strftime(ts, '%Y') AS period, {r1('avg(AQI)')} AS avg,
       max(AQI) AS max, min(AQI) AS min
FROM oa WHERE AQI IS NOT NULL GROUP BY 1, 2, 3
UNION ALL
SELECT series_id, 'month', month, {r1('mean')}, mx, CAST(NULL AS INTEGER) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS rn FROM m) WHERE rn <= 24"""

SQL["best_worst_month"] = f"""WITH {_orders_aqi()},
m AS (SELECT series_id, strftime(ts, '%Y-%m') AS month, avg(AQI) AS mean
      FROM oa WHERE AQI IS NOT NULL GROUP BY 1, 2),
b AS (SELECT series_id, month, mean, row_number() OVER (PARTITION BY series_id ORDER BY mean, month) AS rb,
             row_number() OVER (PARTITION BY series_id ORDER BY mean DESC, month) AS rw FROM m)
SELECT x.series_id, x.month AS best_month, {r1('x.mean')} AS best_avg,
       y.month AS worst_month, {r1('y.mean')} AS worst_avg
FROM b x JOIN b y ON x.series_id = y.series_id AND x.rb = 1 AND y.rw = 1"""

SQL["coverage"] = """SELECT event_type AS series_id, min(ts) AS first_ts, max(ts) AS last_ts,
       count(*) AS n_rows FROM events GROUP BY 1"""

# ---------------------------------------------------------------------------
# AQI family
# ---------------------------------------------------------------------------

SQL["aqi_subindices"] = OBS + "\nSELECT series_id, ts, " + ", ".join(
    f"{sub_index_sql(p, p)} AS aqi_{p.lower()}" for p in ["PM25", "PM10", "O3", "NO2", "CO", "SO2"]
) + " FROM obs"

SQL["aqi_overall"] = OBS + "\nSELECT series_id, ts, AQI, AQI_Pollutant FROM obs"


def _simple_sql(x: str, rounded: bool) -> str:
    c = f"(CASE WHEN isnan({x}) THEN NULL ELSE CAST({x} AS DOUBLE) END)"
    if rounded:
        c = f"(round_even(greatest({c}, 0.0) * 10.0, 0) / 10.0)"
    return _seg(c, SIMPLE_SEGMENTS, 500, below=500)


SQL["aqi_simple"] = (f"SELECT event_id, {_simple_sql('value', True)} AS aqi_simple, "
                     f"{_simple_sql('value', False)} AS aqi_strict, "
                     f"{sub_index_sql('value', 'PM25')} AS aqi_six FROM events")


def _band_sql(x: str, bands, pick) -> str:
    parts = ["CASE"]
    for b in bands:
        if b[0] is None:
            parts.append(f" ELSE {pick(b)}")
        else:
            parts.append(f" WHEN {x} <= {b[0]} THEN {pick(b)}")
    return "".join(parts) + " END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _category_sql() -> str:
    from hazecast.functions import aqi as A
    cb = A.CATEGORY_BANDS[:-1] + [(None,) + A.CATEGORY_BANDS[-1][1:]]
    dl = [(u, lab) for (u, _), (_, lab, _, _) in zip(A.DASHBOARD_COLORS, A.CATEGORY_BANDS)]
    tips = [(u, " | ".join(t)) for u, t in A.HEALTH_TIPS]
    breaks = [0, 50, 100, 150, 200, 300, 500]
    n = len(breaks) - 1
    v = "least(greatest(CAST(AQI AS DOUBLE), 0.0), 500.0)"
    g = ["CASE"]
    for i in range(n):
        lo, hi = breaks[i], breaks[i + 1]
        g.append(f" WHEN {v} <= {float(hi)} THEN ({float(i)} + ({v} - {float(lo)}) / {float(hi - lo)})"
                 f" / {float(n)} * 100.0")
    g.append(" ELSE 100.0 END")
    gauge = "".join(g)

    def nn(e):
        return f"CASE WHEN AQI IS NULL THEN NULL ELSE {e} END"
    return (OBS + "\nSELECT series_id, ts, AQI, "
            f"{nn(_band_sql('AQI', cb, lambda b: _q(b[1])))} AS label, "
            f"{nn(_band_sql('AQI', cb, lambda b: _q(b[2])))} AS css_class, "
            f"{nn(_band_sql('AQI', cb, lambda b: _q(b[3])))} AS color, "
            f"{nn(_band_sql('AQI', A.DASHBOARD_COLORS, lambda b: _q(b[1])))} AS dash_color, "
            f"{nn(_band_sql('AQI', dl, lambda b: _q(b[1])))} AS dash_label, "
            f"{nn(_band_sql('AQI', A.ADVICE, lambda b: _q(b[1])))} AS advice, "
            f"{nn(_band_sql('AQI', tips, lambda b: _q(b[1])))} AS tips, "
            f"{nn(r4(gauge))} AS gauge_pct FROM obs")


SQL["aqi_category"] = _category_sql()

# ---------------------------------------------------------------------------
# cleaning
# ---------------------------------------------------------------------------

SQL["seasonal_impute"] = OBS + """,
base AS (SELECT series_id, ts, BLH FROM obs),""" + IMPUTE + f"""
SELECT series_id, ts, {r4('BLH')} AS BLH, BLH_was_null FROM (
  SELECT i.*, b.BLH IS NULL AS BLH_was_null FROM imp i JOIN base b USING (series_id, ts))"""

SQL["global_median_fallback"] = """SELECT event_type AS series_id, quantile_disc(value, 0.5) AS series_med
FROM events WHERE value IS NOT NULL GROUP BY 1"""

SQL["merge_inner"] = ("WITH " + AIR + "," + WEATHER + "\nSELECT series_id, ts, "
                      + ", ".join(f"{r4(c)} AS {c}" for c in
                                  ["Temperature", "Relative_Humidity", "Pressure", "Wind_Speed",
                                   "Wind_Direction", "Clouds", "Precipitation", "BLH",
                                   "PM25", "PM10", "NO2", "O3", "CO", "SO2"])
                      + " FROM weather JOIN air USING (series_id, ts)")

_UPSERT_SRC = f"""WITH {HOURLY_LONG},
hist AS (SELECT series_id, ts, value, 'history' AS src FROM hourly_long WHERE ts < TIMESTAMP '2024-01-20'),
delta AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
                 arg_max(value, (ts, event_id)) AS value, 'delta' AS src
          FROM events WHERE ts >= TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-30 12:34:56'
          GROUP BY 1, 2),
u AS (SELECT *, 0 AS prio FROM hist UNION ALL SELECT *, 1 AS prio FROM delta)"""

SQL["upsert_keep_last"] = _UPSERT_SRC + f"""
SELECT series_id, ts, {r4('value')} AS value, src FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY prio DESC) AS rn FROM u) WHERE rn = 1"""

SQL["dedupe_keep_first"] = _UPSERT_SRC + f"""
SELECT series_id, ts, {r4('value')} AS value, src FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY prio) AS rn FROM u) WHERE rn = 1"""

SQL["union_series"] = f"""WITH {HOURLY_LONG}, {_orders_aqi()},
u AS (SELECT series_id, ts, value, n, CAST(NULL AS INTEGER) AS AQI FROM hourly_long
      UNION ALL SELECT 'orders:' || series_id, ts, NULL, NULL, AQI FROM oa)
SELECT series_id, count(*) AS n_rows, count(value) AS n_value, count(AQI) AS n_aqi,
       sum(n) AS n_events, {r4('avg(value)')} AS mean_value, {r4('avg(AQI)')} AS mean_aqi
FROM u GROUP BY 1"""

SQL["null_report"] = OBS + "\nSELECT series_id, count(*) AS n_rows, " + ", ".join(
    f"count_if({c} IS NULL) AS null_{c}" for c in ["AQI", "PM25", "PM10", "NO2", "O3", "CO", "SO2", "BLH"]
) + " FROM obs GROUP BY 1"

# ---------------------------------------------------------------------------
# window features
# ---------------------------------------------------------------------------


def _register_features():
    SQL["lag_features"] = _feat([f"pm25_lag{n}" for n in (1, 6, 24, 48, 72, 168)], wide=False)
    SQL["rolling_features"] = _feat(("pm25_roll8_mean pm25_roll8_std pm25_roll8_max pm25_roll8_min pm25_roll24_mean pm25_roll24_std pm25_roll24_max "
        "pm25_roll48_mean pm25_roll48_std pm25_roll48_max pm25_roll72_mean pm25_roll168_mean pm25_roll168_std ").split(), wide=False)
    SQL["rolling_long_mean"] = _feat(["pm25_roll365_mean", "pm25_level_ratio"], wide=False)
    SQL["anomaly_features"] = _feat(("pm25_current pm25_diff_1_6 pm25_diff_6_24 pm25_accel pm25_trend_24h pm25_anomaly_score is_spike pm25_norm "
        "pm25_range_24 ").split(), wide=False)
    SQL["rain_features"] = _feat(("precip_lag1 precip_lag6 precip_lag24 rain_acc_6h rain_acc_12h rain_acc_24h rain_washout wind_rainy_interact "
        "blh_rainy_interact precip_trend ").split(), wide=True)
    SQL["hours_since_event"] = feature_sql(
        ["hours_since_rain"], True,
        out_cols="series_id, ts, Precipitation, CAST(hours_since_rain AS DOUBLE) AS hours_since_rain")
    cal = _calendar_sql()
    SQL["calendar_features"] = OBS + "\nSELECT series_id, ts, " + ", ".join(
        (f"{cal[c]} AS {c}" if c in INT_FEATURES else f"{r4(cal[c])} AS {c}") for c in cal
    ) + " FROM obs"
    SQL["covariate_features"] = _feat(("temperature_lag1 wind_speed_lag1 relative_humidity_lag1 pressure_lag1 blh_lag1 blh_lag6 blh_roll24_mean "
        "clouds_lag1 co_lag1 co_lag6 no2_lag1 no2_lag6 so2_lag1 pm10_lag1 pm10_lag6 o3_lag1 wind_x_humidity "
        "temp_x_humidity blh_x_wind pm10_pm25_ratio dispersion_idx blh_pm25_interact ").split(), wide=True)
    hz = HORIZONS
    per_k = ["label_raw", "label", "pm25_lagK"] + [f"{c}_atK" for c in FT.WEATHER_LEAD]
    body = feature_sql(["pm25_current"], True, horizons=hz, out_cols="*")
    unions = " UNION ALL ".join(
        f"SELECT series_id, ts, {r4('pm25_current')} AS pm25_current, {k} AS K, "
        + ", ".join(f"{r4(f'{c}__k{k}')} AS {c}" for c in per_k)
        + f", {r4(f'CAST({k / FT.HORIZON_NORM!r} AS DOUBLE)')} AS horizon_norm FROM feat"
        for k in hz)
    SQL["horizon_labels"] = body.replace("\nSELECT * FROM l2", ",\nfeat AS (SELECT * FROM l2)\n") + unions
    names = FT.ALL_NAMES
    split = ("CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' "
             "WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END")

    def complete(k: int) -> str:
        at = {f"{c}_atK": f"{c}_atK__k{k}" for c in FT.WEATHER_LEAD} | {
            c: f"{c}__k{k}" for c in ("label", "label_raw", "pm25_lagK")}
        cols = [c for c in FT.horizon_features(k) if c != "horizon_norm"] + ["label", "label_raw"]
        return " AND ".join(f"{at.get(c, c)} IS NOT NULL" for c in cols)

    unions = " UNION ALL ".join(
        f"SELECT {k} AS K, {split} AS split, count(*) AS n_rows, {r4(f'avg(label_raw__k{k})')} AS mean_label "
        f"FROM feat WHERE {complete(k)} GROUP BY 2" for k in FT.HORIZONS)
    body = feature_sql(names, True, horizons=FT.HORIZONS, out_cols="*")
    SQL["drop_incomplete"] = body.replace("\nSELECT * FROM l2", ",\nfeat AS (SELECT * FROM l2)\n") + unions
    SQL["time_split_counts"] = (f"SELECT event_type AS series_id, {split} AS split, count(*) AS n_rows "
                                "FROM events GROUP BY 1, 2")


_register_features()


# ---------------------------------------------------------------------------
# selection / evaluation
# ---------------------------------------------------------------------------

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _spearman() -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in LI)
    feats = [c for c in LI if c != "l_extendedprice"]
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r4(f'corr(r_{c}, r_l_extendedprice)')} AS corr FROM r" for c in feats)
    return f"WITH r AS (SELECT {ranks} FROM lineitem) {sel}"


SQL["spearman_target"] = _spearman()
SQL["pearson_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r4(f'corr({a}, {b})')} AS corr FROM lineitem"
    for i, a in enumerate(LI) for b in LI[i + 1:])

SPLIT = ("CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' "
         "WHEN ts < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END")


def _persistence_cte() -> str:
    leads = ", ".join(f"lead(PM25, {k}) OVER (PARTITION BY series_id ORDER BY ts) AS y{k}" for k in HORIZONS)
    preds = " UNION ALL ".join(
        f"SELECT {k} AS K, {SPLIT} AS split, y{k} AS label, PM25 AS prediction FROM l WHERE y{k} IS NOT NULL"
        for k in HORIZONS)
    sq = "(label - prediction) * (label - prediction)"
    return (OBS + f""",
base AS (SELECT * FROM obs WHERE PM25 IS NOT NULL AND NOT isnan(PM25)),
l AS (SELECT ts, PM25, {leads} FROM base),
p AS ({preds}),
agg AS (SELECT K,
        sqrt(avg(CASE WHEN split = 'train' THEN {sq} END)) AS rmse_train,
        sqrt(avg(CASE WHEN split = 'val' THEN {sq} END)) AS rmse_val,
        sqrt(avg(CASE WHEN split = 'test' THEN {sq} END)) AS rmse_test,
        sum(CASE WHEN split = 'test' THEN {sq} END) AS sse,
        count(CASE WHEN split = 'test' THEN label END) * var_pop(CASE WHEN split = 'test' THEN label END) AS sst
        FROM p GROUP BY K),
res AS (SELECT K, rmse_train, rmse_val, rmse_test,
        CASE WHEN sst > 0 THEN 1.0 - sse / sst END AS r2_test, rmse_val - rmse_train AS gap FROM agg)""")


_FLAGS = ("CASE WHEN gap < 6.0 THEN 'good' WHEN gap < 10.0 THEN 'fair' ELSE 'poor' END AS gap_flag, "
          "CASE WHEN r2_test >= 0.85 THEN 'good' WHEN r2_test >= 0.65 THEN 'fair' ELSE 'poor' END AS r2_flag")
_MET = ", ".join(f"{r4(c)} AS {c}" for c in ["rmse_train", "rmse_val", "rmse_test", "r2_test", "gap"])

_STRATEGY = "CASE WHEN K = 25 THEN 'LONG' WHEN K <= 8 THEN 'SHORT' ELSE 'MED' END AS strategy"
SQL["horizon_metrics"] = _persistence_cte() + f"\nSELECT K, {_MET}, {_FLAGS}, {_STRATEGY} FROM res"

SQL["result_sinks"] = _persistence_cte() + f"""
SELECT fmt, K, {r4('rmse_test')} AS rmse_test, {r4('gap')} AS gap, row_number() OVER (PARTITION BY fmt ORDER BY K) - 1 AS place
FROM res, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt)"""

SQL["eval_by_horizon_band"] = _persistence_cte() + f"""
SELECT band, {r4('avg(rmse_test)')} AS mean_rmse_test, {r4('avg(r2_test)')} AS mean_r2_test,
       {r4('avg(gap)')} AS mean_gap, count(*) AS n_horizons
FROM (SELECT *, CASE WHEN K BETWEEN 1 AND 6 THEN 'short' WHEN K BETWEEN 7 AND 24 THEN 'mid'
                     WHEN K BETWEEN 25 AND 49 THEN 'long' END AS band FROM res)
GROUP BY ROLLUP (band)"""


def _leaderboard() -> str:
    from hazecast.operators.evaluate import REFERENCE_RMSE
    vals = ", ".join(f"({k}, CAST({b} AS DOUBLE), CAST({v4} AS DOUBLE), CAST({v5} AS DOUBLE))"
                     for k, b, v4, v5 in REFERENCE_RMSE)
    return _persistence_cte() + f""",
ref(K, best, v4, v5) AS (VALUES {vals}),
j AS (SELECT res.*, ref.best, ref.v4, ref.v5, rmse_test - v4 AS d_v4, rmse_test - best AS d_best
      FROM res LEFT JOIN ref USING (K))
SELECT K, {_MET}, {r4('best')} AS best, {r4('v4')} AS v4, {r4('v5')} AS v5,
       {r4('d_v4')} AS d_v4, {r4('d_best')} AS d_best,
       count_if(d_v4 < 0) OVER () AS wins_v4, count_if(d_best < 0) OVER () AS wins_best FROM j"""


SQL["leaderboard"] = _leaderboard()

# ---------------------------------------------------------------------------
# serving
# ---------------------------------------------------------------------------

SQL["latest_row"] = """SELECT event_type AS series_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id,
       arg_max(value, ts) AS value FROM events GROUP BY 1"""

SQL["tail_n"] = """SELECT series_id, ts, event_id, value FROM (
  SELECT event_type AS series_id, ts, event_id, value,
         row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 400"""

SQL["freshness_gap"] = f"""WITH {HOURLY_LONG},
l AS (SELECT series_id, max(ts) AS last_ts FROM hourly_long GROUP BY 1)
SELECT series_id, last_ts, TIMESTAMP '2024-01-30 11:00:00' AS cutoff_ts,
       {r4("(epoch_us(TIMESTAMP '2024-01-30 11:00:00') - epoch_us(last_ts)) / 3600000000.0")} AS gap_hours,
       (epoch_us(TIMESTAMP '2024-01-30 11:00:00') - epoch_us(last_ts)) / 3600000000.0 >= 1 AS stale
FROM l"""


def _naive_cte(base: str) -> str:
    ks = ", ".join(f"({k})" for k in HORIZONS)
    return f"""{HOURLY_LONG},
m AS (SELECT series_id, avg(value) AS mean, max(ts) AS last_ts FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM hourly_long)
      WHERE rn <= 24 GROUP BY 1),
ks(K) AS (VALUES {ks}),
pred AS (SELECT m.series_id, ks.K,
                round((mean + ks.K * CAST(0.1 AS DOUBLE)) * 100.0) / 100.0 AS pm25,
                {_simple_sql('mean', True)} AS aqi,
                {base} + to_hours(ks.K) AS forecast_dt, {base} AS base_ts
         FROM m CROSS JOIN ks)"""


SQL["naive_forecast"] = ("WITH " + _naive_cte("TIMESTAMP '2024-01-30 12:34:56'")
                         + "\nSELECT series_id, K, pm25, aqi, forecast_dt, base_ts FROM pred")


def _wah() -> str:
    ks = ", ".join(f"({k})" for k in HORIZONS)
    fk = {"temp": "Temperature", "wind": "Wind_Speed", "humid": "Relative_Humidity",
          "press": "Pressure", "precip": "Precipitation", "blh": "BLH"}
    sel = ", ".join(f"{r4(f'coalesce(f.{k}, b.{v})')} AS {k}_fK" for k, v in fk.items())
    return OBS + f""",
b AS (SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM obs
        WHERE ts <= TIMESTAMP '2024-01-30 12:34:56') WHERE rn = 1),
ks(K) AS (VALUES {ks}),
f AS (SELECT series_id, ts AS valid_ts, Temperature AS temp, Relative_Humidity AS humid,
             Precipitation AS precip, Wind_Speed AS wind, Pressure AS press, BLH AS blh FROM weather),
bk AS (SELECT b.*, ks.K, date_trunc('hour', b.ts) + to_hours(ks.K) AS valid_ts FROM b CROSS JOIN ks)
SELECT b.series_id, b.ts, b.K, b.valid_ts, {sel},
       {r4('coalesce(f.wind, b.Wind_Speed) * (100 - coalesce(f.humid, b.Relative_Humidity))')} AS dispersion_fK
FROM bk b LEFT JOIN f ON b.series_id = f.series_id AND b.valid_ts = f.valid_ts"""


SQL["weather_at_horizon"] = _wah()


def _slots_cte() -> str:
    from hazecast.functions import aqi as A
    offs = ", ".join(f"({d}, {h})" for d, h in SLOT_OFFSETS)
    cb = A.CATEGORY_BANDS[:-1] + [(None,) + A.CATEGORY_BANDS[-1][1:]]

    def nn(e):
        return f"CASE WHEN aqi IS NULL THEN NULL ELSE {e} END"
    return "WITH " + _naive_cte("last_ts") + f""",
offs(day_index, off) AS (VALUES {offs}),
tg AS (SELECT b.series_id, b.base_ts, date_trunc('day', b.base_ts) + to_hours(offs.off) AS target_dt,
              offs.day_index FROM (SELECT DISTINCT series_id, base_ts FROM pred) b CROSS JOIN offs),
pairs AS (SELECT tg.*, p.K, p.pm25, p.aqi, p.forecast_dt,
                 row_number() OVER (PARTITION BY tg.series_id, tg.target_dt
                   ORDER BY abs(epoch_us(p.forecast_dt) - epoch_us(tg.target_dt)), p.forecast_dt) AS rn
          FROM tg JOIN pred p USING (series_id)),
slots AS (SELECT series_id, base_ts, target_dt, day_index, K, pm25, aqi, forecast_dt,
       strftime(target_dt, '%d/%m %Hh') AS display_dt,
       strftime(target_dt, '%A, %d/%m/%Y %H:%M') AS display_full,
       strftime(target_dt, '%H:00') AS hour_str,
       strftime(date_trunc('day', target_dt), '%d/%m') AS date_str,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[1])))} AS label,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[2])))} AS css_class,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[3])))} AS color
FROM pairs WHERE rn = 1)"""


SQL["slots_nearest"] = _slots_cte() + "\nSELECT * FROM slots"

SQL["slot_stats"] = _slots_cte() + """
SELECT series_id, base_ts, min(aqi) AS aqi_min, max(aqi) AS aqi_max,
       CAST(round_even(avg(aqi), 0) AS INTEGER) AS aqi_avg, count(*) AS n_slots,
       arg_min(display_dt, target_dt) AS current_display_dt
FROM slots GROUP BY 1, 2"""


def _next_hour() -> str:
    from hazecast.functions import aqi as A
    from hazecast.operators.forecast import NO_DATA
    cb = A.CATEGORY_BANDS[:-1] + [(None,) + A.CATEGORY_BANDS[-1][1:]]

    def nn(e):
        return f"CASE WHEN aqi IS NULL THEN NULL ELSE {e} END"
    return _slots_cte() + f""",
nh AS (SELECT series_id, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS next_hour FROM hourly_long GROUP BY 1),
hit AS (SELECT nh.series_id, nh.next_hour, arg_min(s.aqi, s.target_dt) AS aqi, arg_min(s.pm25, s.target_dt) AS pm25,
               count(s.target_dt) AS n_hit
        FROM nh LEFT JOIN slots s ON s.series_id = nh.series_id AND date_trunc('hour', s.forecast_dt) = nh.next_hour
        GROUP BY 1, 2),
fb AS (SELECT series_id, avg(value) AS fb FROM (
         SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM hourly_long)
       WHERE rn <= 8 GROUP BY 1),
o AS (SELECT h.series_id, h.next_hour,
             CASE WHEN h.aqi IS NOT NULL THEN h.aqi ELSE {_simple_sql('fb.fb', True)} END AS aqi,
             CASE WHEN h.aqi IS NOT NULL THEN h.pm25 ELSE round(fb.fb * 100.0) / 100.0 END AS pm25,
             CASE WHEN h.aqi IS NOT NULL THEN 'slot' WHEN fb.fb IS NOT NULL THEN 'realtime' ELSE 'error' END AS source,
             strftime(h.next_hour, '%H:00') AS hour_str
      FROM hit h LEFT JOIN fb USING (series_id))
SELECT series_id, next_hour, CASE WHEN source = 'error' THEN 0 ELSE aqi END AS aqi,
       {r4("CASE WHEN source = 'error' THEN 0.0 ELSE pm25 END")} AS pm25, source, hour_str,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[0])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[1])))} END AS label,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[1])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[2])))} END AS css_class,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[2])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[3])))} END AS color
FROM o"""


SQL["next_hour_lookup"] = _next_hour()

SQL["forecast_document"] = _slots_cte() + """
SELECT series_id, target_dt, K, pm25, aqi, forecast_dt, display_dt, label FROM slots"""

SQL["payload_explode"] = "WITH " + AIR + "\nSELECT series_id, ts, " + ", ".join(
    f"{r4(c)} AS {c}" for c in ["PM25", "PM10", "NO2", "O3", "CO", "SO2"]) + " FROM air"

SQL["stream_upsert"] = SQL["upsert_keep_last"]

SQL["stream_hourly_rollup"] = f"""SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
       count(*) AS n, {r4('sum(value)')} AS sum_value, {r4('max(value)')} AS max_value
FROM events GROUP BY 1, 2"""


# ---------------------------------------------------------------------------
# sources / sinks / tables
# ---------------------------------------------------------------------------

_TZ = "'America/Sao_Paulo'"
_T = "CAST(l_shipdate AS TIMESTAMP)"
_INV = (f"(timezone({_TZ}, timezone({_TZ}, {_T})) <> {_T} "
        f"OR timezone({_TZ}, timezone({_TZ}, {_T}) + INTERVAL 1 HOUR) = {_T} "
        f"OR timezone({_TZ}, timezone({_TZ}, {_T}) - INTERVAL 1 HOUR) = {_T})")
SQL["localize_invalid"] = f"""SELECT l_shipdate, n_rows, invalid FROM (
  SELECT l_shipdate, count(*) AS n_rows, {_INV} AS invalid FROM lineitem GROUP BY l_shipdate)
WHERE invalid"""

SQL["csv_roundtrip"] = OBS + "\nSELECT series_id, ts, AQI, AQI_Pollutant, " + ", ".join(
    f"{r4(c)} AS {c}" for c in ["CO", "NO2", "O3", "PM10", "PM25", "SO2", "Clouds", "Precipitation",
                                "Pressure", "Relative_Humidity", "Temperature", "Wind_Speed",
                                "Wind_Direction", "BLH"]) + " FROM obs"


def _run_slots() -> str:
    strict = _seg("(CASE WHEN isnan(pm25) THEN NULL ELSE CAST(pm25 AS DOUBLE) END)",
                  SIMPLE_SEGMENTS, 500, below=500)
    return _slots_cte() + f"""
SELECT series_id, base_ts, TIMESTAMP '2024-01-30 12:34:56' AS created_at, forecast_dt, pm25,
       {strict} AS aqi, TIMESTAMP '2024-01-30 12:34:56' < TIMESTAMP '2024-01-30 00:00:00' AS stale
FROM slots"""


SQL["run_slot_tables"] = _run_slots()

SQL["ingest_observations"] = SQL["csv_roundtrip"]

SQL["forecast_payload"] = ("WITH " + WEATHER + "\nSELECT series_id, ts AS valid_ts, "
                           + ", ".join(f"{r4(c)} AS {a}" for a, c in
                                       [("temp", "Temperature"), ("humid", "Relative_Humidity"),
                                        ("precip", "Precipitation"), ("wind", "Wind_Speed"),
                                        ("press", "Pressure"), ("blh", "BLH")]) + " FROM weather")

SQL["slot_days"] = _slots_cte() + """
SELECT series_id, base_ts, day_index, min(date_str) AS date_str, min(aqi) AS aqi_min,
       max(aqi) AS aqi_max, count(*) AS n_slots FROM slots GROUP BY 1, 2, 3"""

SQL["stream_daily_rollup"] = f"""SELECT event_type AS series_id, date_trunc('day', ts) AS ts,
       count(*) AS n, {r4('sum(value)')} AS sum_value, {r4('max(value)')} AS max_value
FROM events GROUP BY 1, 2"""


def _greedy_slots() -> str:
    """Greedy unique slot assignment as a recursive CTE: step n takes the
    nearest prediction (ties: earlier forecast) whose K is not yet used."""
    from hazecast.functions import aqi as A
    offs = ", ".join(f"({d}, {h})" for d, h in SLOT_OFFSETS)
    cb = A.CATEGORY_BANDS[:-1] + [(None,) + A.CATEGORY_BANDS[-1][1:]]

    def nn(e):
        return f"CASE WHEN aqi IS NULL THEN NULL ELSE {e} END"
    return "WITH RECURSIVE " + _naive_cte("last_ts") + f""",
offs(day_index, off) AS (VALUES {offs}),
tg AS (SELECT b.series_id, b.base_ts, date_trunc('day', b.base_ts) + to_hours(offs.off) AS target_dt,
              offs.day_index, row_number() OVER (PARTITION BY b.series_id, b.base_ts ORDER BY offs.off) AS step
       FROM (SELECT DISTINCT series_id, base_ts FROM pred) b CROSS JOIN offs),
g(series_id, base_ts, step, used, K, pm25, aqi, forecast_dt, target_dt, day_index) AS (
  SELECT DISTINCT series_id, base_ts, 0, CAST([] AS INTEGER[]), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE),
         CAST(NULL AS INTEGER), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS INTEGER)
  FROM pred
  UNION ALL
  SELECT series_id, base_ts, step, list_append(used, K), K, pm25, aqi, forecast_dt, target_dt, day_index FROM (
    SELECT g.series_id, g.base_ts, t.step, g.used, p.K, p.pm25, p.aqi, p.forecast_dt, t.target_dt, t.day_index,
           row_number() OVER (PARTITION BY g.series_id, g.base_ts
             ORDER BY abs(epoch_us(p.forecast_dt) - epoch_us(t.target_dt)), p.forecast_dt) AS rn
    FROM g JOIN tg t ON t.series_id = g.series_id AND t.base_ts = g.base_ts AND t.step = g.step + 1
           JOIN pred p ON p.series_id = g.series_id AND p.base_ts = g.base_ts
    WHERE NOT list_contains(g.used, p.K)) WHERE rn = 1)
SELECT series_id, base_ts, target_dt, day_index, K, pm25, aqi, forecast_dt,
       strftime(target_dt, '%d/%m %Hh') AS display_dt,
       strftime(target_dt, '%A, %d/%m/%Y %H:%M') AS display_full,
       strftime(target_dt, '%H:00') AS hour_str,
       strftime(date_trunc('day', target_dt), '%d/%m') AS date_str,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[1])))} AS label,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[2])))} AS css_class,
       {nn(_band_sql('aqi', cb, lambda b: _q(b[3])))} AS color
FROM g WHERE step > 0"""


SQL["slots_greedy"] = _greedy_slots()


def _prune(k: int = 1) -> str:
    """M7 + M8 on the training slice of horizon ``k``."""
    body = feature_sql(FT.ALL_NAMES, True, horizons=[k], out_cols="*").replace("\nSELECT * FROM l2", "\n")
    return "WITH RECURSIVE " + body[len("WITH "):] + f""",
""" + _prune_slice(k)


def _prune_slice(k: int, exact: bool = False) -> str:
    """The rest of the query, from the feature table ``l2``: Spearman by
    average ranks (``exact``: from whole numbers), Pearson over kept pairs, and the greedy redundancy loop as a recursive CTE over
    the ordered pairs (outer skip decided at the first pair of each i)."""
    names = FT.horizon_features(k)
    ren = {"label": f"label__k{k}", "label_raw": f"label_raw__k{k}", "pm25_lagK": f"pm25_lagK__k{k}",
           "horizon_norm": f"CAST({k / FT.HORIZON_NORM!r} AS DOUBLE)"}
    ren.update({f"{c}_atK": f"{c}_atK__k{k}" for c in FT.WEATHER_LEAD})
    cols = ", ".join(f"CAST({ren.get(n, n)} AS DOUBLE) AS {n}" for n in names)
    complete = " AND ".join(f"{ren.get(c, c)} IS NOT NULL" for c in names + ["label", "label_raw"])
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
                      for c in names + ["label"])
    sp = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord, corr(r_{c}, r_label) AS sp FROM rk"
                            for i, c in enumerate(names))
    if exact:
        def dot(a, b):
            return (f"sum(CAST(2 * r_{a} - n_tr - 1 AS HUGEINT) * CAST(2 * r_{b} - n_tr - 1 AS HUGEINT))"
                    "::DOUBLE")
        sp = " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {i} AS ord, {dot(c, 'label')} / "
            f"nullif(sqrt({dot(c, c)} * {dot('label', 'label')}), 0) AS sp FROM rk, (SELECT count(*) AS n_tr FROM tr)"
            for i, c in enumerate(names))
    unpiv = ", ".join(names)
    return f"""tr AS (SELECT {cols}, CAST(label__k{k} AS DOUBLE) AS label FROM l2 WHERE {complete} AND {SPLIT} = 'train'),
rk AS (SELECT {ranks} FROM tr),
st1 AS (SELECT feature, ord, CASE WHEN isnan(sp) THEN NULL ELSE sp END AS sp FROM ({sp})),
flag AS (SELECT *, sp IS NOT NULL AND abs(sp) >= 0.05 AS pass FROM st1),
keep AS (SELECT feature, ord, sp FROM flag WHERE pass OR (SELECT count_if(pass) FROM flag) < 5),
keepn AS (SELECT *, row_number() OVER (ORDER BY ord) AS k FROM keep),
lng AS (SELECT rid, feature, value FROM (SELECT row_number() OVER () AS rid, * FROM tr)
        UNPIVOT (value FOR feature IN ({unpiv}))),
pc AS (SELECT a.feature AS fa, b.feature AS fb, corr(a.value, b.value) AS r
       FROM lng a JOIN lng b USING (rid)
       WHERE a.feature IN (SELECT feature FROM keep) AND b.feature IN (SELECT feature FROM keep)
       GROUP BY 1, 2),
pairs AS (SELECT ka.k AS ia, kb.k AS ib, ka.feature AS fa, kb.feature AS fb, pc.r,
                 abs(ka.sp) AS ta, abs(kb.sp) AS tb,
                 row_number() OVER (ORDER BY ka.k, kb.k) AS p
          FROM keepn ka JOIN keepn kb ON ka.k < kb.k
               JOIN pc ON pc.fa = ka.feature AND pc.fb = kb.feature),
g(p, dropped, skip_i) AS (
  SELECT 0, CAST([] AS VARCHAR[]), false
  UNION ALL
  SELECT pr.p,
         CASE WHEN (CASE WHEN pr.ib = pr.ia + 1 THEN list_contains(g.dropped, pr.fa) ELSE g.skip_i END)
                   OR list_contains(g.dropped, pr.fb)
                   OR NOT coalesce(abs(pr.r) > 0.97 AND NOT isnan(pr.r), false)
              THEN g.dropped
              ELSE list_append(g.dropped, CASE WHEN pr.ta >= pr.tb THEN pr.fb ELSE pr.fa END) END,
         CASE WHEN pr.ib = pr.ia + 1 THEN list_contains(g.dropped, pr.fa) ELSE g.skip_i END
  FROM g JOIN pairs pr ON pr.p = g.p + 1),
fin AS (SELECT dropped FROM g ORDER BY p DESC LIMIT 1)
SELECT f.feature,
       f.feature IN (SELECT feature FROM keep) AND NOT list_contains((SELECT dropped FROM fin), f.feature) AS kept,
       f.feature IN (SELECT feature FROM keep) AS passed_target
FROM flag f WHERE (SELECT count(*) FROM tr) >= 200"""


SQL["prune_features"] = _prune()


def _prune_horizons() -> str:
    """M7 + M8 of every horizon over one feature table; materialised, as the
    recursion would compute its pairs anew in every step."""
    body = feature_sql(FT.ALL_NAMES, True, horizons=FT.HORIZONS, out_cols="*").replace("\nSELECT * FROM l2", "\n")
    body = body.replace("\nl2 AS (", "\nl2 AS MATERIALIZED (")
    cte = re.compile(r"^(tr|rk|st1|keepn?|flag|pc|pairs) AS \(", re.M)
    return body + " UNION ALL ".join(
        f"SELECT {k} AS K, * FROM (WITH RECURSIVE " + cte.sub(r"\1 AS MATERIALIZED (", _prune_slice(k, True)) + ")"
        for k in FT.HORIZONS)


SQL["prune_horizons"] = _prune_horizons()


def _serving() -> str:
    """W13 + W14 on the newest row of every series, per horizon."""
    cols = []
    for name in FT.SERVING_NAMES:
        e, n = r4(name), int(re.findall(r"\d+", name)[-1])
        if name.startswith("pm25_lag_extra_"):
            e = f"CASE WHEN K IN ({', '.join(str(k) for k in HORIZONS if n in FT.extra_lags(k))}) THEN {e} END"
        cols.append(f"{e} AS {name}")
    body = feature_sql(FT.SERVING_NAMES, False, out_cols="*").replace("\nSELECT * FROM l2", "\n")
    return body + f"""SELECT series_id, ts, event_id, {', '.join(cols)}, K FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) AS rn FROM l2),
  (SELECT unnest({FT.HORIZONS}) AS K) WHERE rn = 1"""


SQL["serving_features"] = _serving()


# ---------------------------------------------------------------------------
# day tabs, next hour, trigger, grid, embargo, localised ingest, quarantine
# ---------------------------------------------------------------------------

SQL["day_tab_slots"] = _slots_cte() + """
SELECT day_index AS tab, series_id, target_dt, K, pm25, aqi, hour_str FROM slots WHERE day_index IN (0, 1)"""


def _next_hour_paths() -> str:
    """click has a slot, purchase and view a score, error and signup the mean
    of their newest 8, short (the newest 9 rows of error) nothing."""
    from hazecast.functions import aqi as A
    from hazecast.operators.forecast import NO_DATA
    cb = A.CATEGORY_BANDS[:-1] + [(None,) + A.CATEGORY_BANDS[-1][1:]]

    def nn(e):
        return f"CASE WHEN aqi IS NULL THEN NULL ELSE {e} END"
    return _slots_cte() + f""",
newest AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM hourly_long),
h AS (SELECT series_id, ts, value, rn FROM newest
      UNION ALL SELECT 'short', ts, value, rn FROM newest WHERE series_id = 'error' AND rn <= 9),
s AS (SELECT series_id, max(ts) + INTERVAL 1 HOUR AS next_hour, count(*) AS n, arg_max(value, ts) AS last,
             avg(CASE WHEN rn <= 8 THEN value END) AS mean FROM h GROUP BY 1),
hit AS (SELECT arg_min(aqi, target_dt) AS aqi, arg_min(pm25, target_dt) AS pm25 FROM slots WHERE series_id = 'click'),
g AS (SELECT s.*, CASE WHEN n >= 10 AND series_id IN ('purchase', 'view') THEN last WHEN n >= 10 THEN mean END AS guess FROM s),
o AS (SELECT series_id, next_hour, strftime(next_hour, '%H:00') AS hour_str,
             CASE WHEN series_id = 'click' THEN 'slot' WHEN guess IS NULL THEN 'error'
                  WHEN series_id IN ('purchase', 'view') THEN 'model' ELSE 'realtime' END AS source,
             CASE WHEN series_id = 'click' THEN (SELECT aqi FROM hit) ELSE {_simple_sql('guess', True)} END AS aqi,
             CASE WHEN series_id = 'click' THEN (SELECT pm25 FROM hit) ELSE round(guess * 100.0) / 100.0 END AS pm25
      FROM g)
SELECT series_id, next_hour, CASE WHEN source = 'error' THEN 0 ELSE aqi END AS aqi,
       {r4("CASE WHEN source = 'error' THEN 0.0 ELSE pm25 END")} AS pm25, source, hour_str,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[0])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[1])))} END AS label,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[1])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[2])))} END AS css_class,
       CASE WHEN source = 'error' THEN {_q(NO_DATA[2])} ELSE {nn(_band_sql('aqi', cb, lambda b: _q(b[3])))} END AS color
FROM o"""


SQL["next_hour_paths"] = _next_hour_paths()


def _trigger() -> str:
    """The first call of each day scores every series; the second of a day
    scores none."""
    runs = []
    for as_of in ("2024-01-28 10:05:00", "2024-01-29 00:10:00"):
        t = f"TIMESTAMP '{as_of}'"
        cte = _naive_cte(t).replace("FROM hourly_long)", f"FROM hourly_long WHERE ts <= {t})")
        runs.append(f"SELECT * FROM (WITH {cte} SELECT {t} AS as_of, series_id, K, pm25, aqi, forecast_dt FROM pred)")
    return " UNION ALL ".join(runs)


SQL["forecast_trigger"] = _trigger()

SQL["embargo_splits"] = """WITH r AS (
  SELECT ts, ts + to_hours(K) AS seen, K FROM events, (SELECT unnest(range(1, 50, 3)) AS K)),
s AS (SELECT K, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN CASE WHEN seen < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'embargo' END
                     WHEN ts < TIMESTAMP '2024-01-25' THEN CASE WHEN seen < TIMESTAMP '2024-01-25' THEN 'val' ELSE 'embargo' END
                     ELSE 'test' END AS split FROM r)
SELECT CAST(K AS INTEGER) AS K, split, count(*) AS n_rows FROM s GROUP BY ALL"""

SQL["hourly_grid_lags"] = f"""WITH {HOURLY_LONG},
ends AS (SELECT series_id, min(ts) AS a, max(ts) AS b FROM hourly_long GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM ends),
g AS (SELECT grid.series_id, grid.ts, h.value, h.series_id IS NULL AS filled FROM grid
      LEFT JOIN hourly_long h ON h.series_id = grid.series_id AND h.ts = grid.ts)
SELECT series_id, ts, {r4('value')} AS value, filled, """ + ", ".join(
    f"{r4(f'lag(value, {n}) OVER (PARTITION BY series_id ORDER BY ts)')} AS lag{n}h" for n in (1, 6, 24)) + " FROM g"

SQL["wind_lag_features"] = OBS + "\nSELECT series_id, ts, " + ", ".join(
    f"{r4(f'{fn}(radians(coalesce(lag(Wind_Direction, {n}) OVER (PARTITION BY series_id ORDER BY ts), 0.0)))')} AS winddir_{fn}_lag{n}"
    for n in (1, 6) for fn in ("sin", "cos")) + " FROM obs"

SQL["csv_bom_roundtrip"] = OBS + f"\nSELECT series_id, ts, {r4('PM25')} AS PM25, {r4('Temperature')} AS Temperature, true AS has_bom FROM obs"

_OT = "CAST(o_orderdate AS TIMESTAMP)"
SQL["ingest_localized"] = f"""WITH o AS (
  SELECT o_orderpriority AS series_id, {_OT} AS ts, {_INV.replace(_T, _OT)} AS invalid FROM orders)
SELECT series_id, count(*) AS n_rows, count_if(invalid) AS n_invalid,
       min(CASE WHEN NOT invalid THEN ts END) AS first_local, max(CASE WHEN NOT invalid THEN ts END) AS last_local
FROM o GROUP BY 1"""

SQL["payload_quarantine"] = f"""WITH p AS (
  SELECT dayofmonth(ts) AS day, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY {STATION}, CAST(ts AS DATE), 1),
r AS (SELECT CASE WHEN day % 2 = 0 THEN 'archive' ELSE 'recent' END AS source,
             CASE WHEN day % 11 = 5 THEN 'not a payload'
                  WHEN day % 7 = 3 THEN 'array pm10 has another length than time' ELSE 'served' END AS reason, hours FROM p)
SELECT source, reason, count(*) AS n_payloads, sum(CASE WHEN reason = 'served' THEN hours ELSE 0 END)::BIGINT AS n_hours
FROM r GROUP BY ALL
UNION ALL SELECT 'gone', 'source is missing', 1, 0"""


# ---------------------------------------------------------------------------
# models: grids, gaps and counts
# ---------------------------------------------------------------------------

def _model_checks() -> None:

    def complete(k: int) -> str:
        at = {f"{c}_atK": f"{c}_atK__k{k}" for c in FT.WEATHER_LEAD} | {c: f"{c}__k{k}" for c in ("label", "label_raw", "pm25_lagK")}
        cols = [c for c in FT.horizon_features(k) if c != "horizon_norm"] + ["label", "label_raw"]
        return " AND ".join(f"{at.get(c, c)} IS NOT NULL" for c in cols)

    counts = " UNION ALL ".join(f"SELECT {k} AS K, {SPLIT} AS split, count(*) AS n_rows FROM l2 WHERE {complete(k)} GROUP BY 2"
                                for k in FT.HORIZONS)
    body = feature_sql(FT.ALL_NAMES, True, horizons=FT.HORIZONS, out_cols="*").replace("\nSELECT * FROM l2", "")
    head = body + (f",\ncounts AS ({counts}),\ntrained AS (SELECT K FROM counts WHERE split = 'train' AND n_rows >= 200),"
                   "\nlast AS (SELECT series_id, max(ts) AS base_ts FROM l2 GROUP BY 1)\n")
    for name, family in (("ridge", "linear"), ("rf", "rf"), ("gbt", "gbt")):
        SQL[f"{name}_forecast_checks"] = head + (
            f"SELECT '{family}' AS family, series_id, K, base_ts, base_ts + to_hours(K) AS forecast_dt, true AS aqi_ok FROM last, trained")
        SQL[f"{name}_eval_checks"] = head + (
            f"SELECT '{family}' AS family, K, true AS gap_ok, true AS flag_ok, true AS enough_features FROM trained")
    SQL["model_registry"] = head + ("SELECT K, split, n_rows, n_rows AS n_same, true AS same_names, 2 AS version "
                                    "FROM counts WHERE K IN (SELECT K FROM trained)")


_model_checks()
