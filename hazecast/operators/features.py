"""Feature catalogue (§2.12) as a declarative spec → Spark columns.

Three layers, evaluated in one window pass per series bucket:

* row-local columns (target copy, calendar flags, wind direction sin/cos);
* window columns: lags, leads, trailing frames (current row excluded) and
  prefix-sum long means, declared as ``WinFeature`` records;
* arithmetic on window columns, declared as SQL expression text and
  evaluated with ``F.expr`` (the same text is valid DuckDB, which the oracle
  uses to cross-check the windowed results).

Train and serve use the same builder: serving scores the newest row of each
series, so the skew between training and serving names cannot arise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazecast.functions.calendar import calendar_columns, wind_dir_columns
from hazecast.operators import windows as Wn
from hazecast.operators.clean import impute_seasonal, target_not_null


@dataclass(frozen=True)
class WinFeature:
    name: str
    kind: str          # lag | lead | mean | std | std_full | max | min | sum | long_mean | flag_lag
    src: str
    n: int
    threshold: float | None = None


def _w(name, kind, src, n, threshold=None):
    return WinFeature(name, kind, src, n, threshold)


# The training catalogue.
TARGET_LAGS = [1, 6, 24, 48, 72, 168]
WINDOW_FEATURES: list[WinFeature] = (
    [_w(f"pm25_lag{n}", "lag", "PM25", n) for n in TARGET_LAGS]
    + [_w("pm25_roll8_mean", "mean", "PM25", 8), _w("pm25_roll8_std", "std", "PM25", 8),
       _w("pm25_roll8_max", "max", "PM25", 8), _w("pm25_roll8_min", "min", "PM25", 8),
       _w("pm25_roll24_mean", "mean", "PM25", 24), _w("pm25_roll24_std", "std", "PM25", 24),
       _w("pm25_roll24_max", "max", "PM25", 24),
       _w("pm25_roll48_mean", "mean", "PM25", 48), _w("pm25_roll48_std", "std", "PM25", 48),
       _w("pm25_roll48_max", "max", "PM25", 48),
       _w("pm25_roll72_mean", "mean", "PM25", 72),
       _w("pm25_roll168_mean", "mean", "PM25", 168), _w("pm25_roll168_std", "std", "PM25", 168),
       _w("pm25_roll365_mean", "long_mean", "PM25", 365 * 24)]
    + [_w("temperature_lag1", "lag", "Temperature", 1),
       _w("wind_speed_lag1", "lag", "Wind_Speed", 1),
       _w("relative_humidity_lag1", "lag", "Relative_Humidity", 1),
       _w("pressure_lag1", "lag", "Pressure", 1),
       _w("precip_lag1", "lag", "Precipitation", 1),
       _w("precip_lag6", "lag", "Precipitation", 6),
       _w("precip_lag24", "lag", "Precipitation", 24),
       _w("blh_lag1", "lag", "BLH", 1), _w("blh_lag6", "lag", "BLH", 6),
       _w("blh_roll24_mean", "mean", "BLH", 24),
       _w("clouds_lag1", "lag", "Clouds", 1)]
    + [_w("co_lag1", "lag", "CO", 1), _w("co_lag6", "lag", "CO", 6),
       _w("no2_lag1", "lag", "NO2", 1), _w("no2_lag6", "lag", "NO2", 6),
       _w("so2_lag1", "lag", "SO2", 1),
       _w("pm10_lag1", "lag", "PM10", 1), _w("pm10_lag6", "lag", "PM10", 6),
       _w("o3_lag1", "lag", "O3", 1)]
    + [_w("rain_acc_6h", "sum", "Precipitation", 6),
       _w("rain_acc_12h", "sum", "Precipitation", 12),
       _w("rain_acc_24h", "sum", "Precipitation", 24)]
    + [_w(f"rained_lag{n}", "flag_lag", "Precipitation", n, 0.1) for n in (1, 3, 6, 12, 24)]
)
INTERMEDIATE = {f"rained_lag{n}" for n in (1, 3, 6, 12, 24)}

# arithmetic on window columns: SQL text shared by Spark and DuckDB
DERIVED: dict[str, str] = {
    "pm25_diff_1_6": "pm25_lag1 - pm25_lag6",
    "pm25_diff_6_24": "pm25_lag6 - pm25_lag24",
    "pm25_accel": "(pm25_lag1 - pm25_lag6) - (pm25_lag6 - pm25_lag24)",
    "pm25_trend_24h": "pm25_lag1 - pm25_lag24",
    "pm25_anomaly_score": "(pm25_lag1 - pm25_roll24_mean) / (pm25_roll24_std + 1e-6)",
    "is_spike": "CAST((pm25_lag1 - pm25_roll24_mean) / (pm25_roll24_std + 1e-6) > 2.0 AS INT)",
    "pm25_norm": "pm25_lag1 / (pm25_roll24_mean + 1e-6)",
    "pm25_range_24": "pm25_roll24_max - pm25_roll24_mean",
    "pm25_level_ratio": "pm25_roll24_mean / (pm25_roll365_mean + 1e-6)",
    "wind_x_humidity": "wind_speed_lag1 * relative_humidity_lag1",
    "temp_x_humidity": "temperature_lag1 * relative_humidity_lag1",
    "blh_x_wind": "blh_lag1 * wind_speed_lag1",
    "pm10_pm25_ratio": "pm10_lag1 / (pm25_lag1 + 1e-6)",
    "dispersion_idx": "wind_speed_lag1 * (100 - relative_humidity_lag1)",
    "blh_pm25_interact": "pm25_lag1 / (blh_lag1 + 1.0)",
    "rain_washout": "CAST(rain_acc_6h > 1.0 AS INT)",
    "hours_since_rain": ("CAST(CASE WHEN Precipitation > 0.1 THEN 0.0 WHEN rained_lag1 = 1 THEN 1.0 "
                         "WHEN rained_lag3 = 1 THEN 3.0 WHEN rained_lag6 = 1 THEN 6.0 "
                         "WHEN rained_lag12 = 1 THEN 12.0 WHEN rained_lag24 = 1 THEN 24.0 "
                         "ELSE 48.0 END AS DOUBLE)"),
    "wind_rainy_interact": "wind_speed_lag1 * is_rainy_season",
    "blh_rainy_interact": "blh_lag1 * is_rainy_season",
    "precip_trend": "precip_lag1 - precip_lag6",
}

CALENDAR = ["hour", "month", "is_rainy_season", "is_burn_season", "is_april", "is_rush_hour",
            "is_night", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos",
            "days_since_start"]
ROW_LOCAL = ["pm25_current", "wind_dir_sin", "wind_dir_cos"] + CALENDAR

# horizon block: leads of the target and of the weather at +K
WEATHER_LEAD = ["Temperature", "Wind_Speed", "Relative_Humidity", "Pressure",
                "Precipitation", "BLH", "wind_dir_sin", "wind_dir_cos"]
HORIZONS = list(range(1, 50, 3))          # 1, 4, ..., 49
HORIZON_NORM = 49.0


def extra_lags(k: int) -> list[int]:
    """The further lags of a serving row of horizon ``k``."""
    return list(dict.fromkeys([k, max(k // 2, 1), max(k // 3, 1)]))


# serving side only (W13, W14): population std, null on fewer than n rows
SERVING_FEATURES: list[WinFeature] = (
    [_w(f"pm25_lag_extra_{n}", "lag", "PM25", n) for n in sorted({n for k in HORIZONS for n in extra_lags(k)})]
    + [_w(f"pm25_roll{n}_std_pop", "std_full", "PM25", n) for n in (8, 24, 48, 168)]
)
SERVING_NAMES = [f.name for f in SERVING_FEATURES]
WIND_LAGS = (1, 6)


def wind_lag_columns(w) -> dict:
    """Sine and cosine of the wind direction 1 and 6 rows ago, as the
    serving side has them (a missing direction counts as 0 degrees)."""
    out = {}
    for n in WIND_LAGS:
        x = F.radians(F.coalesce(F.lag("Wind_Direction", n).over(w), F.lit(0.0)))
        out |= {f"winddir_sin_lag{n}": F.sin(x), f"winddir_cos_lag{n}": F.cos(x)}
    return out

# Feature-name sets of the three horizon strategies.
RAIN_FEATS = ["hours_since_rain", "rain_acc_6h", "rain_acc_12h", "rain_acc_24h",
              "rain_washout", "is_rainy_season", "wind_rainy_interact",
              "blh_rainy_interact", "precip_trend"]
FEATURES_SHORT = [
    "pm25_current", "pm25_lag1", "pm25_lag6",
    "pm25_roll8_mean", "pm25_roll8_std", "pm25_roll8_max", "pm25_roll8_min",
    "pm25_diff_1_6", "pm25_accel", "pm25_anomaly_score", "is_spike", "pm25_norm",
    "pm25_range_24",
    "temperature_lag1", "wind_speed_lag1", "relative_humidity_lag1",
    "pressure_lag1", "precip_lag1", "dispersion_idx", "blh_pm25_interact",
    "blh_lag1", "blh_lag6", "blh_roll24_mean",
    "wind_dir_sin", "wind_dir_cos",
    "no2_lag1", "pm10_lag1", "co_lag1", "so2_lag1",
    "hour_sin", "hour_cos", "is_rush_hour", "is_night", "is_weekend",
    "is_burn_season", "is_april",
    "pm25_lag24", "pm25_roll24_mean", "pm25_roll24_std",
    "pm25_lagK",
] + RAIN_FEATS
FEATURES_MED = [
    "pm25_lag1", "pm25_lag6", "pm25_lag24",
    "pm25_roll8_mean", "pm25_roll24_mean", "pm25_roll48_mean",
    "pm25_roll8_std", "pm25_roll24_std", "pm25_roll8_max", "pm25_roll24_max",
    "pm25_diff_1_6", "pm25_diff_6_24", "pm25_trend_24h",
    "pm25_anomaly_score", "pm25_norm", "is_spike",
    "pm25_range_24", "pm25_roll168_mean", "pm25_roll168_std",
    "pm25_roll365_mean", "pm25_level_ratio", "days_since_start",
    "temperature_lag1", "wind_speed_lag1", "relative_humidity_lag1",
    "pressure_lag1", "precip_lag1", "precip_lag6",
    "blh_lag1", "blh_lag6", "blh_roll24_mean", "blh_x_wind",
    "wind_dir_sin", "wind_dir_cos", "dispersion_idx", "blh_pm25_interact",
    "clouds_lag1", "no2_lag1", "no2_lag6", "pm10_lag1", "pm10_lag6",
    "co_lag1", "co_lag6", "so2_lag1", "o3_lag1",
    "wind_x_humidity", "temp_x_humidity", "pm10_pm25_ratio",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "is_rush_hour", "is_night", "is_weekend", "is_burn_season", "is_april",
    "pm25_current", "pm25_lag48",
    "pm25_lagK",
] + RAIN_FEATS
FEATURES_LONG = [
    "pm25_lag1", "pm25_lag6",
    "pm25_lag24", "pm25_lag48", "pm25_lag72", "pm25_lag168",
    "pm25_roll24_mean", "pm25_roll48_mean", "pm25_roll72_mean",
    "pm25_roll24_std", "pm25_roll48_std", "pm25_roll24_max", "pm25_roll48_max",
    "pm25_diff_6_24", "pm25_trend_24h", "pm25_anomaly_score", "pm25_norm",
    "pm25_range_24", "pm25_roll168_mean", "pm25_roll168_std",
    "pm25_roll365_mean", "pm25_level_ratio", "days_since_start",
    "temperature_lag1", "wind_speed_lag1", "relative_humidity_lag1",
    "pressure_lag1", "precip_lag6", "precip_lag24",
    "blh_lag1", "blh_lag6", "blh_roll24_mean",
    "wind_dir_sin", "wind_dir_cos", "dispersion_idx",
    "no2_lag1", "pm10_lag1", "co_lag1",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "is_weekend", "is_night", "is_burn_season", "is_april",
    "pm25_lagK",
] + RAIN_FEATS


def base_features(k: int) -> list[str]:
    """Feature set per horizon (ordered, de-duplicated)."""
    if k <= 8:
        names = FEATURES_SHORT
    elif k == 25:
        names = FEATURES_LONG
    else:
        names = FEATURES_MED
    return list(dict.fromkeys(names))


def weather_at_k() -> list[str]:
    return [f"{c}_atK" for c in WEATHER_LEAD]


def horizon_features(k: int) -> list[str]:
    """Ordered union of the base set, weather at +K, lagK and horizon_norm (U4)."""
    return list(dict.fromkeys(base_features(k) + weather_at_k() + ["pm25_lagK", "horizon_norm"]))


# ---------------------------------------------------------------------------
# dependency resolution
# ---------------------------------------------------------------------------

_WIN = {f.name: f for f in WINDOW_FEATURES + SERVING_FEATURES}
_IDENT = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _deps_of(name: str) -> set[str]:
    if name in DERIVED:
        return {t for t in _IDENT.findall(DERIVED[name]) if t in _WIN or t in ROW_LOCAL}
    return set()


def resolve(names) -> tuple[list[WinFeature], list[str]]:
    """Window features and derived names needed to produce ``names``."""
    wins, derived = {}, []
    for n in names:
        if n in DERIVED:
            derived.append(n)
            for d in _deps_of(n):
                if d in _WIN:
                    wins[d] = _WIN[d]
        elif n in _WIN:
            wins[n] = _WIN[n]
    return [f for f in _WIN.values() if f.name in wins], derived


def look_back(names) -> int:
    """Rows before a row that its features read."""
    return max((f.n for f in resolve(names)[0]), default=0)


ALL_NAMES = ROW_LOCAL + [f.name for f in WINDOW_FEATURES if f.name not in INTERMEDIATE] + list(DERIVED)


#: Kinds of trailing frames, all evaluated in linear time.
FRAME_KINDS = {"mean": "mean", "long_mean": "mean", "std": "std", "std_full": "std_full", "max": "max", "min": "min", "sum": "sum"}


def _win_column(w, f: WinFeature):
    if f.kind == "lag":
        return F.lag(F.col(f.src), f.n).over(w)
    if f.kind == "lead":
        return F.lead(F.col(f.src), f.n).over(w)
    if f.kind == "flag_lag":
        return (F.lag(F.col(f.src), f.n).over(w) > F.lit(f.threshold)).cast("int")
    raise ValueError(f.kind)


def _horizon_columns(w, horizons, target, available, weather=True):
    cols = {}
    for k in horizons:
        lead = F.lead(F.col(target), k).over(w)
        cols[f"label_raw__k{k}"] = lead
        cols[f"label__k{k}"] = F.log1p(lead)
        cols[f"pm25_lagK__k{k}"] = F.lag(F.col(target), k).over(w)
        for c in WEATHER_LEAD if weather else ():
            if c in available:
                cols[f"{c}_atK__k{k}"] = F.lead(F.col(c), k).over(w)
    return cols


def add_row_local(df: DataFrame, target: str = "PM25", ts: str = "ts") -> DataFrame:
    cols = {"pm25_current": F.col(target)}
    cols.update(calendar_columns(ts))
    if "Wind_Direction" in df.columns:
        cols.update(wind_dir_columns("Wind_Direction"))
    return df.withColumns(cols)


def build_features(df: DataFrame, names=None, horizons=(), target: str = "PM25",
                   key: str = "series_id", order=("ts",), clean: bool = True,
                   impute: bool = True, split: bool = True,
                   bucket_rows: int | None = None, horizon_weather: bool = True) -> DataFrame:
    """Feature table for ``names`` (default: the whole catalogue) and, for
    each K in ``horizons``, the label and +K columns suffixed ``__k{K}``.

    ``clean`` applies P5 (drop null target) first, ``impute`` fills BLH with
    the seasonal/series median (A2/A3/N2) when the column exists.
    """
    names = list(names or ALL_NAMES)
    if clean:
        df = target_not_null(df, target)
    if impute and "BLH" in df.columns:
        df = impute_seasonal(df, "BLH", key)
    df = add_row_local(df, target)
    wins, derived = resolve(names)
    frames = [f for f in wins if f.kind in FRAME_KINDS]
    offsets = [f for f in wins if f.kind not in FRAME_KINDS]
    horizons = list(horizons)
    back = max([f.n for f in offsets] + [f.n + 1 for f in frames] + horizons + [1])
    fwd = max(horizons + [0])
    helpers = []

    def build(w, by):
        t = Wn.Trailing(w, by)
        for f in frames:
            t.need(f.src, f.n, FRAME_KINDS[f.kind])
        columns = {f.name: _win_column(w, f) for f in offsets}
        columns.update(_horizon_columns(w, horizons, target, set(df.columns), horizon_weather))
        columns.update({f.name: t.column(f.src, f.n, FRAME_KINDS[f.kind]) for f in frames})
        helpers.extend(t.helpers() if frames else ())
        return [*(t.stages() if frames else ()), columns]

    out = Wn.series_windows(df, build, back=back, fwd=fwd, key=key, order=order,
                            bucket_rows=bucket_rows, split=split).drop(*helpers)
    if derived:
        out = out.withColumns({n: F.expr(DERIVED[n]) for n in derived})
    return out.drop(*[c for c in INTERMEDIATE if c in out.columns and c not in names])


def horizon_frame(feat: DataFrame, k: int, keep=None) -> DataFrame:
    """Columns of horizon ``k`` renamed to the catalogue names."""
    ren = {f"label_raw__k{k}": "label_raw", f"label__k{k}": "label",
           f"pm25_lagK__k{k}": "pm25_lagK"}
    ren.update({f"{c}_atK__k{k}": f"{c}_atK" for c in WEATHER_LEAD})
    ren = {a: b for a, b in ren.items() if a in feat.columns}
    base = [c for c in feat.columns if "__k" not in c]
    if keep is not None:
        base = [c for c in base if c in keep]
    return feat.select(*base, *[F.col(a).alias(b) for a, b in ren.items()],
                       F.lit(k).alias("K"), F.lit(k / HORIZON_NORM).alias("horizon_norm"))


def horizon_long(feat: DataFrame, horizons, keep=None) -> DataFrame:
    """One row per (series, ts, K): ``stack`` of the per-horizon columns."""
    base = [c for c in feat.columns if "__k" not in c]
    if keep is not None:
        base = [c for c in base if c in keep]
    per_k = ["label_raw", "label", "pm25_lagK"] + [f"{c}_atK" for c in WEATHER_LEAD]
    per_k = [c for c in per_k if f"{c}__k{horizons[0]}" in feat.columns]
    structs = [F.struct(F.lit(k).alias("K"),
                        *[F.col(f"{c}__k{k}").alias(c) for c in per_k]) for k in horizons]
    return (feat.select(*base, F.explode(F.array(*structs)).alias("_h"))
            .select(*base, "_h.*")
            .withColumn("horizon_norm", F.col("K") / F.lit(HORIZON_NORM)))
