"""The feature catalogue as plain SQL, written out for the oracle: every
feature from the observed columns by one formula, without the engine's records
and without its steps."""

from __future__ import annotations

HORIZONS = list(range(1, 50, 3))
HORIZON_NORM = 49.0
WEATHER_LEAD = ["Temperature", "Wind_Speed", "Relative_Humidity", "Pressure", "Precipitation", "BLH", "wind_dir_sin", "wind_dir_cos"]


def formulas(order: str) -> dict[str, str]:
    """Feature -> SQL over the columns of one row and its series."""
    def before(c: str, n: int) -> str:
        return f"lag({c}, {n}) OVER (PARTITION BY series_id ORDER BY {order})"

    def last(fn: str, c: str, n: int) -> str:
        return f"{fn}({c}) OVER (PARTITION BY series_id ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    def pm(n: int) -> str:
        return before("PM25", n)

    day_mean, day_std, day_max = last("avg", "PM25", 24), last("stddev_samp", "PM25", 24), last("max", "PM25", 24)
    year_mean = last("avg", "PM25", 8760)
    score = f"({pm(1)} - {day_mean}) / ({day_std} + 1e-6)"
    wind, humid, temp, blh = (before(c, 1) for c in ("Wind_Speed", "Relative_Humidity", "Temperature", "BLH"))
    rain = {n: f"{before('Precipitation', n)} > 0.1" for n in (1, 3, 6, 12, 24)}
    out = {f"pm25_lag{n}": pm(n) for n in (1, 6, 24, 48, 72, 168)}
    out |= {f"pm25_roll{n}_mean": last("avg", "PM25", n) for n in (8, 24, 48, 72, 168)}
    out |= {f"pm25_roll{n}_std": last("stddev_samp", "PM25", n) for n in (8, 24, 48, 168)}
    out |= {f"pm25_roll{n}_max": last("max", "PM25", n) for n in (8, 24, 48)}
    out |= {"pm25_roll8_min": last("min", "PM25", 8), "pm25_roll365_mean": year_mean}
    out |= {"temperature_lag1": temp, "wind_speed_lag1": wind, "relative_humidity_lag1": humid,
            "pressure_lag1": before("Pressure", 1), "clouds_lag1": before("Clouds", 1)}
    out |= {f"precip_lag{n}": before("Precipitation", n) for n in (1, 6, 24)}
    out |= {"blh_lag1": blh, "blh_lag6": before("BLH", 6), "blh_roll24_mean": last("avg", "BLH", 24)}
    out |= {"co_lag1": before("CO", 1), "co_lag6": before("CO", 6), "no2_lag1": before("NO2", 1), "no2_lag6": before("NO2", 6),
            "so2_lag1": before("SO2", 1), "pm10_lag1": before("PM10", 1), "pm10_lag6": before("PM10", 6), "o3_lag1": before("O3", 1)}
    out |= {f"rain_acc_{n}h": last("sum", "Precipitation", n) for n in (6, 12, 24)}
    out |= {
        "pm25_diff_1_6": f"{pm(1)} - {pm(6)}",
        "pm25_diff_6_24": f"{pm(6)} - {pm(24)}",
        "pm25_accel": f"({pm(1)} - {pm(6)}) - ({pm(6)} - {pm(24)})",
        "pm25_trend_24h": f"{pm(1)} - {pm(24)}",
        "pm25_anomaly_score": score,
        "is_spike": f"CASE WHEN {score} > 2.0 THEN 1 WHEN {score} <= 2.0 THEN 0 END",
        "pm25_norm": f"{pm(1)} / ({day_mean} + 1e-6)",
        "pm25_range_24": f"{day_max} - {day_mean}",
        "pm25_level_ratio": f"{day_mean} / ({year_mean} + 1e-6)",
        "wind_x_humidity": f"{wind} * {humid}",
        "temp_x_humidity": f"{temp} * {humid}",
        "blh_x_wind": f"{blh} * {wind}",
        "pm10_pm25_ratio": f"{before('PM10', 1)} / ({pm(1)} + 1e-6)",
        "dispersion_idx": f"{wind} * (100 - {humid})",
        "blh_pm25_interact": f"{pm(1)} / ({blh} + 1.0)",
        "rain_washout": f"CASE WHEN {last('sum', 'Precipitation', 6)} > 1.0 THEN 1 WHEN {last('sum', 'Precipitation', 6)} <= 1.0 THEN 0 END",
        "hours_since_rain": "CAST(CASE WHEN Precipitation > 0.1 THEN 0 " + " ".join(f"WHEN {rain[n]} THEN {n}" for n in rain)
                            + " ELSE 48 END AS DOUBLE)",
        "wind_rainy_interact": f"{wind} * (month(ts) BETWEEN 5 AND 10)::INT",
        "blh_rainy_interact": f"{blh} * (month(ts) BETWEEN 5 AND 10)::INT",
        "precip_trend": f"{before('Precipitation', 1)} - {before('Precipitation', 6)}",
    }
    for n in sorted({m for k in HORIZONS for m in extra_lags(k)}):
        out[f"pm25_lag_extra_{n}"] = pm(n)
    for n in (8, 24, 48, 168):
        out[f"pm25_roll{n}_std_pop"] = f"CASE WHEN {last('count', '*', n)} = {n} THEN {last('stddev_pop', 'PM25', n)} END"
    return out


def extra_lags(k: int) -> list[int]:
    return sorted({k, max(1, k // 2), max(1, k // 3)})


#: Columns of a row alone (the oracle's calendar CTE has them).
OF_THE_ROW = ["pm25_current", "wind_dir_sin", "wind_dir_cos", "hour", "month", "is_rainy_season", "is_burn_season", "is_april",
              "is_rush_hour", "is_night", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos", "days_since_start"]
SERVING_NAMES = [n for n in formulas("ts") if n.startswith("pm25_lag_extra_") or n.endswith("_std_pop")]
ALL_NAMES = OF_THE_ROW + [n for n in formulas("ts") if n not in SERVING_NAMES]

_RAIN = ("hours_since_rain rain_acc_6h rain_acc_12h rain_acc_24h rain_washout is_rainy_season wind_rainy_interact "
         "blh_rainy_interact precip_trend")
# The feature sets of the horizons up to 8 h, of the others, and of 25 h.
_SETS = {
    "short": "pm25_current pm25_lag1 pm25_lag6 pm25_roll8_mean pm25_roll8_std pm25_roll8_max pm25_roll8_min pm25_diff_1_6 "
             "pm25_accel pm25_anomaly_score is_spike pm25_norm pm25_range_24 temperature_lag1 wind_speed_lag1 "
             "relative_humidity_lag1 pressure_lag1 precip_lag1 dispersion_idx blh_pm25_interact blh_lag1 blh_lag6 "
             "blh_roll24_mean wind_dir_sin wind_dir_cos no2_lag1 pm10_lag1 co_lag1 so2_lag1 hour_sin hour_cos is_rush_hour "
             "is_night is_weekend is_burn_season is_april pm25_lag24 pm25_roll24_mean pm25_roll24_std pm25_lagK " + _RAIN,
    "medium": "pm25_lag1 pm25_lag6 pm25_lag24 pm25_roll8_mean pm25_roll24_mean pm25_roll48_mean pm25_roll8_std pm25_roll24_std "
              "pm25_roll8_max pm25_roll24_max pm25_diff_1_6 pm25_diff_6_24 pm25_trend_24h pm25_anomaly_score pm25_norm is_spike "
              "pm25_range_24 pm25_roll168_mean pm25_roll168_std pm25_roll365_mean pm25_level_ratio days_since_start "
              "temperature_lag1 wind_speed_lag1 relative_humidity_lag1 pressure_lag1 precip_lag1 precip_lag6 blh_lag1 blh_lag6 "
              "blh_roll24_mean blh_x_wind wind_dir_sin wind_dir_cos dispersion_idx blh_pm25_interact clouds_lag1 no2_lag1 "
              "no2_lag6 pm10_lag1 pm10_lag6 co_lag1 co_lag6 so2_lag1 o3_lag1 wind_x_humidity temp_x_humidity pm10_pm25_ratio "
              "hour_sin hour_cos month_sin month_cos is_rush_hour is_night is_weekend is_burn_season is_april pm25_current "
              "pm25_lag48 pm25_lagK " + _RAIN,
    "day": "pm25_lag1 pm25_lag6 pm25_lag24 pm25_lag48 pm25_lag72 pm25_lag168 pm25_roll24_mean pm25_roll48_mean pm25_roll72_mean "
           "pm25_roll24_std pm25_roll48_std pm25_roll24_max pm25_roll48_max pm25_diff_6_24 pm25_trend_24h pm25_anomaly_score "
           "pm25_norm pm25_range_24 pm25_roll168_mean pm25_roll168_std pm25_roll365_mean pm25_level_ratio days_since_start "
           "temperature_lag1 wind_speed_lag1 relative_humidity_lag1 pressure_lag1 precip_lag6 precip_lag24 blh_lag1 blh_lag6 "
           "blh_roll24_mean wind_dir_sin wind_dir_cos dispersion_idx no2_lag1 pm10_lag1 co_lag1 hour_sin hour_cos month_sin "
           "month_cos is_weekend is_night is_burn_season is_april pm25_lagK " + _RAIN,
}


def horizon_features(k: int) -> list[str]:
    """Features of the model of horizon ``k``, in order."""
    own = _SETS["short" if k <= 8 else "day" if k == 25 else "medium"].split()
    return list(dict.fromkeys([*own, *(f"{c}_atK" for c in WEATHER_LEAD), "pm25_lagK", "horizon_norm"]))
