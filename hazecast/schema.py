"""Canonical schemas, column orders and rename maps."""

from __future__ import annotations

from pyspark.sql import types as T

POLLUTANTS = ["CO", "NO2", "O3", "PM10", "PM25", "SO2"]
WEATHER = ["Clouds", "Precipitation", "Pressure", "Relative_Humidity",
           "Temperature", "Wind_Speed", "Wind_Direction", "BLH"]

# canonical observation order (series key first)
OBS_ORDER = ["series_id", "ts", "AQI", "AQI_Pollutant"] + POLLUTANTS + WEATHER

OBSERVATION = T.StructType(
    [T.StructField("series_id", T.StringType(), False),
     T.StructField("ts", T.TimestampNTZType(), False),
     T.StructField("AQI", T.IntegerType(), True),
     T.StructField("AQI_Pollutant", T.StringType(), True)]
    + [T.StructField(c, T.DoubleType(), True) for c in POLLUTANTS + WEATHER]
)

# measures summarised by the history rollups
ROLLUP_FIELDS = ["AQI", "PM25", "PM10", "NO2", "O3", "CO", "SO2"]

# Source field names of the hourly payloads → canonical names.
AIR_QUALITY_RENAME = {
    "pm2_5": "PM25", "pm10": "PM10",
    "carbon_monoxide": "CO", "nitrogen_dioxide": "NO2",
    "sulphur_dioxide": "SO2", "ozone": "O3",
}
WEATHER_RENAME = {
    "temperature_2m": "Temperature",
    "relative_humidity_2m": "Relative_Humidity",
    "precipitation": "Precipitation",
    "surface_pressure": "Pressure",
    "cloud_cover": "Clouds",
    "wind_speed_10m": "Wind_Speed",
    "wind_direction_10m": "Wind_Direction",
    "boundary_layer_height": "BLH",
}
FORECAST_RENAME = {
    "temperature_2m": "temp",
    "relativehumidity_2m": "humid",
    "precipitation": "precip",
    "windspeed_10m": "wind",
    "pressure_msl": "press",
    "boundary_layer_height": "blh",
}
# forecast field → observation column used as fallback (last observed value)
FORECAST_FALLBACK = {
    "temp": "Temperature", "wind": "Wind_Speed", "humid": "Relative_Humidity",
    "press": "Pressure", "precip": "Precipitation", "blh": "BLH",
}

PREDICTION = T.StructType([
    T.StructField("series_id", T.StringType(), False),
    T.StructField("K", T.IntegerType(), False),
    T.StructField("pm25", T.DoubleType(), True),
    T.StructField("aqi", T.IntegerType(), True),
    T.StructField("forecast_dt", T.TimestampNTZType(), True),
])

SLOT = T.StructType(PREDICTION.fields + [
    T.StructField("target_dt", T.TimestampNTZType(), True),
    T.StructField("display_dt", T.StringType(), True),
    T.StructField("display_full", T.StringType(), True),
    T.StructField("hour_str", T.StringType(), True),
    T.StructField("date_str", T.StringType(), True),
    T.StructField("day_index", T.IntegerType(), True),
])


def payload_schema(fields: list[str]) -> T.StructType:
    """``hourly: struct<time: array<string>, <field>: array<double> ...>``."""
    inner = [T.StructField("time", T.ArrayType(T.StringType()), True)]
    inner += [T.StructField(f, T.ArrayType(T.DoubleType()), True) for f in fields]
    return T.StructType([
        T.StructField("series_id", T.StringType(), True),
        T.StructField("hourly", T.StructType(inner), True),
    ])
