"""Serving: greedy slot golden case, as-of nearest vs brute force, naive forecast."""

import datetime as dt


from hazecast.operators import forecast as FC
from hazecast.operators.features import HORIZONS
from hazecast.operators.joins import asof_nearest


def _preds(spark, base):
    rows = [("s", k, float(k), 50, base + dt.timedelta(hours=k), base) for k in HORIZONS]
    return spark.createDataFrame(rows, "series_id string, K int, pm25 double, aqi int, "
                                       "forecast_dt timestamp_ntz, base_ts timestamp_ntz")


def test_greedy_slots_golden(spark):
    """Base 2026-05-12 06:00, K = 1, 4, …, 49: the shipped document's slot order."""
    base = dt.datetime(2026, 5, 12, 6, 0)
    slots = FC.slots_greedy(_preds(spark, base)).orderBy("target_dt").collect()
    assert [r["K"] for r in slots] == [19, 22, 25, 28, 31, 34, 37, 40, 43, 46, 49, 16, 13, 10, 7, 4]
    assert slots[0]["display_dt"] == "13/05 00h"
    assert slots[0]["display_full"] == "Wednesday, 13/05/2026 00:00"
    assert [r["day_index"] for r in slots] == [0] * 8 + [1] * 8


def test_nearest_slots_bruteforce(spark):
    base = dt.datetime(2026, 5, 12, 6, 0)
    slots = FC.slots_nearest(_preds(spark, base)).collect()
    assert len(slots) == 16
    for s in slots:
        diffs = [(abs((base + dt.timedelta(hours=k) - s["target_dt"]).total_seconds()), k) for k in HORIZONS]
        assert s["K"] == min(diffs)[1]


def test_asof_tie_prefers_earlier(spark):
    left = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 2))], "series_id string, t timestamp_ntz")
    right = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 1), 1), ("s", dt.datetime(2024, 1, 1, 3), 3)],
                                  "series_id string, f timestamp_ntz, v int")
    r = asof_nearest(left, right, ["series_id"], "t", "f", ["v"]).collect()[0]
    assert r["v"] == 1


def test_naive_forecast(spark):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, PM25 double")
    out = {r["K"]: r for r in FC.naive_forecast(df, [1, 4], as_of="2024-01-02 10:00:00").collect()}
    mean = sum(range(6, 30)) / 24
    assert out[1]["pm25"] == round(mean + 0.1, 2)
    assert out[4]["forecast_dt"] == dt.datetime(2024, 1, 2, 14)


def test_weather_fallback(spark):
    base = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 5, 30), 10.0, 2.0, 50.0, 1000.0, 0.0, 300.0)],
                                 "series_id string, ts timestamp_ntz, Temperature double, Wind_Speed double, "
                                 "Relative_Humidity double, Pressure double, Precipitation double, BLH double")
    fc = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 6), 20.0, None, 1.0, 3.0, 900.0, 500.0)],
                               "series_id string, valid_ts timestamp_ntz, temp double, humid double, "
                               "precip double, wind double, press double, blh double")
    out = {r["K"]: r for r in FC.weather_at_horizon(base, fc, [1, 2]).collect()}
    assert out[1]["temp_fK"] == 20.0 and out[1]["humid_fK"] == 50.0      # null value → fallback
    assert out[2]["temp_fK"] == 10.0                                     # missing hour → fallback


def test_next_hour_paths(spark):
    """slot hit / realtime fallback (mean of newest 8) / error record."""
    t = dt.datetime(2024, 1, 1, 10)
    slots = spark.createDataFrame(
        [("a", t + dt.timedelta(hours=1, minutes=20), t + dt.timedelta(hours=14), 120, 40.0)],
        "series_id string, forecast_dt timestamp_ntz, target_dt timestamp_ntz, aqi int, pm25 double")
    hist = spark.createDataFrame([("a", t, 1.0)] + [("b", t - dt.timedelta(hours=i), float(i)) for i in range(10)],
                                 "series_id string, ts timestamp_ntz, PM25 double")
    as_of = spark.createDataFrame([("a", t), ("b", t), ("c", t)], "series_id string, as_of timestamp_ntz")
    out = {r["series_id"]: r for r in FC.next_hour(slots, hist, as_of).collect()}
    assert out["a"]["source"] == "slot" and out["a"]["aqi"] == 120
    assert out["b"]["source"] == "realtime" and out["b"]["pm25"] == round(sum(range(8)) / 8, 2)
    assert out["c"]["source"] == "error" and out["c"]["aqi"] == 0 and out["c"]["css_class"] == "unknown"
    assert out["a"]["hour_str"] == "11:00"
