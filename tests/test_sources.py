"""Sources: BOM-prefixed history CSV (S1–S3) and forecast documents whose
slots lack display fields (S6 back-fill)."""

import datetime as dt
import json
import os

from hazecast.session import shared_dir
from hazecast.sources import payloads as PL


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def test_csv_with_bom_header(spark):
    d = _local(shared_dir(spark, "bom-csv"))
    with open(os.path.join(d, "history.csv"), "w", encoding="utf-8-sig") as f:
        f.write("Local_Time,AQI,PM25,PM10,Temperature\n")
        f.write("2024-01-01 00:00:00,57,15.2,20,24.5\n")
        f.write("2024-01-01 01:00:00,,nan,bad,24.0\n")
    df = PL.read_observations_csv(spark, d)
    rows = df.orderBy("ts").collect()
    assert "ts" in df.columns and rows[0]["ts"] == dt.datetime(2024, 1, 1)
    assert rows[0]["AQI"] == 57 and rows[0]["PM25"] == 15.2
    # empty / unparsable values become null
    assert rows[1]["AQI"] is None and rows[1]["PM10"] is None


def test_documents_backfill_display(spark):
    d = _local(shared_dir(spark, "docs"))
    doc = {"series_id": "s", "generated_at": "2024-01-01T06:00:00",
           "slots": [{"K": 4, "pm25": 30.5, "aqi": 90, "forecast_dt": "2024-01-02T03:00:00"}]}
    with open(os.path.join(d, "doc.json"), "w") as f:
        f.write(json.dumps(doc) + "\n")
    r = PL.read_documents(spark, d).collect()[0]
    assert r["display_dt"] == "02/01 03h"
    assert r["display_full"] == "Tuesday, 02/01/2024 03:00"


def test_write_table_formats(spark):
    """Result tables written as parquet, CSV (header) and JSON."""
    df = spark.createDataFrame([(1, 8.76, "good"), (4, 15.7, "fair")], "K int, rmse double, flag string")
    for fmt in ("parquet", "csv", "json"):
        path = shared_dir(spark, f"table-{fmt}")
        PL.write_table(df, path, fmt)
        reader = spark.read.option("header", True)
        back = getattr(reader, fmt)(path)
        got = sorted((int(r["K"]), float(r["rmse"]), r["flag"]) for r in back.collect())
        assert got == [(1, 8.76, "good"), (4, 15.7, "fair")], fmt


def test_tail_reads_the_dates_of_the_look_back(spark, tmp_path):
    """Only the dates that hold the newest rows are scanned, per series."""
    from hazecast.sources.history import land_history, read_tail, tail_dates
    rows = spark.sql("select 'a' series_id, timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(id as int)) ts, id v from range(2400)"
                     " union all select 'old', timestamp_ntz '2024-01-03' + make_dt_interval(0, cast(id as int)), id from range(30)"
                     " union all select 'short', timestamp_ntz '2024-02-01' + make_dt_interval(0, cast(id as int)), id from range(5)")
    land_history(rows, f"{tmp_path}/h")
    dates = sorted((r["series_id"], str(r["date"])) for r in tail_dates(spark, f"{tmp_path}/h", 30).collect())
    assert dates == [("a", "2024-04-08"), ("a", "2024-04-09"), ("old", "2024-01-03"), ("old", "2024-01-04"), ("short", "2024-02-01")]
    tail = read_tail(spark, f"{tmp_path}/h", 30)
    assert "dynamicpruning" in tail._jdf.queryExecution().executedPlan().toString()
    got = {r["series_id"]: r["n"] for r in tail.groupBy("series_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {"a": 48, "old": 30, "short": 5}
    newest = {r["series_id"]: r["m"] for r in tail.groupBy("series_id").agg({"v": "max"}).withColumnRenamed("max(v)", "m").collect()}
    assert newest == {"a": 2399, "old": 29, "short": 4}
