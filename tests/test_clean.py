"""Cleaning, imputation, dedupe/upsert and freshness semantics."""

import datetime as dt


from hazecast.operators import clean

T0 = dt.datetime(2024, 1, 1)


def _h(i):
    return T0 + dt.timedelta(hours=i)


def test_upsert_keep_last_and_first(spark):
    hist = spark.createDataFrame([("a", _h(0), 1.0), ("a", _h(1), 2.0)], "series_id string, ts timestamp_ntz, v double")
    delta = spark.createDataFrame([("a", _h(1), 20.0), ("a", _h(2), 30.0)], "series_id string, ts timestamp_ntz, v double")
    last = {r["ts"]: r["v"] for r in clean.upsert_keep_last(hist, delta).collect()}
    first = {r["ts"]: r["v"] for r in clean.dedupe_keep_first(hist, delta).collect()}
    assert last == {_h(0): 1.0, _h(1): 20.0, _h(2): 30.0}
    assert first == {_h(0): 1.0, _h(1): 2.0, _h(2): 30.0}


def test_upsert_idempotent(spark):
    hist = spark.createDataFrame([("a", _h(0), 1.0)], "series_id string, ts timestamp_ntz, v double")
    delta = spark.createDataFrame([("a", _h(0), 5.0)], "series_id string, ts timestamp_ntz, v double")
    once = clean.upsert_keep_last(hist, delta)
    twice = clean.upsert_keep_last(once, delta)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_union_missing_columns(spark):
    a = spark.createDataFrame([("a", 1.0)], "series_id string, x double")
    b = spark.createDataFrame([("b", 2)], "series_id string, y int")
    u = clean.union_all([a, b]).orderBy("series_id").collect()
    assert u[0]["y"] is None and u[1]["x"] is None


def test_impute_seasonal_then_series_median(spark):
    rows = [("a", T0 + dt.timedelta(days=d), float(d)) for d in range(5)]   # hour 0, January
    rows += [("a", T0 + dt.timedelta(days=1, hours=5), None)]               # hour 5: no seasonal value
    rows += [("a", T0 + dt.timedelta(days=6), None)]                        # hour 0: seasonal median
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, BLH double")
    out = {r["ts"]: r["BLH"] for r in clean.impute_seasonal(df, "BLH").collect()}
    assert out[T0 + dt.timedelta(days=6)] == 2.0
    assert out[T0 + dt.timedelta(days=1, hours=5)] == 2.0


def test_freshness(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10, 0)), ("b", dt.datetime(2024, 1, 1, 8, 0))],
                               "series_id string, ts timestamp_ntz")
    # as_of 11:30 → cutoff 10:00 → a gap 0 (fresh), b gap 2 (stale)
    out = {r["series_id"]: (r["gap_hours"], r["stale"])
           for r in clean.freshness(df, "2024-01-01 11:30:00").collect()}
    assert out == {"a": (0.0, False), "b": (2.0, True)}


def test_split_and_filters(spark):
    df = spark.createDataFrame([(_h(0), 1.0), (_h(30), None), (_h(60), float("nan"))], "ts timestamp_ntz, PM25 double")
    assert clean.target_not_null(df).count() == 1
    s = df.select(clean.split_label("2024-01-02", "2024-01-03").alias("s")).collect()
    assert [r["s"] for r in s] == ["train", "val", "test"]


def test_exact_median_of_large_groups(spark):
    from pyspark.sql import functions as F
    from hazecast.operators.clean import series_median
    df = spark.range(60_001).select(F.lit("a").alias("series_id"), (F.pmod(F.col("id") * 7919, F.lit(60_001)) / 8).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", 1.0), ("b", 4.0), ("b", None)], "series_id string, v double"))
    assert {r[0]: r[1] for r in series_median(df, "v").collect()} == {"a": 30_000 / 8, "b": 1.0}
