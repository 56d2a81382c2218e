"""Streaming: insert-only dedupe within the watermark, and the versioned
foreachBatch sink resolving to the newest version per key."""

import datetime as dt


from hazecast.session import shared_dir
from hazecast.streaming.incremental import dedupe_stream, resolve_latest


def test_dedupe_within_watermark(spark, sf_small):
    schema = spark.read.parquet(f"{sf_small}/events.parquet").schema
    src = shared_dir(spark, "dedupe-src")
    e = spark.read.parquet(f"{sf_small}/events.parquet")
    e.unionByName(e).write.mode("overwrite").parquet(src)          # every event twice
    stream = spark.readStream.schema(schema).parquet(src)
    out = shared_dir(spark, "dedupe-out")
    q = (dedupe_stream(stream, ("event_type", "ts")).writeStream.format("parquet")
         .option("checkpointLocation", out + "/_ck").trigger(availableNow=True).start(out + "/data"))
    q.awaitTermination()
    assert spark.read.parquet(out + "/data").count() == e.count()


def test_resolve_latest(spark):
    t = dt.datetime(2024, 1, 1)
    v = spark.createDataFrame([("a", t, 1.0, 0), ("a", t, 2.0, 3), ("b", t, 5.0, 1)],
                              "series_id string, ts timestamp_ntz, value double, batch int")
    got = {r["series_id"]: r["value"] for r in resolve_latest(v, ["series_id", "ts"], ["batch"]).collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_streams_read_folder_tables_and_count_late_rows(spark, sf_small):
    from pyspark.sql import functions as F
    from hazecast.streaming.incremental import stream_hourly_rollup, stream_upsert
    base = shared_dir(spark, "stream-src")
    e = spark.read.parquet(f"{sf_small}/events.parquet")
    # part files whose names ascend while their times descend, one per trigger
    for i, (a, b) in enumerate([("2024-01-20", "2025-01-01"), ("2024-01-10", "2024-01-20"), ("2000-01-01", "2024-01-10")]):
        e.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    got = stream_hourly_rollup(spark, base, max_files_per_trigger=1).agg(F.sum("n"), F.max("max_value")).first()
    assert tuple(got) == tuple(e.agg(F.count("*"), F.max("value")).first())
    none = e.select(F.col("event_type").alias("series_id"), "ts", "value").limit(0)
    up = stream_upsert(spark, base, none, "2024-01-19", "2024-01-30")
    hours = (e.where((F.col("ts") >= "2024-01-19") & (F.col("ts") <= "2024-01-30"))
             .select("event_type", F.date_trunc("hour", "ts")).distinct().count())
    assert up.count() == hours > 0


def test_merges_keep_few_runs():
    """500 batches of any sizes: few runs, and at most twice the rows to read."""
    import random

    from hazecast.streaming.versioned import merge_from
    rng = random.Random(4)
    for new_keys in (0, 3):
        rows, keys = [], 100
        for _ in range(500):
            rows.append(rng.randrange(1, 100))
            keys += new_keys
            k = merge_from(rows)
            if k is not None:
                rows = [*rows[:k], min(keys, sum(rows[k:]))]           # equal keys fold
            assert merge_from(rows) is None
            assert all(a > 2 * b for a, b in zip(rows, rows[1:])) and sum(rows) <= 2 * keys and len(rows) <= 12


def _table(spark, path):
    from hazecast.streaming.versioned import VersionedTable
    return VersionedTable(spark, path, lambda v: v.groupBy("k").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))


def test_versioned_table_replays_and_killed_merges(spark, tmp_path, monkeypatch):
    t = _table(spark, f"file:{tmp_path}/t")
    assert t.read() is None
    want = {}
    for b in range(14):
        rows = [(i % (5 + b), 1) for i in range(30)]
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        df = spark.createDataFrame(rows, "k long, n long")
        if b == 6:                              # killed between the commit of the batch and that of its merge
            monkeypatch.setattr(t, "compact", lambda: (_ for _ in ()).throw(RuntimeError("killed")))
            try:
                t.commit(df, b)
            except RuntimeError:
                pass
            monkeypatch.undo()
            lost = t._write(df)                 # and one that has written a run nobody names
        else:
            assert t.commit(df, b)
        assert not t.commit(df, b) and not t.commit(df, 0)             # replays
        assert {r["k"]: r["n"] for r in t.read().collect()} == want
    runs = [r["rows"] for r in t.manifest()["runs"]]
    assert len(runs) <= 3 and sum(runs) <= 2 * len(want)
    again = _table(spark, f"file:{tmp_path}/t")                        # another process
    assert lost["name"] in again.vacuum()
    assert {r["k"]: r["n"] for r in again.read().collect()} == want
    assert len(again.folder.names("manifest")) == 2
