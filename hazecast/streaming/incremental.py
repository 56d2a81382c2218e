"""Incremental refresh with Structured Streaming (T2, T4) plus batch forms.

* ``stream_upsert``: new observation files → per micro-batch keep-last per
  (series, hour) → upsert table, newest version per key – U2 across
  micro-batches.
* ``stream_hourly_rollup``: partial tumbling-window aggregates per
  micro-batch, merged like the versions (late rows count in full).

Both keep their rows in a ``VersionedTable``: micro-batches are merged as they
come, replayed ones are ignored, and reading costs the same after any number.
Checkpoints and outputs live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.functions.calendar import hour_floor
from hazecast.session import shared_dir
from hazecast.streaming.versioned import VersionedTable


def file_stream(spark: SparkSession, directory: str, name: str,
                max_files_per_trigger: int = 64) -> DataFrame:
    """A file-source stream over the table ``<directory>/<name>.parquet``, a
    folder of part files or a single file, with an explicit schema;
    ``max_files_per_trigger`` bounds each micro-batch.  A missing table is an
    error."""
    path = f"{directory.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if folder:
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def resolve_latest(versions: DataFrame, keys, order_cols) -> DataFrame:
    """Newest version per key (max over ``order_cols``); aggregate with
    partial aggregation, no window over a whole key."""
    keys = list(keys)
    rest = [c for c in versions.columns if c not in keys]
    return (versions.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_r"))
            .select(*keys, "_r.*"))


def stream_upsert(spark: SparkSession, directory: str, history: DataFrame, start, as_of,
                  trigger_available_now: bool = True) -> DataFrame:
    """T2 + T3: ``history`` (series_id, ts, value) is the initial table;
    events with ``start <= ts <= as_of`` stream in and per hour the latest
    event value wins over older values and over the history."""
    out = shared_dir(spark, "upsert")
    table = VersionedTable(spark, f"{out}/table", lambda v: resolve_latest(v, ["series_id", "ts"], ["prio", "ev_ts", "ev_id"]))
    table.commit(history.select("series_id", "ts", "value", F.lit("history").alias("src"),
                                F.lit(0).alias("prio"), F.lit(None).cast("timestamp_ntz").alias("ev_ts"),
                                F.lit(None).cast("long").alias("ev_id")), -1)

    events = file_stream(spark, directory, "events")
    events = events.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) &
                          (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        last = (batch.groupBy(F.col("event_type").alias("series_id"), hour_floor("ts").alias("ts"))
                .agg(F.max_by(F.struct("value", "ts", "event_id"), F.struct("ts", "event_id")).alias("l"))
                .select("series_id", "ts", F.col("l.value").alias("value"), F.lit("delta").alias("src"),
                        F.lit(1).alias("prio"), F.col("l.ts").alias("ev_ts"),
                        F.col("l.event_id").alias("ev_id")))
        table.commit(last, batch_id)

    q = (events.writeStream.foreachBatch(upsert_batch)
         .option("checkpointLocation", f"{out}/_checkpoint"))
    q = q.trigger(availableNow=True) if trigger_available_now else q
    q.start().awaitTermination()
    return table.read().select("series_id", "ts", "value", "src")


def stream_hourly_rollup(spark: SparkSession, directory: str, window: str = "1 hour",
                         max_files_per_trigger: int = 64) -> DataFrame:
    """T4: tumbling windows (1 hour, or e.g. 1 day) per series.

    Every micro-batch writes the partial count, sum and maximum of its own
    rows; reading merges the partials.  Rows may come in any order and as late
    as they like: none is dropped, and there is no state to expire."""
    out = shared_dir(spark, "rollup")
    start = F.window(F.col("ts").cast("timestamp"), window).start.cast("timestamp_ntz")

    def merged(parts: DataFrame) -> DataFrame:
        return parts.groupBy("series_id", "ts").agg(F.sum("n").alias("n"), F.sum("sum_value").alias("sum_value"),
                                                    F.max("max_value").alias("max_value"))
    table = VersionedTable(spark, f"{out}/table", merged)

    def partial_rollup(batch: DataFrame, batch_id: int) -> None:
        part = (batch.groupBy(F.col("event_type").alias("series_id"), start.alias("ts"))
                .agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"),
                     F.max("value").alias("max_value")))
        table.commit(part, batch_id)

    (file_stream(spark, directory, "events", max_files_per_trigger).writeStream.foreachBatch(partial_rollup)
     .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    empty = "series_id string, ts timestamp_ntz, n long, sum_value double, max_value double"
    found = table.read()
    return found if found is not None else spark.createDataFrame([], empty)


def dedupe_stream(events: DataFrame, keys=("event_type", "ts"), watermark: str = "1 hour") -> DataFrame:
    """Insert-only variant of T2: drop duplicate keys within the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))
