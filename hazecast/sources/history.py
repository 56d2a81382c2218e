"""History kept in date partitions, and its tail.

A served row needs the last few rows of its series, not their history.  The
history is landed as one folder a date with a table of row counts beside it;
a reader asks that small table which dates hold the newest ``rows`` rows of each
series and joins the history with them, so that Spark prunes the scan to those
folders at run time (dynamic partition pruning) whatever the age of the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def land_history(df: DataFrame, path: str, key: str = "series_id", ts: str = "ts") -> None:
    """Write ``df`` as ``path``/rows, a folder a date, and ``path``/days with the rows
    of every series and date."""
    dated = df.withColumn("date", F.to_date(ts))
    (dated.repartition("date", F.pmod(F.xxhash64(key), F.lit(16))).sortWithinPartitions("date", key, ts)
     .write.mode("overwrite").partitionBy("date").parquet(f"{path}/rows"))
    dated.groupBy(key, "date").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/days")


def tail_dates(spark: SparkSession, path: str, rows: int, key: str = "series_id") -> DataFrame:
    """(series, date): the newest dates of each series that hold its newest
    ``rows`` rows."""
    days = spark.read.parquet(f"{path}/days")
    newer = Window.partitionBy(key).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    return (days.withColumn("_newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
            .where(F.col("_newer") < rows).select(key, "date"))


def read_tail(spark: SparkSession, path: str, rows: int, key: str = "series_id") -> DataFrame:
    """The newest ``rows`` rows of every series and the rest of their oldest
    date; all of a shorter series."""
    history = spark.read.parquet(f"{path}/rows")
    return history.join(tail_dates(spark, path, rows, key), [key, "date"]).drop("date")
