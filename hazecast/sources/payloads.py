"""Hourly API payloads (struct of parallel arrays) ⇄ rows, forecast
documents, and table sinks (S1–S11).

Payloads enter as landed JSON files (one document per series and request
window); ``inline(arrays_zip(...))`` turns each into rows without a UDF.
Documents are written per (series, run) with bounded arrays (≤ 17 entries).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazecast.functions.calendar import display_formats, parse_ts
from hazecast.functions.numeric import safe_float
from hazecast.operators.clean import rename, select_existing
from hazecast.schema import FORECAST_RENAME, OBSERVATION, OBS_ORDER, payload_schema

API_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"


def read_payloads(spark: SparkSession, path: str, fields) -> DataFrame:
    """Landed payload JSON with an explicit schema (no inference pass)."""
    return spark.read.schema(payload_schema(list(fields))).json(path)


ERRORS = "source string, file string, series_id string, reason string, record string"


def screened_payloads(spark: SparkSession, sources: dict[str, str], fields) -> tuple[DataFrame, DataFrame]:
    """Payloads of several sources and a table of what could not be used, with
    its source, file, reason and (if it is no JSON) record; one bad source,
    file or payload does not keep the others from being served.

    A source whose path is missing is one error.  A record is refused if it is
    no JSON of the payload's form, has no series or no times, has arrays of
    another length than its times, or a time that is no timestamp."""
    good, bad = [], []
    for source, path in sorted(sources.items()):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            bad.append(spark.createDataFrame([(source, path, None, "source is missing", None)], ERRORS))
            continue
        schema = payload_schema(list(fields)).add("_corrupt", T.StringType())
        rows = (spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
                .select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), "*"))
        rows = rows.withColumn("reason", _fault(fields))
        good.append(rows.where("reason is null").select("source", "series_id", "hourly"))
        bad.append(rows.where("reason is not null").select("source", "file", "series_id", "reason", F.col("_corrupt").alias("record")))
    empty = spark.createDataFrame([], T.StructType([T.StructField("source", T.StringType()), *payload_schema(list(fields)).fields]))
    return reduce(DataFrame.unionByName, good, empty), reduce(DataFrame.unionByName, bad, spark.createDataFrame([], ERRORS))


def _fault(fields) -> Column:
    """Why a payload cannot be used; null if it can."""
    times = F.col("hourly.time")
    uneven = [F.when(F.size(F.col(f"hourly.{f}")) != F.size(times), F.lit(f"array {f} has another length than time")) for f in fields]
    return F.coalesce(
        F.when(F.col("_corrupt").isNotNull(), F.lit("not a payload")),
        F.when(F.col("series_id").isNull(), F.lit("no series")),
        F.when(times.isNull(), F.lit("no times")),
        *uneven,
        F.when(F.exists(times, lambda t: F.try_to_timestamp(t).isNull()), F.lit("a time is no timestamp")))


def explode_payload(payloads: DataFrame, mapping: dict | None = None, key: str = "series_id",
                    ts: str = "ts") -> DataFrame:
    """Zip the parallel arrays under ``hourly`` into rows, parse ``time``
    and rename the source fields (P1, P4)."""
    inner = payloads.select(key, "hourly.*")
    fields = [c for c in inner.columns if c not in (key, "time")]
    rows = inner.select(key, F.inline(F.arrays_zip("time", *fields)))
    rows = rows.withColumn(ts, parse_ts("time")).drop("time")
    return rename(rows, mapping or {})


def build_payloads(rows: DataFrame, mapping: dict, key: str = "series_id", ts: str = "ts",
                   page: str = "day") -> DataFrame:
    """Inverse of ``explode_payload``: one payload per (series, ``page``)
    with arrays sorted by time – pages keep every array bounded."""
    inv = {v: k for k, v in mapping.items()}
    src = [c for c in rows.columns if c not in (key, ts)]
    recs = F.struct(F.date_format(ts, API_TIME_FORMAT).alias("time"),
                    *[F.col(c).alias(inv.get(c, c)) for c in src])
    grouped = (rows.groupBy(key, F.date_trunc(page, ts).alias("_page"))
               .agg(F.array_sort(F.collect_list(recs)).alias("_r")))
    hourly = F.struct(F.col("_r.time").alias("time"),
                      *[F.col(f"_r.{inv.get(c, c)}").alias(inv.get(c, c)) for c in src])
    return grouped.select(key, hourly.alias("hourly"))


def forecast_rows(payloads: DataFrame, key: str = "series_id") -> DataFrame:
    """Weather-forecast payload → (series_id, valid_ts, temp, humid,
    precip, wind, press, blh)."""
    rows = explode_payload(payloads, FORECAST_RENAME, key, ts="valid_ts")
    return select_existing(rows, [key, "valid_ts", "temp", "humid", "precip", "wind", "press", "blh"])


def read_observations_csv(spark: SparkSession, path: str) -> DataFrame:
    """History CSV with a header, explicit schema (Spark strips a
    UTF-8 BOM); the reference's ``Local_Time`` header maps to ``ts``."""
    raw = spark.read.option("header", True).csv(path, inferSchema=False)
    df = rename(raw, {"Local_Time": "ts"})
    types = {f.name: f.dataType for f in OBSERVATION.fields}

    def typed(c: str):
        """Text to the column's type: NaN and unparsable numbers are null
        (P11), and a whole number may be written with a decimal point."""
        if c == "ts":
            return F.to_timestamp_ntz(F.col(c))
        if isinstance(types[c], T.DoubleType):
            return safe_float(F.col(c))
        if isinstance(types[c], T.IntegralType):
            return F.rint(safe_float(F.col(c))).cast(types[c])
        return F.col(c).try_cast(types[c])

    cols = [typed(c).alias(c) for c in df.columns if c in types]
    return select_existing(df.select(*cols), OBS_ORDER)


BOM = "\ufeff"


def write_observations(df: DataFrame, path: str, fmt: str = "parquet", ts: str = "ts", bom: bool = False) -> None:
    """Partitioned by date, rows clustered by (series, ts) within files;
    range partitioning keeps one hot series from landing in one task.  With
    ``bom`` every CSV file begins with the UTF-8 byte-order mark, as the
    spreadsheet form of the history file does."""
    if ts not in df.columns and "Local_Time" in df.columns:
        ts = "Local_Time"
    out = (df.withColumn("date", F.to_date(ts))
           .repartitionByRange("date", "series_id", ts)
           .sortWithinPartitions("series_id", ts))
    if bom:                             # the mark is the first character of the header
        out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    w = out.write.mode("overwrite").partitionBy("date")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def forecast_documents(slots: DataFrame, predictions: DataFrame, generated_at,
                       key: str = "series_id") -> DataFrame:
    """S9 as a DataFrame: one document per (series, base) with ``slots`` and
    ``raw_predictions`` arrays (≤ 16 / 17 entries) sorted by time."""
    s = (slots.groupBy(key, "base_ts")
         .agg(F.array_sort(F.collect_list(F.struct(
             "target_dt", "K", "pm25", "aqi", "forecast_dt", "display_dt", "display_full",
             "hour_str", "date_str", "day_index", "label", "css_class", "color"))).alias("slots")))
    p = (predictions.groupBy(key, "base_ts")
         .agg(F.array_sort(F.collect_list(F.struct("forecast_dt", "K", "pm25", "aqi")))
              .alias("raw_predictions")))
    return (s.join(p, [key, "base_ts"], "left")
            .withColumn("generated_at", F.lit(generated_at).cast("timestamp_ntz")))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, key: str = "series_id") -> DataFrame:
    """Forecast documents → slot rows; display fields are back-filled
    from ``forecast_dt`` when absent."""
    docs = spark.read.json(path)
    s = docs.select(key, "generated_at", F.explode("slots").alias("s")).select(key, "generated_at", "s.*")
    s = s.withColumn("forecast_dt", F.col("forecast_dt").cast("timestamp_ntz"))
    fill = display_formats("forecast_dt")
    for c in ("display_dt", "display_full"):
        if c in s.columns:
            s = s.withColumn(c, F.coalesce(F.col(c), fill[c]))
        else:
            s = s.withColumn(c, fill[c])
    return s


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rollups and result tables."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
