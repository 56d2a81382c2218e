"""Forecast serving on Spark: score every series at once (M14–M17), weather
at the horizon (N3), naive fallback (M15), display slots (N4/X3), next-hour
lookup (N5), slot statistics (A6) and run/slot tables (S17).

Per horizon one ``PipelineModel.transform`` scores the newest feature row of
*all* series; the 17 horizon frames are unioned.  The greedy unique slot
assignment is a fold over arrays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.functions.aqi import aqi_category, pm25_to_aqi_simple, pm25_to_aqi_strict
from hazecast.functions.calendar import add_hours, day_floor, display_formats, hour_floor
from hazecast.functions.numeric import decode_target, round_dp
from hazecast.operators import features as FT
from hazecast.operators.clean import fill_zero
from hazecast.operators.joins import asof_nearest
from hazecast.operators.rollups import latest_row, mean_of_last_n, tail_n
from hazecast.schema import FORECAST_FALLBACK

# Display slots – 8 per day at these hours, for the two days
# after the base day.
SLOT_HOURS = [0, 3, 6, 9, 12, 15, 18, 21]
SLOT_DAYS = [1, 2]
NAIVE_STEP = 0.1            # naive fallback adds 0.1 per horizon hour
NAIVE_WINDOW = 24
REALTIME_WINDOW = 8
REALTIME_LEAST = 10         # rows that a series must have for a realtime prediction
# next-hour record when nothing can be predicted: label, css class, colour
NO_DATA = ("Không có dữ liệu", "unknown", "#9e9e9e")

# forecast field → feature name at horizon K (serving side of `_atK`)
FORECAST_TO_ATK = {"temp": "Temperature_atK", "wind": "Wind_Speed_atK",
                   "humid": "Relative_Humidity_atK", "press": "Pressure_atK",
                   "precip": "Precipitation_atK", "blh": "BLH_atK"}



def weather_at_horizon(base: DataFrame, forecast: DataFrame, horizons, key="series_id",
                       ts="ts") -> DataFrame:
    """For each base row and K, the forecast valid at
    ``date_trunc('hour', base_ts) + K h``; a missing hour *or* a null value
    falls back to the last observed value.  Returns base columns + K +
    ``temp_fK`` … ``blh_fK`` + ``dispersion_fK``."""
    ks = F.explode(F.array(*[F.lit(int(k)) for k in horizons])).alias("K")
    b = base.select("*", ks)
    b = b.withColumn("valid_ts", add_hours(hour_floor(ts), F.col("K")))
    # column names are case-insensitive in Spark: "blh" would clash with "BLH"
    fc = forecast.select(key, "valid_ts", *[F.col(f).alias(f"_fc_{f}") for f in FORECAST_FALLBACK])
    j = b.join(fc, [key, "valid_ts"], "left")
    cols = {f"{f}_fK": F.coalesce(F.col(f"_fc_{f}"), F.col(obs)) for f, obs in FORECAST_FALLBACK.items()}
    j = j.withColumns(cols).drop(*[f"_fc_{f}" for f in FORECAST_FALLBACK])
    return j.withColumn("dispersion_fK", F.col("wind_fK") * (F.lit(100) - F.col("humid_fK")))


def serving_frame(feat: DataFrame, forecast: DataFrame, horizons, key="series_id") -> DataFrame:
    """Newest feature row of every series × K, with the `_atK` features taken
    from the weather forecast (fallback: last observation) and the horizon
    columns of K, its extra lags among them; one row per (series, K)."""
    last = latest_row(feat, key)
    w = weather_at_horizon(last, forecast, horizons, key)
    atk = {v: F.col(f"{k}_fK") for k, v in FORECAST_TO_ATK.items()}
    atk["wind_dir_sin_atK"] = F.col("wind_dir_sin")
    atk["wind_dir_cos_atK"] = F.col("wind_dir_cos")
    lag_k = F.coalesce(*[F.when(F.col("K") == k, F.col(f"pm25_lagK__k{k}")) for k in horizons])
    return (w.withColumns(atk).withColumn("pm25_lagK", lag_k).withColumns(extra_lag_columns(w, horizons))
            .withColumn("horizon_norm", F.col("K") / F.lit(FT.HORIZON_NORM)))


def extra_lag_columns(rows: DataFrame, horizons) -> dict:
    """``pm25_lag_extra_n`` in the rows whose K has that lag, else null."""
    return {c: F.when(F.col("K").isin([k for k in horizons if n in FT.extra_lags(k)]), F.col(c))
            for n in sorted({n for k in horizons for n in FT.extra_lags(k)})
            if (c := f"pm25_lag_extra_{n}") in rows.columns}


def decode_predictions(scored: DataFrame, key="series_id", ts="ts") -> DataFrame:
    """M14 output: pm25 (2 dp, after AQI), aqi from the *unrounded* value
    (Q9), forecast_dt = base + K h."""
    pm = decode_target("prediction")
    return scored.select(key, F.col("K").cast("int").alias("K"),
                         round_dp(pm, 2).alias("pm25"),
                         pm25_to_aqi_simple(pm).alias("aqi"),
                         add_hours(ts, F.col("K")).alias("forecast_dt"),
                         F.col(ts).alias("base_ts"))


def score_horizons(serving: DataFrame, models: dict, key="series_id") -> DataFrame:
    """One batched ``transform`` per horizon; horizons without a model
    are skipped (no model at all: no rows)."""
    if not models:
        return decode_predictions(serving.where(F.lit(False)).withColumn("prediction", F.lit(0.0)), key)
    parts = []
    for k, (model, names) in sorted(models.items()):
        rows = serving.where(F.col("K") == k)
        rows = fill_zero(rows, [c for c in names if c in rows.columns])   # P7
        parts.append(decode_predictions(model.transform(rows), key))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def naive_forecast(df: DataFrame, horizons, value="PM25", key="series_id", ts="ts",
                   as_of=None) -> DataFrame:
    """Mean of the newest 24 rows + 0.1·K; AQI from the mean without
    the offset; base = ``as_of`` when given (the reference uses "now"), else
    the newest timestamp of the series."""
    m = mean_of_last_n(df, NAIVE_WINDOW, value, key, ts)
    mean = F.col(f"mean_last_{NAIVE_WINDOW}")
    base = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.col("last_ts")
    ks = F.explode(F.array(*[F.lit(int(k)) for k in horizons])).alias("K")
    return (m.select(key, mean.alias("mean"), base.alias("base_ts"), ks)
            .select(key, "K", round_dp(F.col("mean") + F.col("K") * F.lit(NAIVE_STEP), 2).alias("pm25"),
                    pm25_to_aqi_simple("mean").alias("aqi"),
                    add_hours("base_ts", F.col("K")).alias("forecast_dt"), "base_ts"))


# ---------------------------------------------------------------------------
# display slots
# ---------------------------------------------------------------------------


def slot_targets(bases: DataFrame, key="series_id") -> DataFrame:
    """16 target times per (series, base): midnight of the base day + 1/2
    days + 0,3,…,21 h; generated per row (no join)."""
    offs = [(d - 1, d * 24 + h) for d in SLOT_DAYS for h in SLOT_HOURS]
    arr = F.array(*[F.struct(F.lit(di).alias("day_index"), F.lit(o).alias("off")) for di, o in offs])
    t = bases.select(key, "base_ts", F.explode(arr).alias("_t"))
    return t.select(key, "base_ts", add_hours(day_floor("base_ts"), F.col("_t.off")).alias("target_dt"),
                    F.col("_t.day_index").alias("day_index"))


def _slot_columns(df: DataFrame) -> DataFrame:
    disp = display_formats("target_dt")
    disp["date_str"] = F.date_format(day_floor("target_dt"), "dd/MM")
    cat = aqi_category("aqi")
    return df.withColumns(disp).withColumns({
        "label": cat["label"], "css_class": cat["css_class"], "color": cat["color"]})


def slots_nearest(pred: DataFrame, key="series_id") -> DataFrame:
    """N4 (non-unique form): each target takes the prediction with the
    nearest forecast_dt, ties to the earlier one – an as-of join."""
    bases = pred.select(key, "base_ts").distinct()
    targets = slot_targets(bases, key)
    # one as-of group per (series, run): ≤ 16 targets + 17 predictions
    m = asof_nearest(targets, pred.select(key, "base_ts", "forecast_dt", "K", "pm25", "aqi"),
                     [key, "base_ts"], "target_dt", "forecast_dt", ["K", "pm25", "aqi"])
    return _slot_columns(m)


def slots_greedy(pred: DataFrame, key="series_id") -> DataFrame:
    """N4/X3 (reference form): targets in time order each take the nearest
    prediction whose K none before has taken (ties to the earlier forecast);
    when all are taken, the last prediction.

    A fold in the JVM: the predictions of a (series, base), 17 at most, are an
    array; ``aggregate`` walks the 16 targets with the Ks used and the choices
    made so far as its state."""
    offsets = [(d - 1, 24 * d + h) for d in SLOT_DAYS for h in SLOT_HOURS]
    kind = pred.select("forecast_dt", "K", "pm25", "aqi").schema
    one = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in kind)
    fields = [f.name for f in kind]
    runs = pred.groupBy(key, "base_ts").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("p"))
    targets = F.array(*[F.struct(F.lit(d).alias("day_index"), add_hours(day_floor("base_ts"), o).alias("target_dt")) for d, o in offsets])

    def take(state, target):
        free = F.filter(F.col("p"), lambda x: ~F.array_contains(state["used"], x["K"]))
        away = F.transform(free, lambda x, i: F.struct(
            F.abs(F.timestamp_diff("MICROSECOND", x["forecast_dt"], target["target_dt"])).alias("away"), i.alias("i"), x.alias("x")))
        best = F.when(F.size(free) > 0, F.array_min(away)["x"]).otherwise(F.element_at("p", -1))
        return F.struct(F.array_append(state["used"], best["K"]).alias("used"), F.array_append(state["made"], best).alias("made"))

    start = F.struct(F.expr(f"cast(array() as array<{kind['K'].dataType.simpleString()}>)").alias("used"),
                     F.expr(f"cast(array() as array<struct<{one}>>)").alias("made"))
    made = F.aggregate(targets, start, take, lambda s: s["made"])
    rows = runs.select(key, "base_ts", F.explode(F.arrays_zip(targets.alias("t"), made.alias("m"))).alias("s"))
    out = rows.select(key, "base_ts", F.col("s.t.target_dt").alias("target_dt"), F.col("s.t.day_index").alias("day_index"),
                      *(F.col("s.m")[f].alias(f) for f in ("K", "pm25", "aqi", "forecast_dt")))
    return _slot_columns(out)


def next_hour(slots: DataFrame, history: DataFrame, as_of: DataFrame, value="PM25",
              key="series_id", ts="ts", scores: DataFrame | None = None) -> DataFrame:
    """For each series the slot whose forecast hour equals the next
    hour after ``as_of`` (a per-series table with column ``as_of``).  Where none
    matches the hour is predicted: by the K=1 model's score (``scores``: series and
    ``pm25``), without one by the mean of the newest 8 rows; a series with fewer
    than 10 rows has no prediction and gets the error record."""
    nh = as_of.select(key, add_hours(hour_floor("as_of"), 1).alias("next_hour"))
    s = slots.select(key, hour_floor("forecast_dt").alias("next_hour"), "target_dt", "aqi", "pm25")
    hit = (nh.join(s, [key, "next_hour"], "left")
           .groupBy(key, "next_hour")
           .agg(F.min_by(F.struct("aqi", "pm25"), "target_dt").alias("hit")))
    tail = tail_n(history.select(key, ts, value), REALTIME_LEAST, key, (ts,))
    newest = F.slice(F.sort_array(F.collect_list(F.struct(ts, value)), asc=False), 1, REALTIME_WINDOW)      # at most REALTIME_LEAST rows
    fb = tail.groupBy(key).agg(F.count("*").alias("rows"), newest.alias("newest"))
    mean = F.aggregate(F.filter("newest", lambda r: r[value].isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda a, r: F.struct((a["s"] + r[value]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.try_divide(a["s"], a["n"]))
    fb = fb.where(F.col("rows") >= REALTIME_LEAST).select(key, mean.alias("mean"))
    j = hit.join(fb, key, "left")
    j = j.join(scores.select(key, F.col("pm25").alias("score")), key, "left") if scores is not None else j.withColumn("score", F.lit(None).cast("double"))
    guess = F.when(F.col("mean").isNotNull(), F.coalesce("score", "mean"))
    found = F.col("hit.aqi").isNotNull()
    aqi = F.when(found, F.col("hit.aqi")).otherwise(pm25_to_aqi_simple(guess))
    pm = F.when(found, F.col("hit.pm25")).otherwise(round_dp(guess, 2))
    source = (F.when(found, "slot").when(guess.isNull(), "error")
              .when(F.col("score").isNotNull(), "model").otherwise("realtime"))
    out = j.select(key, "next_hour", aqi.alias("aqi"), pm.alias("pm25"), source.alias("source"),
                   F.date_format("next_hour", "HH:00").alias("hour_str"))
    cat = aqi_category("aqi")
    err = F.col("source") == "error"
    # M16 error record when a series has neither a slot nor history
    return out.withColumns({
        "aqi": F.when(err, F.lit(0)).otherwise(F.col("aqi")),
        "pm25": F.when(err, F.lit(0.0)).otherwise(F.col("pm25")),
        "label": F.when(err, F.lit(NO_DATA[0])).otherwise(cat["label"]),
        "css_class": F.when(err, F.lit(NO_DATA[1])).otherwise(cat["css_class"]),
        "color": F.when(err, F.lit(NO_DATA[2])).otherwise(cat["color"])})


def slots_for_day(slots: DataFrame, day_index: int | None) -> DataFrame:
    """Slots of one display day (0 or 1); ``None`` keeps all."""
    return slots if day_index is None else slots.where(F.col("day_index") == day_index)


def slot_days(slots: DataFrame, key="series_id") -> DataFrame:
    """The sorted distinct display days per series with their date
    label and AQI range (one row per day tab)."""
    return (slots.groupBy(key, "base_ts", "day_index")
            .agg(F.min("date_str").alias("date_str"), F.min("aqi").alias("aqi_min"),
                 F.max("aqi").alias("aqi_max"), F.count("*").alias("n_slots")))


def slot_stats(slots: DataFrame, key="series_id") -> DataFrame:
    """A6 + L7: min/max/rounded-mean AQI, slot count and the first slot."""
    return slots.groupBy(key, "base_ts").agg(
        F.min("aqi").alias("aqi_min"), F.max("aqi").alias("aqi_max"),
        F.bround(F.avg("aqi"), 0).cast("int").alias("aqi_avg"),
        F.count("*").alias("n_slots"),
        F.min_by("display_dt", "target_dt").alias("current_display_dt"))


def run_tables(slots: DataFrame, created_at, key="series_id") -> tuple[DataFrame, DataFrame]:
    """Runs (one per series and base) and slots keyed by run_id; the
    stored AQI is derived on write with the strict variant (F10)."""
    run_id = F.xxhash64(key, "base_ts")
    runs = (slots.select(key, "base_ts").distinct()
            .select(run_id.alias("run_id"), key, "base_ts",
                    F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
                    F.lit("").alias("note")))
    rows = slots.select(run_id.alias("run_id"), "forecast_dt", "pm25",
                        pm25_to_aqi_strict("pm25").alias("aqi"))
    return runs, rows


# ---------------------------------------------------------------------------
# re-forecast trigger (T5)
# ---------------------------------------------------------------------------


class ForecastLedger:
    """Which series were forecast when, and the forecasts: tables in one folder.

    ``run`` scores the series that are due - never forecast, or last before
    midnight of ``as_of``'s day - found by a left-anti join with the ledger.  A
    run owns the folder of its ``as_of``: it writes its forecasts, then the ledger
    entry that makes them count, so a run that was killed between the two is
    repeated into the same folder and scores nothing twice."""

    def __init__(self, spark: SparkSession, path: str, key: str = "series_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        empty = spark.createDataFrame([], f"{key} string, generated_at timestamp_ntz")
        empty.write.mode("append").parquet(f"{self.path}/ledger/run=0")

    def due(self, series: DataFrame, as_of) -> DataFrame:
        """The series (one row each) that have no forecast of ``as_of``'s day."""
        midnight = day_floor(F.lit(as_of).cast("timestamp_ntz"))
        ledger = self.spark.read.parquet(f"{self.path}/ledger")
        fresh = (ledger.where(F.col("generated_at") >= midnight).where(F.col("generated_at") <= F.lit(as_of).cast("timestamp_ntz"))
                 .select(self.key).distinct())
        return series.join(fresh, self.key, "left_anti")

    def run(self, series: DataFrame, score: Callable[[DataFrame], DataFrame], as_of) -> DataFrame:
        """Forecasts that this run made: ``score`` of the due series."""
        name = f"run={''.join(c for c in str(as_of) if c.isdigit())}"
        due = self.due(series, as_of).withColumn("generated_at", F.lit(as_of).cast("timestamp_ntz"))
        made = f"{self.path}/forecasts/{name}"
        due = due.checkpoint()
        score(due.drop("generated_at")).write.mode("overwrite").parquet(made)
        due.select(self.key, "generated_at").write.mode("overwrite").parquet(f"{self.path}/ledger/{name}")
        return self.spark.read.parquet(made)
