"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query reads the driver tables (or data Spark derives from them) in full.
Column names match the oracle SQL in ``plans.oracle``.  Doubles produced by
floating aggregation or windows are snapped to a 2^-20 grid
(``numeric.snap``) so the order-insensitive value hash is stable across Spark
and DuckDB; reference-facing 1-decimal rollups are rounded exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazecast.functions import aqi as A
from hazecast.functions.calendar import hour_floor
from hazecast.functions.numeric import snap
from hazecast.operators import clean, features as FT, rollups
from hazecast.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed parameters of the stand-in data (events cover 2024-01-01 … 2024-01-30).
VAL_CUTOFF = "2024-01-20"
TEST_CUTOFF = "2024-01-25"
HISTORY_END = "2024-01-20"      # history snapshot: ts < this
DELTA_START = "2024-01-19"      # delta re-read from the last day: ts >= this
AS_OF = "2024-01-30 12:34:56"   # fixed "now" for freshness / future-data guards
TRIGGERS = ("2024-01-28 10:05:00", "2024-01-28 10:50:00", "2024-01-29 00:10:00")


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round_doubles(df: DataFrame, skip=()) -> DataFrame:
    """Snap every double column to the 2^-20 grid (oracle-facing output)."""
    cols = {f.name: snap(f.name) for f in df.schema.fields
            if isinstance(f.dataType, T.DoubleType) and f.name not in skip}
    return df.withColumns(cols) if cols else df


def long_target(spark, sf_dir) -> DataFrame:
    """Long form with the catalogue's target name."""
    return tables.events_long(spark, sf_dir).withColumnRenamed("value", "PM25")


LONG_ORDER = ("ts", "event_id")


def _long_features(spark, sf_dir, names):
    df = long_target(spark, sf_dir)
    out = FT.build_features(df, names, order=LONG_ORDER, impute=False)
    return round_doubles(out.select("series_id", "ts", "event_id", *names))


def _wide_features(spark, sf_dir, names, horizons=(), horizon_weather=True):
    obs = tables.observations(spark, sf_dir)
    return FT.build_features(obs, names, horizons=horizons, horizon_weather=horizon_weather)


# --- J1 ingest ----------------------------------------------------------------

@register("ingest_observations")
def ingest_observations(spark, sf_dir):
    """Weather × air quality merge (N1), six-pollutant AQI and dominant
    pollutant (F8), canonical columns; always executed, never read from the
    table that it lands for later jobs."""
    return round_doubles(tables.observations(spark, sf_dir, landed=False))


# --- J5 history rollups -----------------------------------------------------

@register("daily_rollup")
def daily_rollup(spark, sf_dir):
    """A4 over the stand-in panel (the flagship)."""
    return rollups.daily_rollup(tables.observations(spark, sf_dir))


@register("hourly_rollup")
def hourly_rollup(spark, sf_dir):
    """A5 over the long form: (series, date, hour) means of the raw events."""
    e = tables.events_long(spark, sf_dir).withColumnRenamed("value", "PM25")
    return rollups.hourly_rollup(e, fields=["PM25"])


@register("last_n_days")
def last_n_days(spark, sf_dir):
    """L3: newest 7 days of the daily rollup per series (long form)."""
    e = tables.events_long(spark, sf_dir).withColumnRenamed("value", "PM25")
    return rollups.last_n_days(rollups.daily_rollup(e, fields=["PM25"]), 7)


@register("monthly_yearly_rollup")
def monthly_yearly_rollup(spark, sf_dir):
    """A7 + A8: yearly avg/max/min and newest-24-months avg/max of the
    order-derived AQI, one table tagged by ``grain``."""
    d = tables.orders_daily_aqi(spark, sf_dir)
    y = rollups.yearly_rollup(d).select("series_id", F.lit("year").alias("grain"),
                                        F.col("year").alias("period"), "avg", "max", "min")
    m = rollups.monthly_rollup(d).select("series_id", F.lit("month").alias("grain"),
                                         F.col("month").alias("period"), "avg", "max",
                                         F.lit(None).cast("int").alias("min"))
    return y.unionByName(m)


@register("best_worst_month")
def best_worst_month(spark, sf_dir):
    """A9/L8 over all months of the order-derived AQI."""
    return rollups.best_worst_month(tables.orders_daily_aqi(spark, sf_dir))


@register("coverage")
def coverage(spark, sf_dir):
    """A10: first/last timestamp and row count per series."""
    return rollups.coverage(tables.events_long(spark, sf_dir))


# --- AQI family (F1–F13) ------------------------------------------------------

@register("aqi_subindices")
def aqi_subindices(spark, sf_dir):
    obs = tables.observations(spark, sf_dir)
    return obs.select("series_id", "ts", *[A.sub_index(p, p).alias(f"aqi_{p.lower()}")
                                           for p, _ in A.POLLUTANT_ORDER])


@register("aqi_overall")
def aqi_overall(spark, sf_dir):
    """F8: overall AQI and dominant pollutant of every panel hour."""
    return tables.observations(spark, sf_dir).select("series_id", "ts", "AQI", "AQI_Pollutant")


@register("aqi_simple")
def aqi_simple(spark, sf_dir):
    """F9/F10 over every event value read as a PM2.5 concentration."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "value")
    return e.select("event_id", A.pm25_to_aqi_simple("value").alias("aqi_simple"),
                    A.pm25_to_aqi_strict("value").alias("aqi_strict"),
                    A.aqi_pm25("value").alias("aqi_six"))


@register("aqi_category")
def aqi_category(spark, sf_dir):
    """Label / class / colour, dashboard palette, advice, tips and
    gauge position of the six-pollutant AQI of every panel hour."""
    obs = tables.observations(spark, sf_dir).select("series_id", "ts", "AQI")
    cat = A.aqi_category("AQI")
    return obs.select(
        "series_id", "ts", "AQI",
        cat["label"].alias("label"), cat["css_class"].alias("css_class"),
        cat["color"].alias("color"),
        A.dashboard_color("AQI").alias("dash_color"), A.dashboard_label("AQI").alias("dash_label"),
        A.advice("AQI").alias("advice"),
        F.array_join(A.health_tips("AQI"), " | ").alias("tips"),
        snap(A.gauge_percent("AQI")).alias("gauge_pct"))


# --- cleaning / imputation / merge / upsert ---------------------------------

@register("seasonal_impute")
def seasonal_impute(spark, sf_dir):
    """A2 + N2 + A3: BLH filled from the (hour, month) median, then the series
    median."""
    obs = tables.observations(spark, sf_dir).select("series_id", "ts", "BLH")
    out = clean.impute_seasonal(obs.withColumn("BLH_was_null", F.col("BLH").isNull()), "BLH")
    return round_doubles(out)


@register("global_median_fallback")
def global_median_fallback(spark, sf_dir):
    """A3: per-series median of the long-form target."""
    return clean.series_median(tables.events_long(spark, sf_dir), "value")


@register("merge_inner")
def merge_inner(spark, sf_dir):
    """Weather × air quality on (series, hour)."""
    m = tables.merge_weather_air(tables.weather_hourly(spark, sf_dir),
                                 tables.air_quality_hourly(spark, sf_dir))
    return round_doubles(m)


def _history(spark, sf_dir):
    """Hourly history snapshot up to HISTORY_END.  The bound is an hour
    boundary, so filtering raw ``ts`` before the hourly aggregation is
    equivalent and reaches the parquet scan (PushedFilters)."""
    e = tables.events_long(spark, sf_dir).where(F.col("ts") < F.lit(HISTORY_END).cast("timestamp_ntz"))
    h = (e.groupBy("series_id", hour_floor("ts").alias("ts"))
         .agg(F.avg("value").alias("value")))
    return h.select("series_id", "ts", "value", F.lit("history").alias("src"))


def _delta(spark, sf_dir):
    """Re-read from the last day: last value of each hour (a revision)."""
    e = tables.events_long(spark, sf_dir).where(F.col("ts") >= F.lit(DELTA_START).cast("timestamp_ntz"))
    e = clean.happened(e, AS_OF)
    return (e.groupBy("series_id", hour_floor("ts").alias("ts"))
            .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
            .withColumn("src", F.lit("delta")))


@register("upsert_keep_last")
def upsert_keep_last(spark, sf_dir):
    """U2 + T3: history ∪ delta, delta wins on duplicate hours."""
    return round_doubles(clean.upsert_keep_last(_history(spark, sf_dir), _delta(spark, sf_dir)))


@register("dedupe_keep_first")
def dedupe_keep_first(spark, sf_dir):
    """Archive ∪ recent, archive wins on duplicate hours."""
    return round_doubles(clean.dedupe_keep_first(_history(spark, sf_dir), _delta(spark, sf_dir)))


@register("union_series")
def union_series(spark, sf_dir):
    """Per-source union with differing columns (missing → null)."""
    a = tables.hourly_long(spark, sf_dir).select("series_id", "ts", "value", "n")
    b = (tables.orders_daily_aqi(spark, sf_dir)
         .select(F.concat(F.lit("orders:"), "series_id").alias("series_id"), "ts", "AQI"))
    u = clean.union_all([a, b])
    return round_doubles(u.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_value"),
        F.count("AQI").alias("n_aqi"), F.sum("n").alias("n_events"),
        F.avg("value").alias("mean_value"), F.avg("AQI").alias("mean_aqi")))


@register("null_report")
def null_report(spark, sf_dir):
    """Rows and null counts per column of the panel."""
    obs = tables.observations(spark, sf_dir)
    return clean.null_report(obs, ["AQI", "PM25", "PM10", "NO2", "O3", "CO", "SO2", "BLH"])


# --- window features (W1–W15, F14–F20) --------------------------------------

@register("lag_features")
def lag_features(spark, sf_dir):
    """Target lags over the five long-form series."""
    return _long_features(spark, sf_dir, [f"pm25_lag{n}" for n in FT.TARGET_LAGS])


@register("serving_features")
def serving_features(spark, sf_dir):
    """W13 + W14: newest row of the five long-form series x 17 horizons with
    the population stds and the extra lags of its horizon; of the history only
    the dates that the look-back reaches are read."""
    from hazecast.operators import forecast as FC
    from hazecast.sources.history import read_tail
    names = FT.SERVING_NAMES
    tail = read_tail(spark, tables.landed_history(spark, sf_dir), FT.look_back(names) + 1).withColumnRenamed("value", "PM25")
    feat = FT.build_features(tail, names, order=LONG_ORDER, impute=False)
    last = rollups.latest_row(round_doubles(feat.select("series_id", "ts", "event_id", *names)))
    rows = last.select("*", F.explode(F.array(*[F.lit(k) for k in FT.HORIZONS])).alias("K"))
    return rows.withColumns(FC.extra_lag_columns(rows, FT.HORIZONS))


ROLLING = ["pm25_roll8_mean", "pm25_roll8_std", "pm25_roll8_max", "pm25_roll8_min",
           "pm25_roll24_mean", "pm25_roll24_std", "pm25_roll24_max",
           "pm25_roll48_mean", "pm25_roll48_std", "pm25_roll48_max",
           "pm25_roll72_mean", "pm25_roll168_mean", "pm25_roll168_std"]


@register("rolling_features")
def rolling_features(spark, sf_dir):
    """Trailing mean/std/max/min frames."""
    return _long_features(spark, sf_dir, ROLLING)


@register("rolling_long_mean")
def rolling_long_mean(spark, sf_dir):
    """8 760-row trailing mean via prefix sums, and the level ratio."""
    return _long_features(spark, sf_dir, ["pm25_roll365_mean", "pm25_level_ratio"])


ANOMALY = ["pm25_current", "pm25_diff_1_6", "pm25_diff_6_24", "pm25_accel", "pm25_trend_24h",
           "pm25_anomaly_score", "is_spike", "pm25_norm", "pm25_range_24"]


@register("anomaly_features")
def anomaly_features(spark, sf_dir):
    """Differences, acceleration, z-score, spike flag, ratios."""
    return _long_features(spark, sf_dir, ANOMALY)


RAIN = ["precip_lag1", "precip_lag6", "precip_lag24", "rain_acc_6h", "rain_acc_12h",
        "rain_acc_24h", "rain_washout", "wind_rainy_interact", "blh_rainy_interact",
        "precip_trend"]


@register("rain_features")
def rain_features(spark, sf_dir):
    """W11 + rain interactions on the panel."""
    out = _wide_features(spark, sf_dir, RAIN)
    return round_doubles(out.select("series_id", "ts", *RAIN))


@register("hours_since_event")
def hours_since_event(spark, sf_dir):
    """Hours since rain, bucketed from the lagged rain flags."""
    out = _wide_features(spark, sf_dir, ["hours_since_rain"])
    return out.select("series_id", "ts", "Precipitation", "hours_since_rain")


CALENDAR_OUT = FT.CALENDAR + ["wind_dir_sin", "wind_dir_cos"]


@register("calendar_features")
def calendar_features(spark, sf_dir):
    """Calendar parts, flags and cyclic encodings."""
    obs = tables.observations(spark, sf_dir)
    out = FT.add_row_local(obs)
    return round_doubles(out.select("series_id", "ts", *CALENDAR_OUT))


COVARIATE = ["temperature_lag1", "wind_speed_lag1", "relative_humidity_lag1", "pressure_lag1",
             "blh_lag1", "blh_lag6", "blh_roll24_mean", "clouds_lag1",
             "co_lag1", "co_lag6", "no2_lag1", "no2_lag6", "so2_lag1",
             "pm10_lag1", "pm10_lag6", "o3_lag1",
             "wind_x_humidity", "temp_x_humidity", "blh_x_wind", "pm10_pm25_ratio",
             "dispersion_idx", "blh_pm25_interact"]


@register("covariate_features")
def covariate_features(spark, sf_dir):
    """W2/W3 + F19/F20: weather and pollutant lags, interactions (BLH imputed)."""
    out = _wide_features(spark, sf_dir, COVARIATE)
    return round_doubles(out.select("series_id", "ts", *COVARIATE))


HL_HORIZONS = FT.HORIZONS


@register("horizon_labels")
def horizon_labels(spark, sf_dir):
    """Per-K label (lead, log1p), pm25_lagK, weather at +K, as a long
    table (series, ts, K)."""
    feat = _wide_features(spark, sf_dir, ["pm25_current"], horizons=HL_HORIZONS)
    lng = FT.horizon_long(feat, HL_HORIZONS, keep=["series_id", "ts", "pm25_current"])
    return round_doubles(lng)


@register("drop_incomplete")
def drop_incomplete(spark, sf_dir):
    """P6 + P9 + A1: rows left per horizon and split after dropping the rows
    that lack a feature of their horizon's set, in one pass over (row, K)."""
    feat = _wide_features(spark, sf_dir, FT.ALL_NAMES, horizons=FT.HORIZONS)
    lng = FT.horizon_long(feat, FT.HORIZONS)
    sets: dict[tuple, list[int]] = {}
    for k in FT.HORIZONS:
        names = tuple(c for c in FT.horizon_features(k) if c in lng.columns)
        sets.setdefault(names, []).append(k)
    keep = F.lit(False)
    for names, ks in sets.items():
        keep = keep | (F.col("K").isin(ks) & clean.complete([*names, "label", "label_raw"]))
    return (lng.where(keep).withColumn("split", clean.split_label(VAL_CUTOFF, TEST_CUTOFF))
            .groupBy("K", "split").agg(F.count("*").alias("n_rows"),
                                       snap(F.avg("label_raw")).alias("mean_label")))


@register("time_split_counts")
def time_split_counts(spark, sf_dir):
    """P9 + A1: rows per chronological split and series (long form)."""
    e = tables.events_long(spark, sf_dir)
    return (e.withColumn("split", clean.split_label(VAL_CUTOFF, TEST_CUTOFF))
            .groupBy("series_id", "split").agg(F.count("*").alias("n_rows")))


@register("embargo_splits")
def embargo_splits(spark, sf_dir):
    """P9 with an embargo of K hours: rows per horizon and split of the long
    form, those whose label crosses a cut-off set apart."""
    e = tables.events_long(spark, sf_dir).select("ts", F.explode(F.array(*[F.lit(k) for k in FT.HORIZONS])).alias("K"))
    return (e.groupBy("K", clean.split_label(VAL_CUTOFF, TEST_CUTOFF, embargo="K").alias("split")).agg(F.count("*").alias("n_rows")))


@register("hourly_grid_lags")
def hourly_grid_lags(spark, sf_dir):
    """Lags in hours: the hourly means of the long form on a grid without gaps,
    whose row offsets are hours."""
    from hazecast.operators.windows import series_windows
    grid = clean.hourly_grid(tables.hourly_long(spark, sf_dir).select("series_id", "ts", "value"))
    out = series_windows(grid, lambda w, by: {f"lag{n}h": F.lag("value", n).over(w) for n in (1, 6, 24)}, back=24)
    return round_doubles(out)


@register("wind_lag_features")
def wind_lag_features(spark, sf_dir):
    """Wind-direction lag pairs of the serving side on the panel."""
    from hazecast.operators.windows import series_windows
    obs = tables.observations(spark, sf_dir).select("series_id", "ts", "Wind_Direction")
    out = series_windows(obs, lambda w, by: FT.wind_lag_columns(w), back=max(FT.WIND_LAGS))
    return round_doubles(out.drop("Wind_Direction"))


# --- selection / evaluation (M7, M8, A12–A16, N6, M18) ----------------------

LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@register("spearman_target")
def spearman_target(spark, sf_dir):
    """M7: |Spearman| of each numeric lineitem column with the target
    l_extendedprice (ranks with averaged ties, computed on the executors)."""
    from hazecast.operators.selection import rank_correlation
    li = tables.table(spark, sf_dir, "lineitem")
    feats = [c for c in LINEITEM_NUM if c != "l_extendedprice"]
    return round_doubles(rank_correlation(li, feats, "l_extendedprice"))


@register("pearson_matrix")
def pearson_matrix(spark, sf_dir):
    """M8 input: Pearson correlation of every pair of numeric lineitem columns."""
    from hazecast.operators.selection import correlation_frame, corr_matrix
    li = tables.table(spark, sf_dir, "lineitem")
    return round_doubles(correlation_frame(spark, LINEITEM_NUM, corr_matrix(li, LINEITEM_NUM)))


@register("prune_features")
def prune_features(spark, sf_dir):
    """M7 + M8 on the K=1 training slice of the panel: which features pass the
    target-correlation stage and which survive redundancy pruning.

    The selection is reported, not the correlation values: rolling sums such
    as ``rain_acc_24h`` hold many values that tie exactly in real arithmetic
    but differ by an ulp depending on summation order, which moves average
    ranks in the last digits between engines.  The correlation operators are
    checked value by value in ``spearman_target`` and ``pearson_matrix``."""
    from hazecast.operators.selection import prune
    feat = _wide_features(spark, sf_dir, FT.ALL_NAMES, horizons=[1])
    k1 = FT.horizon_frame(feat, 1)
    names = [c for c in FT.horizon_features(1) if c in k1.columns]
    k1 = clean.drop_incomplete(k1, names + ["label", "label_raw"])
    from hazecast.operators.models import MIN_TRAIN_ROWS
    train = k1.where(clean.split_label(VAL_CUTOFF, TEST_CUTOFF) == "train")
    schema = "feature string, kept boolean, passed_target boolean"
    if train.count() < MIN_TRAIN_ROWS:            # P15: the horizon is skipped
        return spark.createDataFrame([], schema)
    kept, info = prune(train, names)
    rows = [(n, n in kept, n in info["stage1"]) for n in names]
    return spark.createDataFrame(rows, schema)


@register("prune_horizons")
def prune_horizons(spark, sf_dir):
    """M7 + M8 on the training slice of every horizon; the outcome is the one
    that the model queries of the session train with."""
    from hazecast.operators import models as M
    rows = M.prune_horizons(_model_features(spark, sf_dir), FT.HORIZONS, (VAL_CUTOFF, TEST_CUTOFF),
                            pruned=_pruned(spark, sf_dir))
    return spark.createDataFrame(rows, "K int, feature string, kept boolean, passed_target boolean")


def _persistence(spark, sf_dir):
    from hazecast.operators import evaluate as EV
    feat = _wide_features(spark, sf_dir, ["pm25_current"], horizons=FT.HORIZONS, horizon_weather=False)
    return EV.metrics_by_split(EV.persistence_predictions(feat, FT.HORIZONS, VAL_CUTOFF, TEST_CUTOFF))


@register("horizon_metrics")
def horizon_metrics(spark, sf_dir):
    """A12 + A13 + M11 + F29: persistence-baseline RMSE per split, gap and
    test R² for every horizon, with traffic lights."""
    from hazecast.functions.numeric import strategy_label
    from hazecast.operators import evaluate as EV
    res = EV.with_flags(_persistence(spark, sf_dir)).withColumn("strategy", strategy_label("K"))
    return round_doubles(res)


@register("result_sinks")
def result_sinks(spark, sf_dir):
    """S10/S11 + L6: the persistence results sorted by K, written as CSV, JSON and
    parquet and read back; ``place`` is the row's place in the file."""
    from hazecast.session import shared_dir
    from hazecast.sources import payloads as PL
    res = round_doubles(_persistence(spark, sf_dir)).select("K", "rmse_test", "gap").orderBy("K").coalesce(1)
    schema, back = "K int, rmse_test double, gap double", []
    for fmt in ("csv", "json", "parquet"):
        path = shared_dir(spark, f"results-{fmt}")
        PL.write_table(res, path, fmt)
        rows = getattr(spark.read.schema(schema).option("header", True), fmt)(path)
        back.append(rows.select(F.lit(fmt).alias("fmt"), "*", F.monotonically_increasing_id().alias("place")))
    return clean.union_all(back)


@register("eval_by_horizon_band")
def eval_by_horizon_band(spark, sf_dir):
    """A14 + A15: overall and band means (ROLLUP) of the per-K metrics."""
    from hazecast.operators import evaluate as EV
    return round_doubles(EV.band_summary(_persistence(spark, sf_dir)))


@register("leaderboard")
def leaderboard(spark, sf_dir):
    """N6 + F30 + A16 + M18: per-K deltas against the published versions and
    win counts."""
    from hazecast.operators import evaluate as EV
    return round_doubles(EV.leaderboard(_persistence(spark, sf_dir), spark))


_TRAINED: dict = {}


def _model_features(spark, sf_dir):
    """One checkpointed feature table for all families and the pruning."""
    from hazecast.operators import models as M
    key = (spark.sparkContext.applicationId, sf_dir, "features")
    if key not in _TRAINED:
        _TRAINED[key] = M.persist_shared(_wide_features(spark, sf_dir, FT.ALL_NAMES + FT.SERVING_NAMES,
                                                       horizons=FT.HORIZONS))
    return _TRAINED[key]


def _pruned(spark, sf_dir):
    return _TRAINED.setdefault((spark.sparkContext.applicationId, sf_dir, "pruned"), {})


def _trained(spark, sf_dir, family):
    """Train one pipeline per horizon on the panel's training split.
    The feature table and the outcome of pruning are kept for the session and
    shared by the families.  Fitted models are kept in the shared folder by
    input and parameters: the forecast and the evaluation of a family share one
    training run, also across processes, and a stopped run resumes."""
    from hazecast.operators import models as M
    from hazecast.session import model_folder
    feat = _model_features(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, family)
    if key not in _TRAINED:
        store = M.ModelStore(spark, model_folder(spark), M.fingerprint(round_doubles(feat)))
        res = M.train_horizons(feat, FT.HORIZONS, family, cutoffs=(VAL_CUTOFF, TEST_CUTOFF),
                               pruned=_pruned(spark, sf_dir), store=store)
        _TRAINED[key] = (feat, res)
    return _TRAINED[key]


def _train_forecast(spark, sf_dir, family):
    """Score the newest row of every series for every trained horizon."""
    from hazecast.operators import forecast as FC
    feat, res = _trained(spark, sf_dir, family)
    serving = FC.serving_frame(feat, tables.weather_forecast(spark, sf_dir), FT.HORIZONS)
    return FC.score_horizons(serving, {r.k: (r.model, r.features) for r in res})


def _train_eval(spark, sf_dir, family):
    """M11 + F29: rmse per split, gap and test R² of every trained horizon."""
    from hazecast.operators import evaluate as EV
    from hazecast.operators import models as M
    _, res = _trained(spark, sf_dir, family)
    return round_doubles(EV.with_flags(M.evaluate(res, spark)))


@register("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    return _train_forecast(spark, sf_dir, "gbt")


@register("rf_forecast")
def rf_forecast(spark, sf_dir):
    return _train_forecast(spark, sf_dir, "rf")


@register("ridge_forecast")
def ridge_forecast(spark, sf_dir):
    return _train_forecast(spark, sf_dir, "linear")


@register("gbt_eval")
def gbt_eval(spark, sf_dir):
    return _train_eval(spark, sf_dir, "gbt")


@register("rf_eval")
def rf_eval(spark, sf_dir):
    return _train_eval(spark, sf_dir, "rf")


@register("ridge_eval")
def ridge_eval(spark, sf_dir):
    return _train_eval(spark, sf_dir, "linear")


# --- serving (L2, L4, T1, A11, M15, N3, N4, N5, A6, S4–S9) -------------------

@register("latest_row")
def latest_row(spark, sf_dir):
    """L4: newest event per series."""
    return rollups.latest_row(tables.events_long(spark, sf_dir))


@register("tail_n")
def tail_n(spark, sf_dir):
    """L2: newest 400 rows per series (WindowGroupLimit)."""
    return rollups.tail_n(tables.events_long(spark, sf_dir), 400, order=("ts", "event_id"))


@register("freshness_gap")
def freshness_gap(spark, sf_dir):
    """Gap between each series' last hour and floor(as_of) − 1 h."""
    return round_doubles(clean.freshness(tables.hourly_long(spark, sf_dir), AS_OF))


def _naive(spark, sf_dir, as_of=None):
    from hazecast.operators import forecast as FC
    h = tables.hourly_long(spark, sf_dir)
    return FC.naive_forecast(h, FT.HORIZONS, value="value", as_of=as_of)


@register("naive_forecast")
def naive_forecast(spark, sf_dir):
    """Mean of the last 24 hourly values + 0.1·K, base = as_of."""
    return _naive(spark, sf_dir, AS_OF)


@register("weather_at_horizon")
def weather_at_horizon(spark, sf_dir):
    """Newest panel row at or before as_of × 17 horizons, weather
    from the forecast table at +K h with fallback to the last observation."""
    from hazecast.operators import forecast as FC
    obs = clean.happened(tables.observations(spark, sf_dir), AS_OF)
    base = rollups.latest_row(obs.select("series_id", "ts", "Temperature", "Wind_Speed",
                                         "Relative_Humidity", "Pressure", "Precipitation", "BLH"))
    w = FC.weather_at_horizon(base, tables.weather_forecast(spark, sf_dir), FT.HORIZONS)
    return round_doubles(w.select("series_id", "ts", "K", "valid_ts", "temp_fK", "wind_fK", "humid_fK",
                                  "press_fK", "precip_fK", "blh_fK", "dispersion_fK"))


SLOT_COLS = ["series_id", "base_ts", "target_dt", "day_index", "K", "pm25", "aqi", "forecast_dt",
             "display_dt", "display_full", "hour_str", "date_str", "label", "css_class", "color"]


@register("slots_nearest")
def slots_nearest(spark, sf_dir):
    """N4 (nearest form) over naive predictions based at each series' last hour."""
    from hazecast.operators import forecast as FC
    return FC.slots_nearest(_naive(spark, sf_dir)).select(*SLOT_COLS)


@register("slots_greedy")
def slots_greedy(spark, sf_dir):
    """N4/X3 (greedy unique form, grouped-map pandas)."""
    from hazecast.operators import forecast as FC
    return FC.slots_greedy(_naive(spark, sf_dir)).select(*SLOT_COLS)


@register("slot_stats")
def slot_stats(spark, sf_dir):
    """A6 + L7 over the nearest slots."""
    from hazecast.operators import forecast as FC
    return FC.slot_stats(FC.slots_nearest(_naive(spark, sf_dir)))


@register("slot_days")
def slot_days(spark, sf_dir):
    """P14 + L9: per series the display days (day 0 and day 1 tabs) of the
    nearest slots with date label and AQI range."""
    from hazecast.operators import forecast as FC
    slots = FC.slots_nearest(_naive(spark, sf_dir))
    return FC.slot_days(FC.slots_for_day(slots, None))


@register("day_tab_slots")
def day_tab_slots(spark, sf_dir):
    """The slots of the day 0 tab and of the day 1 tab."""
    from hazecast.operators import forecast as FC
    slots = FC.slots_nearest(_naive(spark, sf_dir))
    tabs = [FC.slots_for_day(slots, d).select(F.lit(d).alias("tab"), "series_id", "target_dt", "K", "pm25", "aqi", "hour_str")
            for d in (0, 1)]
    return tabs[0].unionByName(tabs[1])


@register("next_hour_paths")
def next_hour_paths(spark, sf_dir):
    """N5/M16, all four ways to the next hour: a slot, the K=1 score, the mean of
    the newest 8, the error record of a short series.  The K=1 score of this
    query is persistence (SQL can tell it); ``score_horizons`` gives the same
    columns for a trained model."""
    from hazecast.operators import forecast as FC
    h = tables.hourly_long(spark, sf_dir)
    short = h.where("series_id = 'error'").withColumn("series_id", F.lit("short"))
    short = short.join(rollups.tail_n(short, 9).select("series_id", "ts"), ["series_id", "ts"])
    h = h.unionByName(short)
    slots = FC.slots_nearest(_naive(spark, sf_dir)).where("series_id = 'click'")
    slots = slots.withColumn("forecast_dt", F.expr("base_ts + make_dt_interval(0, 1)"))
    as_of = h.groupBy("series_id").agg(F.max("ts").alias("as_of"))
    last = rollups.latest_row(h.select("series_id", "ts", "value")).where("series_id in ('purchase', 'view', 'short')")
    return round_doubles(FC.next_hour(slots, h, as_of, value="value", scores=last.select("series_id", F.col("value").alias("pm25"))))


@register("forecast_trigger")
def forecast_trigger(spark, sf_dir):
    """T5: three calls of the trigger, two within an hour and one on the next
    day; a call scores the series without a forecast of its day, once."""
    from hazecast.operators import forecast as FC
    from hazecast.session import shared_dir
    h = tables.hourly_long(spark, sf_dir)
    ledger = FC.ForecastLedger(spark, shared_dir(spark, "ledger"))
    made = []
    for as_of in TRIGGERS:
        past = clean.happened(h, as_of)
        out = ledger.run(past.select("series_id").distinct(),
                         lambda due, past=past, as_of=as_of: FC.naive_forecast(past.join(due, "series_id"), FT.HORIZONS, value="value", as_of=as_of), as_of)
        made.append(out.select(F.lit(as_of).cast("timestamp_ntz").alias("as_of"), "series_id", "K", "pm25", "aqi", "forecast_dt"))
    return clean.union_all(made)


@register("next_hour_lookup")
def next_hour_lookup(spark, sf_dir):
    """Slot for the hour after each series' last observation, else
    the mean of the newest 8 hourly values."""
    from hazecast.operators import forecast as FC
    h = tables.hourly_long(spark, sf_dir)
    slots = FC.slots_nearest(_naive(spark, sf_dir))
    as_of = h.groupBy("series_id").agg(F.max("ts").alias("as_of"))
    return round_doubles(FC.next_hour(slots, h, as_of, value="value"))


@register("forecast_document")
def forecast_document(spark, sf_dir):
    """S9 → S6: write forecast documents (slots + raw predictions) as JSON to
    the shared folder and read the slots back."""
    from hazecast.operators import forecast as FC
    from hazecast.session import shared_dir
    from hazecast.sources import payloads as PL
    pred = _naive(spark, sf_dir)
    slots = FC.slots_nearest(pred)
    path = shared_dir(spark, "forecast-docs")
    PL.write_documents(PL.forecast_documents(slots, pred, AS_OF), path)
    back = PL.read_documents(spark, path)
    return back.select("series_id", F.col("target_dt").cast("timestamp_ntz").alias("target_dt"),
                       F.col("K").cast("int").alias("K"), "pm25", F.col("aqi").cast("int").alias("aqi"), "forecast_dt",
                       "display_dt", "label")


@register("forecast_payload")
def forecast_payload(spark, sf_dir):
    """Weather-forecast payloads (parallel arrays per series and day) →
    (series_id, valid_ts, temp, humid, precip, wind, press, blh)."""
    from hazecast.schema import FORECAST_RENAME
    from hazecast.sources import payloads as PL
    fc = tables.weather_forecast(spark, sf_dir).withColumnRenamed("valid_ts", "ts")
    pl = PL.build_payloads(fc, FORECAST_RENAME)
    return round_doubles(PL.forecast_rows(pl))


@register("payload_explode")
def payload_explode(spark, sf_dir):
    """Hourly panel → API payloads (one per series and day, parallel
    arrays) landed as JSON files → scanned with the explicit payload schema
    → rows again, renamed to the canonical names."""
    from hazecast.schema import AIR_QUALITY_RENAME
    from hazecast.sources import payloads as PL
    air = tables.air_quality_hourly(spark, sf_dir).select(
        "series_id", "ts", "PM25", "PM10", "NO2", "O3", "CO", "SO2")
    from hazecast.session import shared_dir
    pl = PL.build_payloads(air, AIR_QUALITY_RENAME)
    path = shared_dir(spark, "aq-payloads")
    pl.write.mode("overwrite").json(path)                    # landed payload files
    landed = PL.read_payloads(spark, path, list(AIR_QUALITY_RENAME))
    back = PL.explode_payload(landed, AIR_QUALITY_RENAME)
    return round_doubles(back.select("series_id", "ts", "PM25", "PM10", "NO2", "O3", "CO", "SO2"))


# --- streaming (T2, T4) -----------------------------------------------------

@register("stream_upsert")
def stream_upsert(spark, sf_dir):
    """Micro-batch upsert of streamed events onto the hourly history."""
    from hazecast.streaming.incremental import stream_upsert as run
    out = run(spark, sf_dir, _history(spark, sf_dir).drop("src"), DELTA_START, AS_OF)
    return round_doubles(out)


@register("stream_hourly_rollup")
def stream_hourly_rollup(spark, sf_dir):
    """T4: 1-hour tumbling windows per series, partials merged on read."""
    from hazecast.streaming.incremental import stream_hourly_rollup as run
    return round_doubles(run(spark, sf_dir))


@register("stream_daily_rollup")
def stream_daily_rollup(spark, sf_dir):
    """T4: the daily rollup maintained by the same stream (1-day windows)."""
    from hazecast.streaming.incremental import stream_hourly_rollup as run
    return round_doubles(run(spark, sf_dir, window="1 day"))


# --- sources / sinks / tables (P4b, S1, S8, S17, N7, F28) --------------------

LOCAL_TZ = "America/Sao_Paulo"   # DST started at local midnight in 1995–2001


@register("localize_invalid")
def localize_invalid(spark, sf_dir):
    """Wall-clock ship dates that do not exist (or are ambiguous) in the
    station's zone become null; per date the row count and the flag."""
    from hazecast.functions.calendar import localize_invalid as invalid
    li = tables.table(spark, sf_dir, "lineitem").select("l_shipdate")
    return (li.groupBy("l_shipdate").agg(F.count("*").alias("n_rows"))
            .withColumn("invalid", invalid("l_shipdate", LOCAL_TZ))
            .where(F.col("invalid")))


@register("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """S8 → S1: write the panel as date-partitioned CSV with a header to the
    shared folder and scan it back with the explicit observation schema."""
    from hazecast.session import shared_dir
    from hazecast.sources import payloads as PL
    obs = tables.observations(spark, sf_dir)
    path = shared_dir(spark, "obs-csv")
    PL.write_observations(obs.withColumnRenamed("ts", "Local_Time"), path, fmt="csv")
    back = PL.read_observations_csv(spark, path)
    return round_doubles(back)


@register("run_slot_tables")
def run_slot_tables(spark, sf_dir):
    """S17 + N7: forecast runs and their slots (AQI derived on write with the
    strict variant), joined back on run_id; F28 staleness against as_of."""
    from hazecast.functions.calendar import stale
    from hazecast.operators import forecast as FC
    slots = FC.slots_nearest(_naive(spark, sf_dir))
    runs, rows = FC.run_tables(slots, AS_OF)
    j = runs.join(rows, "run_id")
    return j.select("series_id", "base_ts", "created_at", "forecast_dt", "pm25", "aqi",
                    stale("created_at", F.lit(AS_OF).cast("timestamp_ntz")).alias("stale"))


@register("csv_bom_roundtrip")
def csv_bom_roundtrip(spark, sf_dir):
    """S8 with the byte-order mark that the history file has, read back by S1;
    whether the first bytes of the written files are the mark."""
    from hazecast.session import shared_dir
    from hazecast.sources import payloads as PL
    obs = tables.observations(spark, sf_dir).select("ts", "series_id", "PM25", "Temperature")
    path = shared_dir(spark, "obs-bom")
    PL.write_observations(obs.withColumnRenamed("ts", "Local_Time"), path, fmt="csv", bom=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    marked = files.agg(F.bool_and(F.hex(F.substring("content", 1, 3)) == "EFBBBF").alias("has_bom"))
    return round_doubles(PL.read_observations_csv(spark, path)).crossJoin(F.broadcast(marked))          # one row


@register("ingest_localized")
def ingest_localized(spark, sf_dir):
    """P4b inside ingest: order days as wall-clock hours of a station, localised
    to its zone before the index is derived; hours that its clock skips or
    repeats have no local time.  Rows per series, and how many lost theirs."""
    from hazecast.functions.calendar import localize
    o = tables.orders_daily_aqi(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    local = o.withColumn("Local_Time", localize("ts", LOCAL_TZ))
    return local.groupBy("series_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("Local_Time").isNull()).alias("n_invalid"),
                                          F.min("Local_Time").alias("first_local"), F.max("Local_Time").alias("last_local"))


@register("payload_quarantine")
def payload_quarantine(spark, sf_dir):
    """U1/U3/S4 with bad sources: hourly payloads of two sources, one a day, some
    cut off in the middle, some with an array too short, and a third source
    that is not there; payloads and hours served, and refused by reason."""
    from hazecast.schema import AIR_QUALITY_RENAME
    from hazecast.session import shared_dir
    from hazecast.sources import payloads as PL
    air = tables.air_quality_hourly(spark, sf_dir).select("series_id", "ts", "PM25", "PM10", "NO2", "O3", "CO", "SO2")
    pl = PL.build_payloads(air, AIR_QUALITY_RENAME).withColumn("day", F.dayofmonth(F.to_timestamp_ntz(F.col("hourly.time")[0])))
    short = F.col("hourly").withField("pm10", F.slice("hourly.pm10", 2, 100))
    pl = pl.withColumn("hourly", F.when(F.col("day") % 7 == 3, short).otherwise(F.col("hourly")))
    text = F.to_json(F.struct("series_id", "hourly"))
    text = F.when(F.col("day") % 11 == 5, F.substring(text, 1, 60)).otherwise(text)
    base = shared_dir(spark, "screened")
    for name, rest in (("archive", 0), ("recent", 1)):
        pl.where(F.col("day") % 2 == rest).select(text.alias("value")).write.text(f"{base}/{name}")
    good, bad = PL.screened_payloads(spark, {n: f"{base}/{n}" for n in ("archive", "recent", "gone")}, list(AIR_QUALITY_RENAME))
    served = good.select("source", F.lit("served").alias("reason"), F.size("hourly.time").alias("hours"))
    return (served.unionByName(bad.select("source", "reason", F.lit(0).alias("hours")))
            .groupBy("source", "reason").agg(F.count("*").alias("n_payloads"), F.sum("hours").alias("n_hours")))


# --- models: what SQL can tell about them -----------------------------------

FAMILIES = ("gbt", "rf", "linear")


def _forecast_checks(spark, sf_dir, family):
    """The grid of series x K, its times, and whether each index is that of its
    concentration."""
    out = _train_forecast(spark, sf_dir, family)
    # pm25 is rounded after the index was taken of the value: of the two ends of its rounding
    low, high = A.pm25_to_aqi_simple(F.greatest(F.col("pm25") - 0.005, F.lit(0.0))), A.pm25_to_aqi_simple(F.col("pm25") + 0.005)
    return out.select(F.lit(family).alias("family"), "series_id", "K", "base_ts", "forecast_dt",
                      (F.col("aqi").between(low, high) & (F.col("pm25") >= 0)).alias("aqi_ok"))


def _eval_checks(spark, sf_dir, family):
    """Rows that each horizon's model is judged on by split, whether the gap is
    the difference of the errors, and whether the flags follow their limits."""
    from hazecast.operators import evaluate as EV
    from hazecast.operators import models as M
    _, res = _trained(spark, sf_dir, family)
    m = EV.with_flags(M.evaluate(res, spark))
    gap_ok = F.abs(F.col("gap") - (F.col("rmse_val") - F.col("rmse_train"))) < 1e-9
    flag_ok = F.col("gap_flag") == F.when(F.col("gap") < 6, "good").when(F.col("gap") < 10, "fair").otherwise("poor")
    return m.select(F.lit(family).alias("family"), "K", gap_ok.alias("gap_ok"), flag_ok.alias("flag_ok"),
                    (F.col("n_features") >= 5).alias("enough_features"))


@register("ridge_forecast_checks")
def ridge_forecast_checks(spark, sf_dir):
    return _forecast_checks(spark, sf_dir, "linear")


@register("rf_forecast_checks")
def rf_forecast_checks(spark, sf_dir):
    return _forecast_checks(spark, sf_dir, "rf")


@register("gbt_forecast_checks")
def gbt_forecast_checks(spark, sf_dir):
    return _forecast_checks(spark, sf_dir, "gbt")


@register("ridge_eval_checks")
def ridge_eval_checks(spark, sf_dir):
    return _eval_checks(spark, sf_dir, "linear")


@register("rf_eval_checks")
def rf_eval_checks(spark, sf_dir):
    return _eval_checks(spark, sf_dir, "rf")


@register("gbt_eval_checks")
def gbt_eval_checks(spark, sf_dir):
    return _eval_checks(spark, sf_dir, "gbt")


@register("model_registry")
def model_registry(spark, sf_dir):
    """The ridge models saved as two versions, the newest loaded
    again: per horizon the complete rows of each split, and how many the loaded
    model predicts exactly as the fitted one did."""
    from hazecast.operators import models as M
    from hazecast.session import shared_dir
    _, res = _trained(spark, sf_dir, "linear")
    if not res:                                     # P15: no horizon has enough rows
        return spark.createDataFrame([], "K int, split string, n_rows long, n_same long, same_names boolean, version int")
    base = shared_dir(spark, "registry")
    for _ in range(2):
        M.save_models(spark, res, "linear", base)
    loaded = M.load_models(spark, base, "linear")
    frames = []
    for r in res:
        model, names = loaded[r.k]
        both = model.transform(r.model.transform(r.metrics["split_frame"]).withColumnRenamed("prediction", "fitted")
                               .select("split", "fitted", *names))
        frames.append(both.select(F.lit(r.k).alias("K"), "split", (F.col("fitted") == F.col("prediction")).alias("same"),
                                  F.lit(names == r.features).alias("same_names")))
    version = M.versions(spark, base, "linear")[-1]
    return (clean.union_all(frames).groupBy("K", "split")
            .agg(F.count("*").alias("n_rows"), F.count_if("same").alias("n_same"), F.bool_and("same_names").alias("same_names"))
            .withColumn("version", F.lit(version)))
