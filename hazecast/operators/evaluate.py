"""Evaluation: RMSE / R² by horizon and split, band summaries, leaderboard
(A12–A16, N6, M11, M18, F29–F31).

Every metric is a grouped aggregate over (K, split) – all horizons and
splits in one pass – instead of one evaluator job per model and split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazecast.functions.numeric import gap_flag, horizon_band, r2_flag

# ---------------------------------------------------------------------------
# Published test RMSE per horizon of earlier model versions
# (K: best previous, v4, v5).
# ---------------------------------------------------------------------------
REFERENCE_RMSE = [
    (1, 8.76, 9.81, 9.27), (4, 15.70, 16.94, 16.48), (7, 19.41, 19.67, 19.74),
    (10, 20.45, 21.83, 21.42), (13, 20.76, 21.93, 22.96), (16, 22.04, 21.90, 22.24),
    (19, 21.94, 22.06, 21.94), (22, 21.36, 22.70, 22.67), (25, 20.94, 22.47, 20.94),
    (28, 21.80, 22.10, 21.83), (31, 21.53, 23.10, 22.76), (34, 21.80, 23.49, 23.44),
    (37, 22.40, 22.96, 23.42), (40, 22.84, 25.02, 22.84), (43, 21.91, 22.35, 21.91),
    (46, 23.69, 22.88, 24.14), (49, 23.01, 23.07, 25.26),
]


def metrics_by_split(pred: DataFrame, k="K", split="split", label="label",
                     prediction="prediction", extra_keys=("n_features",)) -> DataFrame:
    """A12 + A13 + M11: columns K, [n_features], rmse_train, rmse_val, gap,
    rmse_test, r2_test."""
    keys = [k] + [c for c in extra_keys if c in pred.columns]
    sq = F.pow(F.col(label) - F.col(prediction), 2)

    def on(s, c):
        return F.when(F.col(split) == s, c)

    agg = pred.groupBy(*keys).agg(
        F.sqrt(F.avg(on("train", sq))).alias("rmse_train"),
        F.sqrt(F.avg(on("val", sq))).alias("rmse_val"),
        F.sqrt(F.avg(on("test", sq))).alias("rmse_test"),
        F.sum(on("test", sq)).alias("_sse"),
        (F.count(on("test", F.col(label))) * F.var_pop(on("test", F.col(label)))).alias("_sst"),
    )
    r2 = F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
    return (agg.withColumn("r2_test", r2)
            .withColumn("gap", F.col("rmse_val") - F.col("rmse_train"))
            .drop("_sse", "_sst"))


def persistence_predictions(feat: DataFrame, horizons, val_cutoff, test_cutoff) -> DataFrame:
    """Baseline model: the value at t predicts t+K (labels from the shared
    feature table); rows with a missing label are dropped (P6)."""
    from hazecast.operators.clean import split_label
    from hazecast.operators.features import horizon_long
    lng = horizon_long(feat, horizons, keep=["series_id", "ts", "pm25_current"])
    return (lng.where(F.col("label_raw").isNotNull())
            .select("K", split_label(val_cutoff, test_cutoff).alias("split"),
                    F.col("label_raw").alias("label"), F.col("pm25_current").alias("prediction")))


def with_flags(results: DataFrame) -> DataFrame:
    """traffic lights for gap and R²."""
    return results.withColumn("gap_flag", gap_flag("gap")).withColumn("r2_flag", r2_flag("r2_test"))


def band_summary(results: DataFrame) -> DataFrame:
    """A14 + A15: overall and per-band means of test RMSE, R² and gap as one
    ``ROLLUP`` (band = null is the overall row)."""
    return (results.withColumn("band", horizon_band("K"))
            .rollup("band")
            .agg(F.avg("rmse_test").alias("mean_rmse_test"), F.avg("r2_test").alias("mean_r2_test"),
                 F.avg("gap").alias("mean_gap"), F.count("*").alias("n_horizons")))


def reference_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE_RMSE, "K int, best double, v4 double, v5 double")


def leaderboard(results: DataFrame, spark: SparkSession) -> DataFrame:
    """N6 + F30 + A16 + M18: per K deltas against the published versions and
    the win counts (Δ < 0) over all horizons.  The reference side is a fixed
    17-row table, broadcast by definition."""
    ref = F.broadcast(reference_table(spark))
    j = results.join(ref, "K", "left")
    all_rows = Window.partitionBy()          # ≤ one row per horizon
    return (j.withColumn("d_v4", F.col("rmse_test") - F.col("v4"))
            .withColumn("d_best", F.col("rmse_test") - F.col("best"))
            .withColumn("wins_v4", F.count_if(F.col("d_v4") < 0).over(all_rows))
            .withColumn("wins_best", F.count_if(F.col("d_best") < 0).over(all_rows)))
