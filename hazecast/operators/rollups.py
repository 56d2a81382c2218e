"""History rollups, coverage and tail/latest selections.

All rollups are hash aggregates with map-side partial aggregation, so a
series holding a third of the rows is pre-aggregated in every input task
before the shuffle.  Per-series "top-N" selections use ``row_number() <= n``,
which Catalyst plans as a ``WindowGroupLimit`` (partial top-N before the
exchange) – a hot series never ships more than ``n`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.functions.numeric import round_dp
from hazecast.schema import ROLLUP_FIELDS

MIN_DATE = "2000-01-01"


EXACT = "decimal(38,18)"


def exact_mean_parts(col: str) -> list:
    """Aggregates for ``exact_rounded_mean``: the sum of the values' decimal
    texts (exact and order independent), the counts of non-nulls and of the
    values that a decimal holds, and the double mean for the others."""
    q = F.col(col).try_cast(EXACT)
    return [F.try_sum(q).alias(f"_s_{col}"), F.count(col).alias(f"_n_{col}"),
            F.count(q).alias(f"_q_{col}"), F.avg(col).alias(f"_a_{col}")]


def exact_rounded_mean(col: str, digits: int) -> Column:
    """Mean rounded half away from zero at ``digits`` decimals, decided on the
    exact decimal sum.  A float ``avg`` is summed in partition order, so a mean
    lying exactly on a rounding tie could round either way depending on the
    plan; this cannot.  Groups with values or sums of 1e20 and more, or with
    infinities, take the double mean."""
    s, n, q = (F.col(f"_{p}_{col}") for p in "snq")
    exact = F.round(s / n.cast("decimal(20,0)"), digits).cast("double")
    return (F.when(n == 0, F.lit(None).cast("double")).when((n == q) & s.isNotNull(), exact)
            .otherwise(F.round(f"_a_{col}", digits)))


def _rounded_means(grouped, fields, digits):
    parts = [p for f in fields for p in exact_mean_parts(f)]
    return parts, {f: exact_rounded_mean(f, digits) for f in fields}


def _clean_measures(df: DataFrame, fields) -> list:
    return [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f)
            for f in fields]


def _dated(df: DataFrame, ts: str) -> DataFrame:
    """P10 on the time column itself, so that the scan prunes by it."""
    return df.where(F.col(ts) >= F.lit(MIN_DATE).cast(df.schema[ts].dataType))


def daily_rollup(df: DataFrame, fields=ROLLUP_FIELDS, key="series_id", ts="ts",
                 digits: int = 1) -> DataFrame:
    """A4: mean per (series, date) of each measure ignoring nulls/NaN, rounded;
    a (series, date) exists iff at least one measure is non-null; bad dates
    (< 2000-01-01) are dropped (P10)."""
    base = _dated(df, ts).select(key, F.date_format(ts, "yyyy-MM-dd").alias("date"),
                                 *_clean_measures(df, fields))
    parts, means = _rounded_means(base, fields, digits)
    present = F.count(F.coalesce(*[F.col(f) for f in fields])).alias("_n")
    return (base.groupBy(key, "date").agg(*parts, present)
            .where(F.col("_n") > 0).select(key, "date", *[means[f].alias(f) for f in fields]))


def hourly_rollup(df: DataFrame, fields=ROLLUP_FIELDS, key="series_id", ts="ts",
                  digits: int = 1) -> DataFrame:
    """A5: mean per (series, date, hour)."""
    base = _dated(df, ts).select(key, F.date_format(ts, "yyyy-MM-dd").alias("date"), F.hour(ts).alias("hour"),
                                 *_clean_measures(df, fields))
    parts, means = _rounded_means(base, fields, digits)
    present = F.count(F.coalesce(*[F.col(f) for f in fields])).alias("_n")
    return (base.groupBy(key, "date", "hour").agg(*parts, present)
            .where(F.col("_n") > 0).select(key, "date", "hour", *[means[f].alias(f) for f in fields]))


def last_n_days(daily: DataFrame, n: int, key="series_id", date="date") -> DataFrame:
    """L3: keep the newest ``n`` dates per series."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def yearly_rollup(df: DataFrame, measure="AQI", key="series_id", ts="ts") -> DataFrame:
    """Per (series, year) rounded mean, max and min of the measure."""
    return (df.where(F.col(measure).isNotNull())
            .groupBy(key, F.date_format(ts, "yyyy").alias("year"))
            .agg(round_dp(F.avg(measure), 1).alias("avg"),
                 F.max(measure).alias("max"), F.min(measure).alias("min")))


def monthly_means(df: DataFrame, measure="AQI", key="series_id", ts="ts") -> DataFrame:
    return (df.where(F.col(measure).isNotNull())
            .groupBy(key, F.date_format(ts, "yyyy-MM").alias("month"))
            .agg(F.avg(measure).alias("_mean"), F.max(measure).alias("max")))


def monthly_rollup(df: DataFrame, measure="AQI", key="series_id", ts="ts",
                   last_months: int = 24) -> DataFrame:
    """Per (series, month) rounded mean and max, newest ``last_months``."""
    m = monthly_means(df, measure, key, ts)
    w = Window.partitionBy(key).orderBy(F.col("month").desc())
    return (m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last_months)
            .select(key, "month", round_dp("_mean", 1).alias("avg"), "max"))


def best_worst_month(df: DataFrame, measure="AQI", key="series_id", ts="ts") -> DataFrame:
    """Month with the lowest and highest mean over all months; ties
    resolved to the earliest month by ordering on (mean, month)."""
    m = monthly_means(df, measure, key, ts)
    best = F.min_by(F.struct("month", round_dp("_mean", 1).alias("avg")),
                    F.struct("_mean", "month"))
    worst = F.max_by(F.struct("month", round_dp("_mean", 1).alias("avg")),
                     F.struct("_mean", F.lit(0) - F.unix_date(F.to_date(F.concat("month", F.lit("-01"))))))
    return (m.groupBy(key).agg(best.alias("b"), worst.alias("w"))
            .select(key, F.col("b.month").alias("best_month"), F.col("b.avg").alias("best_avg"),
                    F.col("w.month").alias("worst_month"), F.col("w.avg").alias("worst_avg")))


def coverage(df: DataFrame, key="series_id", ts="ts") -> DataFrame:
    """A10: first/last timestamp and row count per series."""
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
                               F.count("*").alias("n_rows"))


def tail_n(df: DataFrame, n: int, key="series_id", order=("ts",)) -> DataFrame:
    """L2: newest ``n`` rows per series (WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def mean_of_last_n(df: DataFrame, n: int, value="PM25", key="series_id", ts="ts") -> DataFrame:
    """Mean of the newest ``n`` rows per series."""
    return (tail_n(df.select(key, ts, value), n, key, (ts,))
            .groupBy(key).agg(F.avg(value).alias(f"mean_last_{n}"),
                              F.max(ts).alias("last_ts")))


def latest_row(df: DataFrame, key="series_id", ts="ts") -> DataFrame:
    """L4: the newest row per series as one aggregate; of rows with the same
    time the one with the largest other columns, in their order.  Constant
    memory per group, partial aggregation before the shuffle."""
    cols = [c for c in df.columns if c != key]
    newest = F.max(F.struct(ts, *(c for c in cols if c != ts)))
    return df.groupBy(key).agg(newest.alias("_r")).select(key, *(F.col("_r")[c].alias(c) for c in cols))
