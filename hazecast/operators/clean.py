"""Cleaning, imputation, merge and upsert operators.

P1–P3 rename/drop/order, P5–P9 filters, P16 data-quality counts,
A2/A3/N2 seasonal-median imputation, U1–U3 unions with priority dedupe.

Dedupe keeps one row per (series_id, ts) with ``max_by(struct, priority)``:
a hash aggregate with partial aggregation, so duplicates are folded before
the shuffle and a hot series costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazecast.functions.calendar import add_hours, hour_floor, hours_between
from hazecast.session import ensure_checkpoint_dir

# ---------------------------------------------------------------------------
# projections / filters
# ---------------------------------------------------------------------------


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename by map; names that are absent are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """``drop`` is already a no-op for absent names."""
    return df.drop(*cols)


def select_existing(df: DataFrame, order) -> DataFrame:
    """Keep the columns of ``order`` that exist, in that order."""
    return df.select(*[c for c in order if c in df.columns])


def target_not_null(df: DataFrame, target="PM25") -> DataFrame:
    """P5: drop rows with a null (or NaN) target before any windowing."""
    return df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target)))


def complete(cols) -> Column:
    """Whether none of ``cols`` is null or NaN."""
    return reduce(lambda a, b: a & b,
                  [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])


def drop_incomplete(df: DataFrame, cols) -> DataFrame:
    """Drop rows with a null/NaN in any of ``cols``."""
    return df.where(complete(cols))


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """null/NaN → 0.0."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                                         F.lit(0.0)) for c in cols})


def happened(df: DataFrame, as_of_cutoff, start=None, ts="ts") -> DataFrame:
    """Keep hours that already happened (``ts <= cutoff``) and, when
    given, ``ts >= start``."""
    cond = F.col(ts) <= F.lit(as_of_cutoff).cast("timestamp_ntz")
    if start is not None:
        cond = cond & (F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df.where(cond)


def split_label(val_cutoff, test_cutoff, ts="ts", embargo=None) -> Column:
    """Chronological split train < val_cutoff <= val < test_cutoff <= test.

    ``embargo`` (hours, a number or a column) is the horizon of the row's label:
    rows whose label lies on the other side of a cut-off are ``embargo``, so
    that no split has seen a value that the next one is judged by."""
    t, val, test = F.col(ts), F.lit(val_cutoff).cast("timestamp_ntz"), F.lit(test_cutoff).cast("timestamp_ntz")
    if embargo is None:
        return F.when(t < val, "train").when(t < test, "val").otherwise("test")
    seen = add_hours(t, embargo)
    return (F.when(t < val, F.when(seen < val, "train").otherwise("embargo"))
            .when(t < test, F.when(seen < test, "val").otherwise("embargo")).otherwise("test"))


def null_report(df: DataFrame, cols, key="series_id") -> DataFrame:
    """One pass: row count and null count per column per series."""
    aggs = [F.count("*").alias("n_rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols]
    return df.groupBy(key).agg(*aggs)


# ---------------------------------------------------------------------------
# imputation
# ---------------------------------------------------------------------------


#: Counts a group that a pass of ``exact_medians`` makes at most.
RADIX = 1 << 12
_WIDE = "decimal(20,0)"         # differences of 64-bit numbers


def ordered_bits(c: Column) -> Column:
    """A double's bits as a long of the same order (-0.0 like 0.0)."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), c.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(F.bitwise_not(bits).bitwiseXOR(F.lit(-(1 << 63))))


def from_ordered_bits(c: Column) -> Column:
    bits = F.when(c >= 0, c).otherwise(F.bitwise_not(c.bitwiseXOR(F.lit(-(1 << 63)))))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_medians(df: DataFrame, col: str, groupings: list[dict], out: str, radix: int = RADIX) -> list[DataFrame]:
    """The lower median of ``col`` per group, exact at any size, for several
    groupings of the same rows: a table (keys, ``out``) each.

    Radix selection on the ordered bits of the values, for all groups at once.
    A pass cuts every group's remaining range of bits into at most ``radix``
    cells and counts the rows of each (folded map-side); the cell that holds the
    median's rank, narrowed to its least and largest value, is the next range.
    A group is done when the two are equal, mostly after one or two passes, at
    last after six.  No task sees more than ``radix`` cells of a group, whatever
    rows or different values it has; rows and ranges meet in a plain join on
    the group, whose small side AQE broadcasts while it is small and whose large
    side it splits where a group is hot."""
    if not groupings:
        return []
    ensure_checkpoint_dir(df.sparkSession)
    names = list(dict.fromkeys(k for g in groupings for k in g))
    kinds = {}
    for g in groupings:
        for k, c in g.items():
            kinds.setdefault(k, df.select(c.alias(k)).schema[k].dataType)
    cells = [F.struct(F.lit(i).alias("_g"), *((g[k] if k in g else F.lit(None)).cast(kinds[k]).alias(k) for k in names))
             for i, g in enumerate(groupings)]
    d = df.where(F.col(col).isNotNull()).select(ordered_bits(F.col(col)).alias("_b"), F.explode(F.array(*cells)).alias("_k"))
    d = d.groupBy("_k", "_b").agg(F.count("*").alias("_c")).checkpoint()        # equal values once
    state = d.groupBy("_k").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), F.sum("_c").alias("_n"))
    state = state.select("_k", "_lo", "_hi", F.expr("(_n + 1) div 2").alias("_rank")).checkpoint()
    done = []
    while True:
        done.append(state.where("_lo = _hi").select("_k", F.col("_lo").alias("_b")))
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        span = F.col("_hi").cast(_WIDE) - F.col("_lo").cast(_WIDE)
        ranges = state.withColumn("_w", F.floor(span / F.lit(radix).cast(_WIDE)).cast(_WIDE) + 1)
        j = d.join(ranges, "_k").where("_b between _lo and _hi")
        cell = F.floor((F.col("_b").cast(_WIDE) - F.col("_lo").cast(_WIDE)) / F.col("_w")).cast("long")
        counts = j.groupBy("_k", "_rank", cell.alias("_cell")).agg(F.sum("_c").alias("_c"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
        run = F.sum("_c").over(Window.partitionBy("_k").orderBy("_cell"))                # at most ``radix`` rows a group
        state = (counts.withColumn("_run", run).where("_run >= _rank and _run - _c < _rank")
                 .select("_k", "_lo", "_hi", (F.col("_rank") - F.col("_run") + F.col("_c")).alias("_rank")).checkpoint())
    found = reduce(DataFrame.unionByName, done)
    return [found.where(F.col("_k._g") == i).select(*(F.col("_k")[k].alias(k) for k in g), from_ordered_bits(F.col("_b")).alias(out))
            for i, g in enumerate(groupings)]


def exact_median(df: DataFrame, col: str, keys: dict, out: str) -> DataFrame:
    """The lower median of ``col`` per group: see ``exact_medians``."""
    return exact_medians(df, col, [keys], out)[0]


def seasonal_keys(key="series_id", ts="ts") -> dict:
    return {key: F.col(key), "hour": F.hour(ts), "month": F.month(ts)}


def seasonal_median(df: DataFrame, col: str, key="series_id", ts="ts") -> DataFrame:
    """A2: median per (series, hour of day, month) over non-null values."""
    return exact_median(df, col, seasonal_keys(key, ts), "seasonal_med")


def series_median(df: DataFrame, col: str, key="series_id") -> DataFrame:
    """A3: per-series median fallback (a table, never a driver scalar)."""
    return exact_median(df, col, {key: F.col(key)}, "series_med")


def impute_seasonal(df: DataFrame, col: str, key="series_id", ts="ts") -> DataFrame:
    """N2 + A3: fill nulls of ``col`` with the (series, hour, month) median,
    then with the series median.

    Both median tables are aggregates (≤ 288 rows and 1 row per series).  No
    broadcast is forced: with AQE the joins are re-planned as broadcast hash
    joins from the *measured* size of the materialised aggregate, and stay
    shuffle joins when many series make the table large.
    """
    med, gmed = exact_medians(df, col, [seasonal_keys(key, ts), {key: F.col(key)}], "med")
    med, gmed = med.withColumnRenamed("med", "seasonal_med"), gmed.withColumnRenamed("med", "series_med")
    out = (df.withColumn("hour", F.hour(ts)).withColumn("month", F.month(ts))
           .join(med, [key, "hour", "month"], "left")
           .join(gmed, [key], "left"))
    filled = F.coalesce(F.col(col), F.col("seasonal_med"), F.col("series_med"))
    return out.withColumn(col, filled).drop("seasonal_med", "series_med", "hour", "month")


# ---------------------------------------------------------------------------
# unions / dedupe / upsert
# ---------------------------------------------------------------------------


def union_all(frames) -> DataFrame:
    """Union by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedupe_by_priority(df: DataFrame, priority: str, keys=("series_id", "ts"),
                       keep: str = "max") -> DataFrame:
    """Keep one row per key: the one with the largest (``keep='max'``) or
    smallest priority value; rows of equal priority are ordered by their
    other columns, so the winner does not depend on the plan."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != priority]
    pick = F.max if keep == "max" else F.min
    return (df.groupBy(*keys).agg(pick(F.struct(priority, *rest)).alias("_r"))
            .select(*keys, *(F.col("_r")[c].alias(c) for c in rest)))


def dedupe_keep_first(first: DataFrame, second: DataFrame, keys=("series_id", "ts")) -> DataFrame:
    """Archive ∪ recent, on duplicate keys the first source wins."""
    u = union_all([first.withColumn("_prio", F.lit(0)), second.withColumn("_prio", F.lit(1))])
    return dedupe_by_priority(u, "_prio", keys, keep="min")


def upsert_keep_last(history: DataFrame, delta: DataFrame, keys=("series_id", "ts")) -> DataFrame:
    """History ∪ delta, on duplicate keys the delta wins."""
    u = union_all([history.withColumn("_prio", F.lit(0)), delta.withColumn("_prio", F.lit(1))])
    return dedupe_by_priority(u, "_prio", keys, keep="max")


# ---------------------------------------------------------------------------
# hourly grid
# ---------------------------------------------------------------------------


def hourly_grid(df: DataFrame, key="series_id", ts="ts", bucket_rows: int | None = None) -> DataFrame:
    """One row per series and hour between its first and last one, so that row
    offsets are hours: each row generates the hours up to its successor, as
    rows of nulls marked ``filled``.  Nothing is joined with a grid, and the
    successor comes from the windows that split a hot series."""
    from hazecast.operators.windows import series_windows
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    nxt = series_windows(df, lambda w, by: {"_next": F.lead(ts).over(w)}, back=0, fwd=1, key=key, order=(ts,), bucket_rows=bucket_rows)
    hours = F.when(F.col("_next") > F.col(ts) + hour, F.sequence(F.col(ts), F.col("_next") - hour, hour)).otherwise(F.array(ts))
    rows = nxt.withColumn("_hour", F.explode(hours)).withColumn("filled", F.col("_hour") != F.col(ts))
    rest = [c for c in df.columns if c not in (key, ts)]
    return rows.select(key, F.col("_hour").alias(ts), *(F.when(~F.col("filled"), F.col(c)).alias(c) for c in rest), "filled")


# ---------------------------------------------------------------------------
# freshness
# ---------------------------------------------------------------------------


def freshness(df: DataFrame, as_of, key="series_id", ts="ts", lag_hours: int = 1) -> DataFrame:
    """cutoff = floor(as_of, hour) − lag; a series is stale when the gap
    between its last observation and the cutoff is ≥ 1 hour."""
    cutoff = add_hours(hour_floor(F.lit(as_of).cast("timestamp_ntz")), -lag_hours)
    last = df.groupBy(key).agg(F.max(ts).alias("last_ts"))
    gap = hours_between(F.col("last_ts"), cutoff)
    return last.select(key, "last_ts", cutoff.alias("cutoff_ts"), gap.alias("gap_hours"),
                       (gap >= 1).alias("stale"))
