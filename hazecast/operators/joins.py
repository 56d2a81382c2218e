"""Join helper: as-of (nearest) matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def asof_nearest(left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str,
                 right_cols, tie: str = "earlier") -> DataFrame:
    """For each left row, the right row with the nearest ``right_ts`` within
    the same ``keys``; no pairs are materialised.

    Both sides are unioned into one frame ordered by time per key; for every
    left row the last right row at-or-before and the first right row
    at-or-after come from ``last/first(ignorenulls)`` over running frames and
    the nearer one wins (``tie='earlier'``: the earlier right row on equal
    distance).  Left rows travel through the union as a struct, so no join
    back is needed.  Each ``keys`` group is one window partition: choose keys
    that bound it (e.g. series and forecast run for slot matching).
    """
    keys = list(keys)
    lcols = list(left.columns)
    rstruct = F.struct(F.col(right_ts).alias("_rts"), *[F.col(c) for c in right_cols])
    lstruct = F.struct(*[F.col(c) for c in lcols])
    r = right.select(*keys, F.col(right_ts).alias("_t"), rstruct.alias("_r"),
                     F.lit(0).alias("_side"))
    l_ = left.select(*keys, F.col(left_ts).alias("_t"), lstruct.alias("_l"),
                     F.lit(1).alias("_side"))
    r = r.withColumn("_l", F.lit(None).cast(l_.schema["_l"].dataType))
    l_ = l_.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    u = r.unionByName(l_)
    w_prev = (Window.partitionBy(*keys).orderBy("_t", "_side")
              .rowsBetween(Window.unboundedPreceding, 0))
    w_next = (Window.partitionBy(*keys).orderBy("_t", F.col("_side").desc())
              .rowsBetween(0, Window.unboundedFollowing))
    u = (u.withColumn("_prev", F.last("_r", ignorenulls=True).over(w_prev))
          .withColumn("_next", F.first("_r", ignorenulls=True).over(w_next))
          .where(F.col("_side") == 1))
    dp = F.abs(_micros(F.col("_t")) - _micros(F.col("_prev._rts")))
    dn = F.abs(_micros(F.col("_next._rts")) - _micros(F.col("_t")))
    closer = (dp <= dn) if tie == "earlier" else (dp < dn)
    pick_prev = F.col("_next").isNull() | (F.col("_prev").isNotNull() & closer)
    chosen = F.when(pick_prev, F.col("_prev")).otherwise(F.col("_next"))
    return u.select(*[F.col(f"_l.{c}").alias(c) for c in lcols],
                    chosen["_rts"].alias(right_ts),
                    *[chosen[c].alias(c) for c in right_cols])
