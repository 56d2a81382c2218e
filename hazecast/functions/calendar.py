"""Calendar and timestamp helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the feature catalogue.
RAINY_MONTHS = (5, 10)                       # inclusive range
BURN_MONTHS = [4, 5, 6, 10, 11, 12]
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
NIGHT_FROM, NIGHT_TO = 22, 5                 # hour >= 22 or hour <= 5
WEEKEND_DAYS = [1, 7]                        # Spark dayofweek: Sunday=1 .. Saturday=7
SERIES_START = "2022-08-11"                  # origin of days_since_start
TRAIN_PI = 3.14159265                        # pi as written in the training features


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_ts(c, fmt: str | None = None) -> Column:
    """Text → TIMESTAMP_NTZ (wall clock, no zone)."""
    return F.to_timestamp_ntz(_col(c), F.lit(fmt)) if fmt else F.to_timestamp_ntz(_col(c))


def hour_floor(c) -> Column:
    """Truncate to the hour, staying TIMESTAMP_NTZ (date_trunc yields TIMESTAMP)."""
    return F.date_trunc("hour", _col(c)).cast("timestamp_ntz")


def day_floor(c) -> Column:
    return F.date_trunc("day", _col(c)).cast("timestamp_ntz")


def add_hours(c, k) -> Column:
    k = F.lit(k) if isinstance(k, int) else _col(k)
    return _col(c) + F.make_dt_interval(F.lit(0), k.cast("int"))


def hours_between(a, b) -> Column:
    """(b - a) in hours as double."""
    return (F.unix_micros(_col(b).cast("timestamp")) -
            F.unix_micros(_col(a).cast("timestamp"))) / F.lit(3.6e9)


def localize_invalid(ts, tz: str) -> Column:
    """True when wall-clock ``ts`` does not exist (spring gap) or is ambiguous
    (autumn overlap) in zone ``tz``; the reference turns those hours into NaT."""
    t = _col(ts).cast("timestamp")
    utc = F.to_utc_timestamp(t, tz)
    nonexistent = F.from_utc_timestamp(utc, tz) != t
    hour = F.make_dt_interval(F.lit(0), F.lit(1))
    ambiguous = ((F.from_utc_timestamp(utc + hour, tz) == t) |
                 (F.from_utc_timestamp(utc - hour, tz) == t))
    return nonexistent | ambiguous


def localize(ts, tz: str) -> Column:
    """Wall clock kept, invalid local times → null."""
    return F.when(localize_invalid(ts, tz), F.lit(None)).otherwise(_col(ts))


def calendar_columns(ts="ts") -> dict[str, Column]:
    """hour / month / calendar flags / cyclic encodings."""
    t = _col(ts)
    h, m = F.hour(t), F.month(t)
    two_pi = 2 * TRAIN_PI
    return {
        "hour": h,
        "month": m,
        "is_rainy_season": m.between(*RAINY_MONTHS).cast("int"),
        "is_burn_season": m.isin(BURN_MONTHS).cast("int"),
        "is_april": (m == 4).cast("int"),
        "is_rush_hour": h.isin(RUSH_HOURS).cast("int"),
        "is_night": ((h >= NIGHT_FROM) | (h <= NIGHT_TO)).cast("int"),
        "is_weekend": F.dayofweek(t).isin(WEEKEND_DAYS).cast("int"),
        "hour_sin": F.sin(h * F.lit(two_pi / 24)),
        "hour_cos": F.cos(h * F.lit(two_pi / 24)),
        "month_sin": F.sin(m * F.lit(two_pi / 12)),
        "month_cos": F.cos(m * F.lit(two_pi / 12)),
        "days_since_start": F.datediff(F.to_date(t), F.to_date(F.lit(SERIES_START))).cast("double"),
    }


def wind_dir_columns(c="Wind_Direction") -> dict[str, Column]:
    x = _col(c) * F.lit(TRAIN_PI / 180.0)
    return {"wind_dir_sin": F.sin(x), "wind_dir_cos": F.cos(x)}


def display_formats(c) -> dict[str, Column]:
    """Slot display strings (F24, F27): '%d/%m %Hh', '%A, %d/%m/%Y %H:%M',
    '%H:00', '%d/%m'."""
    t = _col(c)
    return {
        "display_dt": F.date_format(t, "dd/MM HH'h'"),
        "display_full": F.date_format(t, "EEEE, dd/MM/yyyy HH:mm"),
        "hour_str": F.date_format(t, "HH:00"),
        "date_str": F.date_format(t, "dd/MM"),
    }


def stale(generated_at, as_of) -> Column:
    """a forecast document is stale when missing or generated before
    midnight of ``as_of``'s day."""
    g = _col(generated_at)
    return g.isNull() | (g < day_floor(as_of))


def cyclic(c, period: float) -> tuple[Column, Column]:
    x = _col(c) * F.lit(2 * math.pi / period)
    return F.sin(x), F.cos(x)
