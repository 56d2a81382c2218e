"""Numeric helpers: safe casts/ratios, target transforms, metric flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6          # ratio guard of the feature catalogue

# Quality traffic lights of the evaluation report.
GAP_GOOD, GAP_FAIR = 6.0, 10.0
R2_GOOD, R2_FAIR = 0.85, 0.65


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_dp(c, digits: int) -> Column:
    """Round half away from zero at ``digits`` decimals, computed as
    ``round(x * 10^d) / 10^d``.  Rounding the scaled double (not its decimal
    text) gives the same answer in every engine, so rollups are reproducible
    across Spark and SQL back ends."""
    s = float(10 ** digits)
    return F.round(_col(c) * F.lit(s), 0) / F.lit(s)


SNAP = float(1 << 20)


def snap(c) -> Column:
    """Round to the binary grid 2^-20 (~1e-6).  Decimal grids put exact ties
    on every mean of 2-decimal data divided by 8, 24, 48 …, so two engines
    whose sums differ in the last bit round them apart; dyadic grid points
    are only hit by values both engines compute exactly."""
    return F.round(_col(c) * F.lit(SNAP), 0) / F.lit(SNAP)


def bround_dp(c, digits: int) -> Column:
    """Half-even variant of ``round_dp`` (the reference's Python ``round``)."""
    s = float(10 ** digits)
    return F.bround(_col(c) * F.lit(s), 0) / F.lit(s)


def safe_float(c) -> Column:
    """Unparsable text or NaN → null."""
    x = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def ratio(a, b, eps: float = EPS) -> Column:
    """a / (b + eps); a zero denominator yields null instead of an error."""
    return F.try_divide(_col(a), _col(b) + F.lit(eps))


def log1p_target(c) -> Column:
    return F.log1p(_col(c))


def decode_target(c) -> Column:
    """expm1 and clamp at zero."""
    return F.greatest(F.lit(0.0), F.expm1(_col(c)))


def gap_flag(gap) -> Column:
    g = _col(gap)
    return F.when(g < GAP_GOOD, "good").when(g < GAP_FAIR, "fair").otherwise("poor")


def r2_flag(r2) -> Column:
    r = _col(r2)
    return F.when(r >= R2_GOOD, "good").when(r >= R2_FAIR, "fair").otherwise("poor")


def strategy_label(k) -> Column:
    """LONG for K=25, SHORT for K<=8, MED otherwise."""
    k = _col(k)
    return F.when(k == 25, "LONG").when(k <= 8, "SHORT").otherwise("MED")


def horizon_band(k) -> Column:
    """A15 bands: short 1–6 h, mid 7–24 h, long 25–49 h."""
    k = _col(k)
    return (F.when(k.between(1, 6), "short")
            .when(k.between(7, 24), "mid")
            .when(k.between(25, 49), "long"))
