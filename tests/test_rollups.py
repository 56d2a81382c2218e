"""Rollup rounding is exact: the 1-decimal mean agrees with rational
arithmetic, including means that sit exactly on a tie."""

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from hazecast.operators import rollups


def _expected(values, digits=1):
    vals = [Fraction(Decimal(str(v))) for v in values if v is not None]
    if not vals:
        return None
    mean = sum(vals) / len(vals)
    q = Decimal(mean.numerator) / Decimal(mean.denominator)
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.integers(min_value=-50000, max_value=50000).map(lambda i: i / 100),
                         min_size=1, max_size=9), min_size=30, max_size=30))
def test_exact_rounded_mean(spark, groups):
    # add groups whose mean is exactly on a 1-decimal tie
    groups = groups + [[12.30, 12.20], [0.05, 0.10, 0.00], [-0.25, -0.20], [1.15]]
    rows = [(g, v) for g, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "g int, x double")
    out = (df.groupBy("g").agg(*rollups.exact_mean_parts("x"))
           .select("g", rollups.exact_rounded_mean("x", 1).alias("m")))
    got = {r["g"]: r["m"] for r in out.collect()}
    for g, vals in enumerate(groups):
        assert got[g] == _expected(vals), (g, vals, got[g])


def test_daily_rollup_group_exists_iff_any_measure(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("s", t, None, None), ("s", t + dt.timedelta(days=1), 5, None),
         ("s", dt.datetime(1999, 12, 31), 7, 1.0)],
        "series_id string, ts timestamp_ntz, AQI int, PM25 double")
    out = rollups.daily_rollup(df, fields=["AQI", "PM25"]).collect()
    assert [(r["date"], r["AQI"], r["PM25"]) for r in out] == [("2024-01-02", 5.0, None)]


def test_means_of_long_decimals_and_large_values(spark):
    """No digit is cut before the mean, and large values abort no job."""
    rows = [(0, 0.2499999), (0, 0.2499999), (1, 1e13), (1, 1e13), (2, 1e25), (3, None), (4, 0.25), (4, 0.2500000000001)]
    df = spark.createDataFrame(rows, "g int, x double")
    out = (df.groupBy("g").agg(*rollups.exact_mean_parts("x"))
           .select("g", rollups.exact_rounded_mean("x", 1).alias("m")))
    assert {r["g"]: r["m"] for r in out.collect()} == {0: 0.2, 1: 1e13, 2: 1e25, 3: None, 4: 0.3}
