"""Air-quality index functions as native ``Column`` expressions (no UDFs).

All functions are compiled ``CASE WHEN`` chains, so they stay inside
whole-stage codegen.  Rounding: the reference uses Python's half-even
``round``; we round half-even on the scaled double (``bround(x·10)/10``),
which agrees with Python on every exactly representable tie and gives the
same answer in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# US EPA breakpoints as applied by the reference.
# Each entry is (c_lo, c_hi, i_lo, i_hi); concentrations in the unit named.
# ---------------------------------------------------------------------------
PM25_BREAKPOINTS = [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
                    (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300),
                    (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)]          # µg/m³, 1 dp
PM10_BREAKPOINTS = [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150),
                    (255, 354, 151, 200), (355, 424, 201, 300),
                    (425, 504, 301, 400), (505, 604, 401, 500)]                  # µg/m³, truncated
O3_BREAKPOINTS = [(0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150),
                  (86, 105, 151, 200), (106, 200, 201, 300)]                     # ppb
NO2_BREAKPOINTS = [(0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150),
                   (361, 649, 151, 200), (650, 1249, 201, 300),
                   (1250, 1649, 301, 400), (1650, 2049, 401, 500)]               # ppb
CO_BREAKPOINTS = [(0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150),
                  (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300),
                  (30.5, 40.4, 301, 400), (40.5, 50.4, 401, 500)]                # ppm
SO2_BREAKPOINTS = [(0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150),
                   (186, 304, 151, 200), (305, 604, 201, 300),
                   (605, 804, 301, 400), (805, 1004, 401, 500)]                  # ppb
# simplified PM2.5 table used when scoring forecasts (one 250.5–500.4 band)
PM25_SIMPLE_BREAKPOINTS = [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150),
                           (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300),
                           (250.5, 500.4, 301, 500)]
# µg/m³ → ppb / ppm divisors
O3_DIVISOR, NO2_DIVISOR, CO_DIVISOR, SO2_DIVISOR = 1.9957, 1.8816, 1145.0, 2.6196
# value returned above the last breakpoint
ABOVE_TOP = {"PM25": 500, "PM10": 500, "O3": 300, "NO2": 500, "CO": 500, "SO2": 500}
# dominant-pollutant tie order and display names
POLLUTANT_ORDER = [("PM25", "PM2.5"), ("PM10", "PM10"), ("O3", "O3"),
                   ("NO2", "NO2"), ("CO", "CO"), ("SO2", "SO2")]

# category bands: upper bound, label, css class, colour (forecast slots)
CATEGORY_BANDS = [(50, "Tốt", "good", "#00c853"),
                  (100, "Trung bình", "moderate", "#ffca28"),
                  (150, "Kém", "poor", "#ff6f00"),
                  (200, "Xấu", "unhealthy", "#f44336"),
                  (300, "Rất xấu", "very_bad", "#ab47bc"),
                  (999, "Nguy hại", "hazardous", "#b71c1c")]
# dashboard palette (same thresholds, other colours); open-ended last band
DASHBOARD_COLORS = [(50, "#22c55e"), (100, "#facc15"), (150, "#f97316"),
                    (200, "#ef4444"), (300, "#a855f7"), (None, "#7f1d1d")]
ADVICE = [
    (50, "Chất lượng không khí tốt. Thích hợp cho mọi hoạt động ngoài trời."),
    (100, "Chấp nhận được. Người nhạy cảm nên hạn chế hoạt động ngoài trời kéo dài."),
    (150, "Không lành mạnh cho nhóm nhạy cảm. Nên giảm cường độ hoạt động ngoài trời."),
    (200, "Hạn chế hoạt động ngoài trời, đeo khẩu trang N95. Đóng cửa sổ, dùng máy lọc không khí."),
    (300, "Nguy hiểm! Ở trong nhà, dùng máy lọc, tránh mọi hoạt động ngoài trời."),
    (None, "Khẩn cấp! Tuyệt đối không ra ngoài. Đóng kín cửa, máy lọc công suất cao."),
]
HEALTH_TIPS = [
    (50, ["Tuyệt vời để đi bộ, chạy bộ hoặc đạp xe ngoài trời.",
          "Mở cửa sổ để thông gió tự nhiên.",
          "Thích hợp cho mọi hoạt động thể dục."]),
    (100, ["Người hen suyễn và tim mạch nên hạn chế vận động mạnh.",
           "Cân nhắc đeo khẩu trang nếu ra ngoài lâu.",
           "Người cao tuổi và trẻ nhỏ nên ở trong nhà."]),
    (150, ["Đeo khẩu trang N95 khi ra ngoài.",
           "Đóng cửa sổ, hạn chế thông gió tự nhiên.",
           "Người có bệnh hô hấp nên mang theo thuốc.",
           "Hạn chế vận động mạnh ngoài trời."]),
    (200, ["Tránh mọi hoạt động ngoài trời kéo dài.",
           "Bật máy lọc không khí trong nhà.",
           "Bắt buộc đeo khẩu trang N95 khi ra ngoài.",
           "Uống nhiều nước, tránh tiếp xúc bụi."]),
    (None, ["Ở trong nhà hoàn toàn nếu có thể.",
            "Đóng kín cửa và bịt khe hở.",
            "Máy lọc không khí công suất cao.",
            "Người có bệnh mãn tính liên hệ bác sĩ."]),
]
# gauge break points (equal-width display segments)
GAUGE_BREAKS = [0, 50, 100, 150, 200, 300, 500]
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c) -> Column:
    """NaN → null, so that every later comparison sees SQL nulls only."""
    c = _col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def _bround1(x: Column) -> Column:
    """Half-even at one decimal on the scaled double (engine independent)."""
    return F.bround(x * F.lit(10.0), 0) / F.lit(10.0)


def _interp(c: Column, lo, hi, ilo, ihi) -> Column:
    return F.bround((F.lit(float(ihi - ilo)) / F.lit(float(hi - lo))) * (c - F.lit(float(lo)))
                    + F.lit(float(ilo)), 0).cast("int")


def breakpoint_index(c: Column, table, above: int | None, below: int | None = 0) -> Column:
    """Piecewise-linear index over ``table``; values in no segment give
    ``above`` when beyond the last breakpoint, else ``below``.  Null in → null."""
    expr = F.when(c.isNull(), F.lit(None).cast("int"))
    for lo, hi, ilo, ihi in table:
        expr = expr.when((c >= F.lit(lo)) & (c <= F.lit(hi)), _interp(c, lo, hi, ilo, ihi))
    top = table[-1][1]
    tail = F.when(c > F.lit(top), F.lit(above)).otherwise(F.lit(below))
    return expr.otherwise(tail.cast("int"))


def sub_index(c, pollutant: str) -> Column:
    """Six-pollutant sub-index (µg/m³ input)."""
    x = clean_double(c)
    if pollutant == "PM25":
        return breakpoint_index(_bround1(x), PM25_BREAKPOINTS, ABOVE_TOP["PM25"])
    if pollutant == "PM10":
        # truncation toward zero, as int(); guarded against overflow
        t = F.when(F.abs(x) < F.lit(1e9), x.cast("long").cast("double"))
        return F.when(x.isNull(), None).otherwise(
            breakpoint_index(F.coalesce(t, x), PM10_BREAKPOINTS, ABOVE_TOP["PM10"]))
    divisor = {"O3": O3_DIVISOR, "NO2": NO2_DIVISOR, "CO": CO_DIVISOR, "SO2": SO2_DIVISOR}[pollutant]
    table = {"O3": O3_BREAKPOINTS, "NO2": NO2_BREAKPOINTS,
             "CO": CO_BREAKPOINTS, "SO2": SO2_BREAKPOINTS}[pollutant]
    return breakpoint_index(x / F.lit(divisor), table, ABOVE_TOP[pollutant])


def aqi_pm25(c) -> Column:
    return sub_index(c, "PM25")


def aqi_pm10(c) -> Column:
    return sub_index(c, "PM10")


def aqi_o3(c) -> Column:
    return sub_index(c, "O3")


def aqi_no2(c) -> Column:
    return sub_index(c, "NO2")


def aqi_co(c) -> Column:
    return sub_index(c, "CO")


def aqi_so2(c) -> Column:
    return sub_index(c, "SO2")


def overall_aqi(cols: dict | None = None) -> tuple[Column, Column]:
    """(AQI, AQI_Pollutant): max of the non-null sub-indices; ties go to the
    first pollutant in PM2.5, PM10, O3, NO2, CO, SO2 order; none → nulls."""
    cols = cols or {p: p for p, _ in POLLUTANT_ORDER}
    subs = [(sub_index(cols[p], p), name) for p, name in POLLUTANT_ORDER]
    best = F.greatest(*[s for s, _ in subs])
    dominant = F.coalesce(*[F.when(s == best, F.lit(name)) for s, name in subs])
    return best, dominant


def with_overall_aqi(df, cols: dict | None = None):
    """Adds AQI and AQI_Pollutant.  Two projections: the six sub-indices are
    computed once, then the maximum and the first pollutant reaching it –
    the CASE chains are never duplicated into the later expressions."""
    cols = cols or {p: p for p, _ in POLLUTANT_ORDER}
    subs = [sub_index(cols[p], p).alias(f"_sub_{p}") for p, _ in POLLUTANT_ORDER]
    out = df.select("*", *subs)
    sub = {p: F.col(f"_sub_{p}") for p, _ in POLLUTANT_ORDER}
    best = F.greatest(*sub.values())
    dominant = F.coalesce(*[F.when(sub[p] == best, F.lit(name)) for p, name in POLLUTANT_ORDER])
    return out.select(*[F.col(c) for c in df.columns], best.alias("AQI"), dominant.alias("AQI_Pollutant"))


def pm25_to_aqi_simple(c) -> Column:
    """Forecast-side PM2.5 → AQI: clamp negatives to 0, round to 1 dp, six
    segments, anything not inside a segment (above 500.4 or in a gap) → 500."""
    x = clean_double(c)
    x = _bround1(F.greatest(x, F.lit(0.0)))
    return breakpoint_index(x, PM25_SIMPLE_BREAKPOINTS, 500, below=500)


def pm25_to_aqi_strict(c) -> Column:
    """Stored-slot variant: no rounding and no clamp, so gap values such as
    12.05 and negative values return 500."""
    x = clean_double(c)
    return breakpoint_index(x, PM25_SIMPLE_BREAKPOINTS, 500, below=500)


def _band(aqi: Column, bands, pick) -> Column:
    expr = None
    for b in bands:
        upper = b[0]
        val = F.lit(pick(b))
        if upper is None:
            expr = expr.otherwise(val)
            return expr
        cond = aqi <= F.lit(upper)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def aqi_category(aqi) -> Column:
    """AQI → struct(label, css_class, color); thresholds 50/100/150/200/300."""
    a = _col(aqi)
    bands = CATEGORY_BANDS
    label = _band(a, bands[:-1] + [(None,) + bands[-1][1:]], lambda b: b[1])
    css = _band(a, bands[:-1] + [(None,) + bands[-1][1:]], lambda b: b[2])
    color = _band(a, bands[:-1] + [(None,) + bands[-1][1:]], lambda b: b[3])
    return F.when(a.isNull(), None).otherwise(
        F.struct(label.alias("label"), css.alias("css_class"), color.alias("color")))


def dashboard_color(aqi) -> Column:
    a = _col(aqi)
    return F.when(a.isNull(), None).otherwise(_band(a, DASHBOARD_COLORS, lambda b: b[1]))


def dashboard_label(aqi) -> Column:
    a = _col(aqi)
    bands = [(u, lab) for (u, _), (_, lab, _, _) in
             zip(DASHBOARD_COLORS, CATEGORY_BANDS)]
    return F.when(a.isNull(), None).otherwise(_band(a, bands, lambda b: b[1]))


def advice(aqi) -> Column:
    a = _col(aqi)
    return F.when(a.isNull(), None).otherwise(_band(a, ADVICE, lambda b: b[1]))


def health_tips(aqi) -> Column:
    a = _col(aqi)
    expr = None
    for upper, tips in HEALTH_TIPS:
        arr = F.array(*[F.lit(t) for t in tips])
        if upper is None:
            expr = expr.otherwise(arr)
        else:
            expr = F.when(a <= upper, arr) if expr is None else expr.when(a <= upper, arr)
    return F.when(a.isNull(), None).otherwise(expr)


def gauge_percent(aqi) -> Column:
    """AQI → 0..100 position on a gauge whose segments 0-50-100-150-200-300-500
    have equal width."""
    v = F.least(F.greatest(_col(aqi).cast("double"), F.lit(0.0)), F.lit(500.0))
    n = len(GAUGE_BREAKS) - 1
    expr = None
    for i in range(n):
        lo, hi = GAUGE_BREAKS[i], GAUGE_BREAKS[i + 1]
        pct = (F.lit(float(i)) + (v - F.lit(float(lo))) / F.lit(float(hi - lo))) / F.lit(float(n)) * 100.0
        cond = v <= F.lit(float(hi))
        expr = F.when(cond, pct) if expr is None else expr.when(cond, pct)
    return F.when(_col(aqi).isNull(), None).otherwise(expr.otherwise(F.lit(100.0)))
