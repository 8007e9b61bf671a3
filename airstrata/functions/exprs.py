"""Column expressions of the air-quality domain: indices, units, time and place. All stay within the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index breakpoints (concentration low, high, index low, high) by pollutant.
PM25_POINTS = [(0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500)]
PM10_POINTS = [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300), (425, 604, 301, 500)]
# Upper index of each category, and molar masses in g/mol with the molar volume in litres.
CATEGORIES = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups"), (200, "Unhealthy"), (300, "Very Unhealthy"), (500, "Hazardous")]
MOLAR_MASS = {"o3": 47.998, "no2": 46.0055, "so2": 64.066, "co": 28.01}
MOLAR_VOLUME = 24.45
EARTH_KM = 6371.0


def truncated(x: Column, digits: int = 1) -> Column:
    return F.floor(x * 10**digits + F.lit(1e-9)) / 10**digits


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, with a billionth added: sums in another order then round alike at a half."""
    return F.round(x + F.lit(1e-9), digits) if not isinstance(x, str) else F.round(F.col(x) + F.lit(1e-9), digits)


def exact_mean(x: Column) -> Column:
    """The mean of a group from its exact sum, rounded once, for means that are held against limits: `avg` adds up as rows and
    tasks' sums come, and on a limit the last bit decides. A value is three whole numbers, to 2**-64, whose sums have no
    order; groups with values of 2**33 or more, infinite ones or NaN have `avg`."""
    small = F.abs(x) < 2**33
    parts, rest = [], F.when(small, x.cast("double"))
    for _ in range(3):
        parts.append(F.sum(rest.cast("long")).cast("decimal(38,0)"))
        rest = (rest - rest.cast("long").cast("double")) * 2.0**32
    step = F.lit(2**32).cast("decimal(10,0)")
    total = reduce(lambda total, part: F.try_add(F.try_multiply(total, step), part), parts[1:], parts[0])
    return F.coalesce(F.when(F.bool_and(small), F.try_divide(total.cast("double") * 2.0**-64, F.count(x))), F.avg(x))


def index_of(x: Column, points: list[tuple], digits: int = 1) -> Column:
    """Piecewise linear index of a truncated concentration, half-even; above the table the last segment goes on."""
    c = truncated(x, digits)
    line = lambda p: F.bround(F.lit(float(p[2])) + (c - p[0]) * ((p[3] - p[2]) / (p[1] - p[0])), 0)
    chain = reduce(lambda w, p: w.when(c <= p[1], line(p)), points[1:], F.when(c <= points[0][1], line(points[0])))
    return F.when((x >= 0) & ~F.isnan(x) & (x < F.lit(float("inf"))), chain.otherwise(line(points[-1]))).cast("long")


def category(index: Column) -> Column:
    chain = reduce(lambda w, c: w.when(index <= c[0], c[1]), CATEGORIES, F.when(index.isNull(), "Unknown"))
    return chain.otherwise("Beyond Index")


def to_ppb(pollutant: Column, value: Column, unit: Column) -> Column:
    """Gas concentrations in ppb from ug/m3, mg/m3, ppm or ppb; null for an unknown gas or unit."""
    mass = reduce(lambda w, m: w.when(pollutant == m[0], m[1]), list(MOLAR_MASS.items())[1:], F.when(pollutant == "o3", MOLAR_MASS["o3"]))
    return (
        F.when(unit == "ppb", value).when(unit == "ppm", value * 1000).when(unit == "ug/m3", value * MOLAR_VOLUME / mass).when(unit == "mg/m3", value * 1000 * MOLAR_VOLUME / mass)
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees from 0 to 360."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "pre_monsoon").when(month.isin(6, 7, 8, 9), "monsoon").otherwise("post_monsoon")


def season_year(day: Column) -> Column:
    """The year in which the July-to-June season of a day begins."""
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


def local_day(ts: Column, hours: int = 5) -> Column:
    return (ts + F.expr(f"interval {hours} hours")).cast("date")


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")
