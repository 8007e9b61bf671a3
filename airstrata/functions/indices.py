"""Index functions beyond the basic ones: policies above the table, bands, gases, heat, cells, cursors, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import EARTH_KM, MOLAR_MASS, MOLAR_VOLUME, PM10_POINTS, PM25_POINTS, index_of, truncated

# Breakpoints (low, high, index low, high), unit of the scale and decimals kept, by pollutant.
GASES = {
    "pm10": (PM10_POINTS, "ug/m3", 0),
    "o3": ([(0.000, 0.054, 0, 50), (0.055, 0.070, 51, 100), (0.071, 0.085, 101, 150), (0.086, 0.105, 151, 200), (0.106, 0.200, 201, 300)], "ppm", 3),
    "co": ([(0.0, 4.4, 0, 50), (4.5, 9.4, 51, 100), (9.5, 12.4, 101, 150), (12.5, 15.4, 151, 200), (15.5, 30.4, 201, 300), (30.5, 50.4, 301, 500)], "ppm", 1),
    "no2": ([(0, 53, 0, 50), (54, 100, 51, 100), (101, 360, 101, 150), (361, 649, 151, 200), (650, 1249, 201, 300), (1250, 2049, 301, 500)], "ppb", 0),
    "so2": ([(0, 35, 0, 50), (36, 75, 51, 100), (76, 185, 101, 150), (186, 304, 151, 200), (305, 604, 201, 300), (605, 1004, 301, 500)], "ppb", 0),
}
# Bands by their upper index.
BANDS = [(50, "good"), (100, "moderate"), (150, "unhealthy_sensitive"), (200, "unhealthy"), (300, "very_unhealthy")]
# Coefficients of the heat index in degrees Fahrenheit and percent: (factor, power of t, power of h).
HEAT = [(-42.379, 0, 0), (2.04901523, 1, 0), (10.14333127, 0, 1), (-0.22475541, 1, 1), (-0.00683783, 2, 0), (-0.05481717, 0, 2), (0.00122874, 2, 1), (0.00085282, 1, 2), (-0.00000199, 2, 2)]
CELL_DEGREES = 0.02


def above_table(x: Column) -> Column:
    return truncated(x) > PM25_POINTS[-1][1]


def pm25_index(x: Column, above: str = "extrapolate") -> Column:
    """The index; values beyond the table go on along its last line, stop at 500, or have none."""
    i = index_of(x, PM25_POINTS)
    if above == "cap":
        return F.when(i.isNotNull(), F.least(i, F.lit(500)))
    return F.when(~above_table(x), i) if above == "none" else i


def band(index: Column) -> Column:
    return reduce(lambda w, b: w.when(index <= b[0], b[1]), BANDS, F.when(index.isNull() | (index < 0), "unknown")).otherwise("hazardous")


def on_scale(gas: Column, value: Column, unit: Column) -> Column:
    """A concentration in the unit of its gas's table; null for a gas without table or a unit that is not known."""
    u = F.lower(F.trim(unit))
    mass = reduce(lambda w, m: w.when(gas == m[0], m[1]), list(MOLAR_MASS.items()), F.when(F.lit(False), F.lit(1.0)))
    ppb = F.when(u == "ppb", value).when(u == "ppm", value * 1000).when(u == "ug/m3", value * MOLAR_VOLUME / mass).when(u == "mg/m3", value * MOLAR_VOLUME / mass * 1000)
    ppm = [g for g, x in GASES.items() if x[1] == "ppm"]
    return F.when(gas == "pm10", F.when(u == "ug/m3", value)).when(gas.isin(*GASES), ppb / F.when(gas.isin(*ppm), 1000.0).otherwise(1.0))


def gas_index(gas: Column, scaled: Column) -> Column:
    """The index of a concentration on its gas's scale, cut to the table's decimals; null between and beyond its lines."""
    line = lambda p: F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("low", "high", "least", "most"), p)])
    tables = F.create_map(*[x for name, (points, _, _) in GASES.items() for x in (F.lit(name), F.array(*map(line, points)))])
    scale = F.element_at(F.create_map(*[x for name, (_, _, digits) in GASES.items() for x in (F.lit(name), F.lit(float(10**digits)))]), gas)
    c = F.floor(scaled * scale + F.lit(1e-9)) / scale
    own = F.get(F.filter(F.element_at(tables, gas), lambda p: c.between(p["low"], p["high"])), 0)
    return F.bround((own["most"] - own["least"]) / (own["high"] - own["low"]) * (c - own["low"]) + own["least"], 0).cast("long")


def heat_index(celsius: Column, humidity: Column) -> Column:
    """Degrees Celsius as they feel, to a tenth; below 80 degrees Fahrenheit the temperature itself."""
    t = celsius * 9 / 5 + 32
    terms = [reduce(lambda a, b: a * b, [t] * i + [humidity] * j, F.lit(f)) for f, i, j in HEAT]
    felt = (reduce(lambda a, b: a + b, terms) - 32) * 5 / 9
    return F.when(t < 80, celsius).otherwise(F.round(felt + F.lit(1e-9), 1))


def cell_id(lat: Column, lon: Column, size: float = CELL_DEGREES) -> Column:
    """The number of the grid cell of a point: its row above 20 bits of its column."""
    return F.shiftleft(F.floor((lat + 90) / size).cast("long"), 20).bitwiseOR(F.floor((lon + 180) / size).cast("long"))


def cell_centre(cell: Column, size: float = CELL_DEGREES) -> tuple[Column, Column]:
    return (F.shiftright(cell, 20) + 0.5) * size - 90, (cell.bitwiseAND(F.lit((1 << 20) - 1)) + 0.5) * size - 180


def cosine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance by the spherical law of cosines, its cosine kept within 1."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))


def acquired(day: Column, digits: Column) -> Column:
    """A time from a date and hours and minutes as three or four digits; null where they are no time."""
    four = F.lpad(F.trim(digits), 4, "0")
    return F.when(four.rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), four), F.lit("yyyy-MM-dd HHmm")).cast("timestamp_ntz"))


def day_night(hour: Column) -> Column:
    """D for passes from 3 to 15 hours UTC."""
    return F.when((hour >= 3) & (hour < 15), "D").when(hour.isNotNull(), "N")


def circular_days(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 366 - d)


def to_cursor(text: Column) -> Column:
    """Text as base64 for addresses, without padding."""
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("="))


def from_cursor(cursor: Column) -> Column:
    plain = F.translate(cursor, "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))).cast("string")


def redacted(url: Column) -> Column:
    """An address with the values of parameters that name secrets blotted out."""
    return F.regexp_replace(url, r"(?i)([?&](?:[a-z_]*(?:key|token|secret|password))=)[^&]*", "$1***")
