"""Wind as column expressions: components, directions, compass points, cones, vector means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sixteen points of the compass, and their degrees as instruments send them.
POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
POINT_DEGREES = [0, 23, 45, 68, 90, 113, 135, 158, 180, 203, 225, 248, 270, 293, 315, 338]


def from_degrees(u: Column, v: Column) -> Column:
    """The direction from which a wind of components east and north blows."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def vector_mean(degrees: Column, speeds: Column) -> Column:
    """An aggregate struct (deg, speed): direction of the mean vector of winds weighted by speed, null where they cancel
    out; rows without direction or speed are left out."""
    known = degrees.isNotNull() & speeds.isNotNull()
    u = F.avg(F.when(known, -speeds * F.sin(F.radians(degrees))))
    v = F.avg(F.when(known, -speeds * F.cos(F.radians(degrees))))
    return F.struct(F.when(F.hypot(u, v) >= 1e-9, from_degrees(u, v)).alias("deg"), F.avg(F.when(known, speeds)).alias("speed"))


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, from 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def compass(degrees: Column) -> Column:
    place = F.floor((degrees + 11.25) / 22.5) % len(POINTS)
    return F.when(degrees.isNotNull(), F.get(F.array(*map(F.lit, POINTS)), place.cast("int")))


def compass_degrees(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for point, degrees in zip(POINTS, POINT_DEGREES):
        out = out.when(F.upper(F.trim(name)) == point, degrees)
    return out
