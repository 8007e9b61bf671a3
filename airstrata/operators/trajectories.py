"""Paths of air parcels through a gridded wind, and what they pass.

A field is rows (group, hour, level, row, col, u, v), wind in m/s at whole steps of a grid; starts are rows (group,
id, hour, lat, lon, level). A group is a run: its field and its starts meet in one task, which its grid and hours bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wind import angle_between

METRES_PER_DEGREE = 111_195.0
PATH = "id long, step int, hour double, lat double, lon double, level double"


class Field:
    """A wind on a grid, linear in place, in hours and in the logarithm of the level; beyond its edges the edge's."""

    def __init__(self, pdf: pd.DataFrame, lat0: float, lon0: float, degrees: float):
        self.lat0, self.lon0, self.degrees = lat0, lon0, degrees
        self.axes = [np.unique(pdf[c].to_numpy()) for c in ("hour", "level", "row", "col")]
        at = tuple(np.searchsorted(a, pdf[c].to_numpy()) for a, c in zip(self.axes, ("hour", "level", "row", "col")))
        self.wind = np.full((*map(len, self.axes), 2), np.nan)
        self.wind[at] = pdf[["u", "v"]].to_numpy()
        self.axes[1] = np.log(self.axes[1].astype(float))

    def __call__(self, hour: np.ndarray, level: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        places = (hour, np.log(level), (lat - self.lat0) / self.degrees, (lon - self.lon0) / self.degrees)
        low, part = [], []
        for axis, x in zip(self.axes, places):
            x = np.clip(x, axis[0], axis[-1])
            i = np.clip(np.searchsorted(axis, x, "right") - 1, 0, max(len(axis) - 2, 0))
            width = axis[np.minimum(i + 1, len(axis) - 1)] - axis[i]
            low.append(i)
            part.append(np.divide(x - axis[i], width, out=np.zeros(len(x)), where=width > 0))
        out = np.zeros((len(hour), 2))
        for corner in range(16):
            weight, at = np.ones(len(hour)), []
            for k in range(4):
                up = corner >> k & 1
                weight = weight * (part[k] if up else 1 - part[k])
                at.append(np.minimum(low[k] + up, len(self.axes[k]) - 1))
            out += np.where(weight[:, None] > 0, weight[:, None] * self.wind[tuple(at)], 0.0)
        return out


def integrated(starts: DataFrame, field: DataFrame, hours: int, lat0: float, lon0: float, degrees: float, step_hours: float = 1.0, back: bool = True, corrections: int = 2) -> DataFrame:
    """(group, id, step, hour, lat, lon, level) of each start's path, by a predictor with the wind at hand and
    corrections with the mean of it and that at the place it leads to."""
    sign = -1.0 if back else 1.0

    def walk(own: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        if own.empty or grid.empty:
            return pd.DataFrame(columns=["group", "id", "step", "hour", "lat", "lon", "level"])
        wind = Field(grid, lat0, lon0, degrees)
        lat, lon, level, hour = (own[c].to_numpy(float) for c in ("lat", "lon", "level", "hour"))
        out = [(np.zeros(len(own), int), hour, lat, lon)]
        for n in range(1, int(hours / step_hours) + 1):
            first = wind(hour, level, lat, lon)
            mean, after = first, hour + sign * step_hours
            for _ in range(corrections + 1):
                y = lat + sign * mean[:, 1] * step_hours * 3600 / METRES_PER_DEGREE
                x = lon + sign * mean[:, 0] * step_hours * 3600 / (METRES_PER_DEGREE * np.cos(np.radians((lat + y) / 2)))
                mean = (first + wind(after, level, y, x)) / 2
            lat, lon, hour = y, x, after
            out.append((np.full(len(own), n), hour, lat, lon))
        steps = len(out)
        step, hour, lat, lon = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"group": np.tile(own["group"], steps), "id": np.tile(own["id"], steps), "step": step, "hour": hour, "lat": lat, "lon": lon, "level": np.tile(level, steps)})

    kind = dict(starts.dtypes)["group"]
    return starts.groupBy("group").cogroup(field.groupBy("group")).applyInPandas(walk, f"group {kind}, {PATH}")


def members(starts: DataFrame, shift: float) -> DataFrame:
    """Nine starts for each: itself and its eight neighbours at `shift` degrees, told by `member`."""
    around = F.array(*[F.struct(F.lit(3 * (i + 1) + j + 1).alias("member"), F.lit(i * shift).alias("dy"), F.lit(j * shift).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = starts.withColumn("_m", F.explode(around))
    return rows.select("group", (F.col("id") * 9 + F.col("_m.member")).alias("id"), "hour", (F.col("lat") + F.col("_m.dy")).alias("lat"), (F.col("lon") + F.col("_m.dx")).alias("lon"), "level")


def sectors(paths: DataFrame, bearing: Column, width: float = 45.0) -> DataFrame:
    """(group, sector, share, agrees): shares of path points by sector of their bearing, and whether most points lie
    within one sector to either side of the main one."""
    rows = paths.withColumn("sector", (F.floor(F.pmod(bearing + width / 2, F.lit(360.0)) / width) * width).cast("double")).groupBy("group", "sector").agg(F.count("*").alias("n"))
    total = rows.groupBy("group").agg(F.sum("n").alias("total"), F.max_by("sector", F.struct("n", -F.col("sector"))).alias("main"))
    rows = rows.join(total, "group")
    near = rows.groupBy("group").agg((F.sum(F.when(angle_between(F.col("sector"), F.col("main")) <= width, F.col("n")).otherwise(0)) / F.max("total") >= 0.7).alias("agrees"))
    return rows.join(near, "group").select("group", "sector", (F.col("n") / F.col("total")).alias("share"), (F.col("sector") == F.col("main")).alias("main"), "agrees")


def strict_matches(paths: DataFrame, fires: DataFrame, pairs: DataFrame, mixed: str = "mixed_top", level: str = "height", km: float = 10.0, hours: float = 1.0) -> DataFrame:
    """Pairs of path points and fires near each other, marked `strict` where the parcel is within the mixed layer, `km`
    and `hours`; the others are loose."""
    rows = pairs.join(paths, ["id", "step"]).join(fires, "fire")
    strict = (F.col("km") <= km) & (F.abs(F.col("hour") - F.col("fire_hour")) <= hours) & (F.col(level) <= F.col(mixed))
    return rows.withColumn("strict", F.coalesce(strict, F.lit(False)))


def parsed_endpoints(lines: DataFrame) -> DataFrame:
    """(trajectory, age, lat, lon, height) of the endpoint lines of a model's text output: lines of 12 or more numbers."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(cells) >= 12).select(*[F.get(cells, i).try_cast("double").alias(c) for c, i in (("trajectory", 0), ("age", 8), ("lat", 9), ("lon", 10), ("height", 11))])
    return rows.where("trajectory is not null and age is not null and lat is not null and lon is not null").withColumn("trajectory", F.col("trajectory").cast("int"))


def planned_clusters(cells: DataFrame, power: str = "frp", share: float = 0.75) -> DataFrame:
    """Cells of a day at or above the quantile of their power: where runs are to start."""
    limit = cells.groupBy("day").agg(F.percentile(power, F.lit(share)).alias("_least"))  # cells of a day: bounded by the grid
    return cells.join(limit, "day").where(F.col(power) >= F.col("_least")).drop("_least")
