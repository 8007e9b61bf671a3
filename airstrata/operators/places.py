"""Operators on points: radius joins over a grid, nearest neighbours, clusters of cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import haversine_km
from ..session import discard, staged
from .graph import components
from .polygons import KM_PER_DEGREE


#: How many times the distance the cells are wide in which pairs of one table, or points and segments, meet: wider ones make fewer rows and more candidates.
WIDE = 4


def grid(km: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """A grid of the sphere for a distance, as three functions: the band of a latitude, how many columns a band has, and
    the column of a longitude among that many. Bands are `km` high at least; a band has as many columns as fit, `km` wide
    at least, at the latitude of its edge nearest a pole, one band further on."""
    high = km / 111.0

    def columns(y: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs((y - 1) * high - 90), F.abs((y + 2) * high - 90)))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / high).cast("int"))

    return lambda lat: F.floor((lat + 90) / high), columns, lambda lon, n: F.pmod(F.floor((lon + 180) / 360 * n), n)


def within_radius(a: DataFrame, b: DataFrame, km: float, also: Column | None = None) -> DataFrame:
    """Pairs of points (lat, lon in `a`; lat2, lon2 in `b`) at most `km` apart, with km; `also` is a further condition
    of the join, such as equal days, by which a cell of very many points is dealt out too.

    Points of `b` go to their own cell of the grid, points of `a` to the cells around theirs in three bands, round the date
    line; near a pole a band is one cell."""
    band, columns, column = grid(km)
    left = a.withColumn("_cy", F.explode(F.array(*[band(F.col("lat")) + i for i in (-1, 0, 1)]))).withColumn("_n", columns(F.col("_cy")))
    own = column(F.col("lon"), F.col("_n"))
    left = left.withColumn("_cx", F.explode(F.array_distinct(F.array(*[F.pmod(own + j, F.col("_n")) for j in (-1, 0, 1)]))))
    right = b.withColumn("_cy", band(F.col("lat2"))).withColumn("_cx", column(F.col("lon2"), columns(F.col("_cy"))))
    right = right.withColumnsRenamed({"_cy": "_by", "_cx": "_bx"})
    on = (F.col("_cy") == F.col("_by")) & (F.col("_cx") == F.col("_bx"))
    pairs = left.join(right, on if also is None else on & also).drop("_cy", "_cx", "_n", "_by", "_bx")
    return pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)


def close_pairs(points: DataFrame, key: str, km: float, same: list[str]) -> DataFrame:
    """Pairs (id, id2) of points (key, lat, lon) of one table that are equal in `same` and at most `km` apart, with km and
    the other columns, the second point's ending in 2; the lesser key comes first and each pair comes once.

    Cells are `WIDE` times as wide as the distance, and a point goes on to another cell only where it lies that near to it:
    to the next one and to the band to the north, since a pair across cells is found from one of its ends. So most points are
    one row of the join."""
    band, columns, column = grid(WIDE * km)
    rest = [c for c in points.columns if c not in same]
    left = points.withColumn("_by", band(F.col("lat"))).withColumn("_cy", F.explode(F.array_distinct(F.array(F.col("_by"), band(F.col("lat") + km / 111.0))))).withColumn("_n", columns(F.col("_cy")))
    own, reach = column(F.col("lon"), F.col("_n")), 360.0 / F.col("_n") / WIDE
    sides = [F.pmod(column(F.col("lon") + d * reach, F.col("_n")), F.col("_n")) for d in (-1, 1)]
    # In a band of two columns or less the next one may be the one before: there, a pair is found from both ends.
    both = (F.col("_cy") == F.col("_by")) & (F.col("_n") <= 2)
    steps = F.when(both, F.array(own, F.pmod(own + 1, F.col("_n")))).when(F.col("_cy") == F.col("_by"), F.array(own, sides[1])).otherwise(F.array(own, *sides))
    left = left.withColumn("_cx", F.explode(F.array_distinct(steps))).withColumn("_half", (F.col("_cy") == F.col("_by")) & ((F.col("_cx") == own) | both)).drop("_by", "_n")
    right = points.withColumn("_cy", band(F.col("lat"))).withColumn("_cx", column(F.col("lon"), columns(F.col("_cy")))).withColumnsRenamed({c: f"{c}2" for c in rest})
    pairs = left.join(right, [*same, "_cy", "_cx"]).where((F.col(key) != F.col(f"{key}2")) & (~F.col("_half") | (F.col(key) < F.col(f"{key}2"))))
    pairs = pairs.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("km") <= km)
    swap = F.col(key) > F.col(f"{key}2")
    ends = [F.when(swap, F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in rest] + [F.when(swap, F.col(c)).otherwise(F.col(f"{c}2")).alias(f"{c}2") for c in rest]
    return pairs.select(*same, *ends, "km")


def _dealt(points: DataFrame) -> DataFrame:
    """The places (lat, lon) of points, dealt to as many tasks as shuffles have: places are few bytes and many pairs, so
    tasks must not be put together by their bytes."""
    return points.select("lat", "lon").distinct().repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lat", "lon")


def places_within(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """(lat, lon, lat2, lon2, km): the places of points of `a` and `b` at most `km` apart, each pair of places once however
    many points stand there; points come back by joins on their place."""
    return within_radius(_dealt(a), b.select("lat2", "lon2").distinct(), km)


def nearest(a: DataFrame, b: DataFrame, key: str, key2: str, km: float, k: int) -> DataFrame:
    """(key, rank, key2, km): the k nearest points of `b` within `km` of each point of `a`; see `nearest_anywhere`."""
    return nearest_anywhere(a, b, key, key2, k, most=km)


def nearest_anywhere(a: DataFrame, b: DataFrame, key: str, key2: str, k: int, km: float | None = None, most: float | None = None) -> DataFrame:
    """(key, rank, key2, km): the k nearest points of `b` (lat2, lon2) to each point of `a` (lat, lon), however far or
    within `most` km.

    The search goes by places, which points may share, and by rings that double: a place meets those of `b` within the
    ring's distance and is done once these are k, since all others are further away. Only places that are not done go on,
    so where `b` is dense around all of `a` one ring does; the last ring is the whole sphere or `most`. The first is as wide
    as k places of `b` need on average, over the degrees that have any, or `km`. As each place holds a point, the k nearest
    points are in the k nearest places, and of one place the k least keys alone can be among them. Points without a place
    have no neighbours; equal distances go by the least key2."""
    points = b.select(key2, "lat2", "lon2").where("lat2 is not null and lon2 is not null")
    of = a.select(key, "lat", "lon").where("lat is not null and lon is not null").distinct()
    to = staged(points.groupBy("lat2", "lon2").agg(F.min(key2).alias("_first")), "places")
    n, degrees = to.agg(F.count("*"), F.count_distinct(F.floor("lat2"), F.floor("lon2"))).first()
    left = staged(of.select("lat", "lon").distinct(), "not-done")
    km, last = km or max(1.0, 111.0 * math.sqrt(max(degrees, 1) * k / (max(n, 1) * math.pi))), most or 20_038.0
    # Spark drops rows beyond the k-th within tasks, so that a place of many neighbours never fills a task.
    order = Window.partitionBy("lat", "lon").orderBy("km", "_first")
    near = lambda km: within_radius(_dealt(left), to, km).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    done = None
    while n:
        found = staged(near(min(km, last)), "nearest")
        whole = found.where(F.col("_rank") == min(k, n)).select("lat", "lon")
        ended = found if km >= last else found.join(whole, ["lat", "lon"], "left_semi")
        done = ended if done is None else done.union(ended)
        if km >= last:
            break
        before, left = left, staged(left.join(whole, ["lat", "lon"], "left_anti"), "not-done")
        discard(before)
        if left.isEmpty():
            break
        km *= 2
    done = near(km).limit(0) if done is None else done
    firsts = points.withColumn("_n", F.row_number().over(Window.partitionBy("lat2", "lon2").orderBy(key2))).where(F.col("_n") <= k)
    best = done.select("lat", "lon", "lat2", "lon2", "km").join(firsts, ["lat2", "lon2"])
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("km", key2))).where(F.col("rank") <= k)
    return of.join(best.select("lat", "lon", "rank", key2, "km"), ["lat", "lon"]).select(key, "rank", key2, "km")


def near_segments(points: DataFrame, segments: DataFrame, km: float, also: Column | None = None) -> DataFrame:
    """Pairs of points (lat, lon) and segments (lat1, lon1 to lat2, lon2) at most `km` apart, with `km`, and `along`, the
    place of the nearest point on the segment from 0 at its start to 1 at its end; each pair once. `also` is a further
    condition of the join, such as equal days, by which a cell of very many points is dealt out too. `cell_y` and `cell_x`
    are the point's cell, in which they met: what is grouped by them, the point's columns of `also` and more stays in its task.

    Cells are `WIDE` times as wide as the distance. A segment goes to the cells that it passes or comes that near to, band by
    band, so a long one does not fill its box and a short one is few rows; points go to their own cell. Segments take the
    short way round the date line. Distances are on a plane scaled at the point's latitude, for segments of up to some
    hundred kilometres; a segment of no length is a point."""
    band, columns, column = grid(WIDE * km)
    high, near = WIDE * km / 111.0, km / 111.0
    turn = lambda x: F.when(F.abs(x) <= 180, x).otherwise(F.pmod(x + 180, F.lit(360.0)) - 180)
    dx, dy, scale = F.col("_dx"), F.col("lat2") - F.col("lat1"), F.cos(F.radians("lat"))
    low, top = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = segments.withColumn("_dx", turn(F.col("lon2") - F.col("lon1"))).withColumn("_cy", F.explode(F.sequence(band(low - near), band(top + near)))).withColumn("_n", columns(F.col("_cy")))
    # The part of the segment within the band and as near to it, as shares of its length.
    share = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(y - F.col("lat1"), dy), F.lit(0.0))))
    south, north = share(F.col("_cy") * high - 90 - near), share((F.col("_cy") + 1) * high - 90 + near)
    ends = [F.col("lon1") + dx * F.when(dy == 0, 0.0).otherwise(south), F.col("lon1") + dx * F.when(dy == 0, 1.0).otherwise(north)]
    place, reach = lambda x: F.floor((x + 180) / 360 * F.col("_n")), 360.0 / F.col("_n") / WIDE
    first, last = place(F.least(*ends) - reach), place(F.greatest(*ends) + reach)
    cells = F.when(last - first >= F.col("_n"), F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)).otherwise(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_n").cast("long"))))
    rows = rows.withColumn("_cx", F.explode(cells)).drop("_n")
    at = points.withColumn("cell_y", band(F.col("lat"))).withColumn("cell_x", column(F.col("lon"), columns(F.col("cell_y"))))
    px, py = turn(F.col("lon") - F.col("lon1")), F.col("lat") - F.col("lat1")
    box = (F.abs(2 * py - dy) <= F.abs(dy) + 2 * near) & ((F.abs(2 * px - dx) - F.abs(dx)) * scale <= 2 * near)
    on = (F.col("_cy") == F.col("cell_y")) & (F.col("_cx") == F.col("cell_x")) & box
    pairs = at.join(rows, on if also is None else on & also)
    # Differences are taken as they are and terms in one order, so that a point on a limit is on it by a plain formula too.
    part = F.try_divide(px * scale * dx * scale + py * dy, F.pow(dx * scale, 2) + F.pow(dy, 2))
    # As a row of its own, `along` is computed once a pair that lies in the box; as a column it is copied into the join's conditions.
    pairs = pairs.withColumn("along", F.explode(F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)))))))
    away = F.sqrt(F.pow(px * scale - F.col("along") * dx * scale, 2) + F.pow(py - F.col("along") * dy, 2)) * KM_PER_DEGREE
    return pairs.withColumn("km", away).where(F.col("km") <= km).drop("_cy", "_cx", "_dx")


def segments_of(paths: DataFrame, keys: list[str], step: str, fields: list[str]) -> DataFrame:
    """The segments of paths (lat, lon by `step`): (keys, step, lat1, lon1, lat2, lon2) with each field at their start and,
    as field_2, at their end. Steps without a place are passed over; a path of one step is a segment of no length."""
    rows = paths.where("lat is not null and lon is not null")
    order = Window.partitionBy(*keys).orderBy(step)
    nexts = {c: F.lead(c).over(order) for c in ("lat", "lon", *fields)}
    rows = rows.withColumns({f"_{c}": v for c, v in nexts.items()}).withColumn("_alone", F.row_number().over(order) == 1)
    rows = rows.where("_lat is not null or _alone")
    end = lambda c: F.when(F.col("_lat").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
    return rows.select(*keys, step, F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), end("lat").alias("lat2"), end("lon").alias("lon2"), *fields, *[end(c).alias(f"{c}_2") for c in fields])


def cell_clusters(cells: DataFrame, group: str) -> DataFrame:
    """Clusters of cells (cy, cx: 0 to 2**20 - 1) that touch, diagonals included, within each group; the label is the
    least cell. Groups may be large: cells meet their neighbours in joins and labels spread by components."""
    cell = lambda y, x: (y.cast("long") * (1 << 20) + x).alias("cell")
    own = staged(cells.select(group, "cy", "cx").distinct().select(group, cell(F.col("cy"), F.col("cx"))), "cells")
    # Nodes are numbers: a hash of group and cell; the least node of a cluster then tells its least cell.
    node = lambda c: F.xxhash64(group, c)
    step = F.explode(F.array(*[F.lit(d) for d in (1, (1 << 20) - 1, 1 << 20, (1 << 20) + 1)]))
    beside = own.withColumn("step", step).select(group, F.col("cell").alias("from"), (F.col("cell") + F.col("step")).alias("cell"))
    edges = beside.join(own, [group, "cell"]).select(node("from").alias("a"), node("cell").alias("b"))
    rows = own.withColumn("node", node("cell")).join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = staged(rows.select(group, "cell", "label"), "labels")
    least = rows.groupBy(group, "label").agg(F.min("cell").alias("least"))
    part = lambda c: (F.floor(F.col(c) / (1 << 20)).cast("long"), F.pmod(F.col(c), F.lit(1 << 20)).cast("long"))
    (cy, cx), (ly, lx) = part("cell"), part("least")
    return rows.join(least, [group, "label"]).select(group, cy.alias("cy"), cx.alias("cx"), ly.alias("cluster_y"), lx.alias("cluster_x"))
