"""Selections built from options: station lists, areas, places by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km


def stations_where(df: DataFrame, country: str | None = None, cities: list[str] | None = None, ids: list[int] | None = None, providers: list[str] | None = None, box: tuple | None = None, pattern: str | None = None, shadow: str | None = None) -> DataFrame:
    """Stations that pass every option given; a `shadow` provider is left out unless `providers` names it. Lists of
    options are short; a large set of ids is to be joined."""
    if country is not None:
        df = df.where(F.lower("country") == country.lower())
    if cities is not None:
        df = df.where(F.lower("city").isin([c.lower() for c in cities]))
    if ids is not None:
        df = df.where(F.col("station").isin(ids))
    if providers is not None:
        df = df.where(F.col("provider").isin(providers))
    elif shadow is not None:
        df = df.where(F.coalesce(F.col("provider") != shadow, F.lit(True)))
    if box is not None:
        df = df.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    return df.where(F.col("name").ilike(pattern)) if pattern is not None else df


def area(df: DataFrame, kind: str, what) -> DataFrame:
    """The stations of an area: all, a country, a city, or a radius (lat, lon, km)."""
    if kind == "national":
        return df
    if kind == "radius":
        return df.where(haversine_km(F.col("lat"), F.col("lon"), F.lit(what[0]), F.lit(what[1])) <= what[2])
    if kind not in ("country", "city"):
        raise ValueError(f"an area is national, country, city or radius, not {kind!r}")
    return df.where(F.lower(kind) == what.lower())


def resolved(asked: DataFrame, name: str, lookups: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """`asked` with the kind and place (lat, lon) of the first lookup (kind, table, its name column) that knows each
    name, whatever its case; nulls where none does."""
    out, kind, lat, lon = asked, None, [], []
    for i, (label, table, column) in enumerate(lookups):
        own = table.groupBy(F.lower(column).alias(f"_k{i}")).agg(F.avg("lat").alias(f"_y{i}"), F.avg("lon").alias(f"_x{i}"))
        out = out.join(own, F.lower(F.col(name)) == F.col(f"_k{i}"), "left")
        hit = F.col(f"_k{i}").isNotNull()
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
        lat.append(f"_y{i}")
        lon.append(f"_x{i}")
    return out.select(*asked.columns, kind.alias("kind"), F.coalesce(*lat).alias("lat"), F.coalesce(*lon).alias("lon"))
