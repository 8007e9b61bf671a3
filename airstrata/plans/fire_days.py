"""Days of fire detections: regions, duplicates across satellites, classes, rollups, exposure and outlook."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import bearing, rounded
from ..functions.wind import angle_between, compass, vector_mean
from ..operators import places, polygons
from ..operators.graph import components
from ..session import discard, staged, table
from ..sources.tables import sql, stations

# Km and minutes within which detections of different satellites are one fire.
DEDUP_KM, DEDUP_MINUTES = 1.0, 90
# Bits of the reasons, cropland shares, km to a listed source, harvest windows.
CROPLAND, MIXED, NONCROP, IN_WINDOW, NEAR_SOURCE, PERSISTENT, NIGHT, NO_MASK = 1, 2, 4, 8, 16, 32, 64, 128
CROP_HIGH, CROP_LOW, SOURCE_KM = 0.5, 0.2, 1.0
WINDOWS = (("04-15", "05-31"), ("09-15", "11-30"))
# Bands of upwind load in MW.
BANDS = ((100, "none"), (300, "low"), (1000, "elevated"), (3000, "high"))


#: The year before which detections are the reference of thin days, and the year from which days are thinned and judged.
REFERENCE_UNTIL, JUDGED_FROM = 1999, 1995


def fires(spark, sf_dir):
    """Detections with a place, a satellite, a confidence and, mostly, a time; of rows of one id the first."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct(*rest)).alias("_r")).select("l_orderkey", "l_linenumber", "_r.*")
    lat = F.round(24 + (F.col("l_suppkey") * 41 % 130) / 10.0 + (F.col("l_partkey") % 7) * 0.003, 4)
    lon = F.round(61 + (F.col("l_suppkey") * 59 % 160) / 10.0 + (F.col("l_partkey") % 5) * 0.003, 4)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("day"), lat.alias("lat"), lon.alias("lon"), F.col("l_quantity").alias("frp"),
        F.when(F.col("l_returnflag") == "R", "h").when(F.col("l_returnflag") == "N", "n").otherwise("l").alias("confidence"), F.element_at(F.array(F.lit("n20"), F.lit("n21"), F.lit("snpp")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("satellite"),
        F.when(F.col("l_orderkey") % 19 != 0, (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1440).alias("minute"),
    )


def regions(spark, sf_dir):
    """Star-shaped districts round the nations' places, rectangles as provinces, one country."""
    corner = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    n = F.col("n_nationkey")
    turn = F.radians(F.lit(36.0))
    point = lambda k: corner(F.round(25.3 + (n % 5) * 2.6 + (0.8 + 0.6 * (k % 2)) * F.sin(k * turn), 3), F.round(62.6 + F.floor(n / 5) * 3.2 + (0.8 + 0.6 * (k % 2)) * F.cos(k * turn), 3))
    nations = table(spark, sf_dir, "nation")
    districts = nations.select(F.lit("district").alias("kind"), F.col("n_name").alias("name"), F.lit(3).alias("priority"), F.transform(F.sequence(F.lit(0), F.lit(9)), point).alias("ring"))
    r = F.col("r_regionkey")
    box = lambda y1, y2, x1, x2: F.array(corner(y1, x1), corner(y2, x1), corner(y2, x2), corner(y1, x2))
    provinces = table(spark, sf_dir, "region").select(F.lit("province"), F.col("r_name"), F.lit(2), box(24.5005 + r * 0.2, 36.2005 - r * 0.1, 61.1005 + r * 3.1, 64.0005 + r * 3.1))
    country = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("country"), F.lit("inland"), F.lit(1), box(F.lit(25.0), F.lit(36.5), F.lit(61.5), F.lit(76.0)))
    return districts.union(provinces).union(country)


def _with_regions(spark, sf_dir, detections=None):
    """Detections with district, province and country; places are attributed once each, however many detections they have."""
    rows = (fires(spark, sf_dir) if detections is None else detections).withColumn("place", F.struct("lat", "lon"))
    spots = rows.select("lat", "lon").distinct().withColumn("place", F.struct("lat", "lon"))
    named = polygons.attributed(spots, regions(spark, sf_dir), "place", ["district", "province", "country"])
    return rows.join(named.drop("place"), ["lat", "lon"], "left").drop("place")


def regions_of_detections(spark, sf_dir):
    return _with_regions(spark, sf_dir).groupBy("district", "province", "country").agg(F.count("*").alias("n"), F.count_distinct("lat", "lon").alias("places"), rounded(F.sum("frp"), 2).alias("frp"))


def station_provinces(spark, sf_dir):
    """Stations with the province that holds them, the registered one, and what the audit says: kept near the border."""
    region = F.col("station") % 5
    names = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("registered"))
    rows = stations(spark, sf_dir).select("station", "lat", "lon", region.alias("rk")).join(names, "rk")
    provinces = regions(spark, sf_dir).where("kind = 'province'")
    rows = polygons.attributed(rows, provinces, "station", ["province"])
    near = polygons.near_border(rows, provinces, ["station"], "registered", 25.0).select("station", rounded("km", 3).alias("border_km"))
    rows = rows.join(near, "station", "left")
    verdict = F.when(F.col("province") == F.col("registered"), "match").when(F.col("border_km").isNotNull(), "kept").when(F.col("province").isNull(), "outside").otherwise("mismatch")
    return rows.select("station", "registered", "province", "border_km", verdict.alias("verdict"))


def _pairs(rows):
    """Pairs of one day that different satellites saw within the distance and, where both times are known, the minutes."""
    close = F.coalesce(F.abs(F.col("minute") - F.col("minute2")) <= DEDUP_MINUTES, F.lit(True))
    pairs = places.close_pairs(rows.select("day", "id", "satellite", "minute", "lat", "lon"), "id", DEDUP_KM, ["day"])
    return pairs.where((F.col("satellite") != F.col("satellite2")) & close)


def _grouped(spark, sf_dir):
    """Detections with the least id of their fire, `fire`, whether they are its strongest (`primary`), and whether any of
    it is of nominal or high confidence. They are written once, since what rests on them reads them several times."""
    seen = staged(fires(spark, sf_dir), "fires")
    group = components(_pairs(seen).select(F.col("id").alias("a"), F.col("id2").alias("b")))
    # Of the fires of several detections alone it must be asked which is the strongest.
    sure, w = F.col("confidence").isin("h", "n"), Window.partitionBy("label")
    several = seen.select("id", "frp", "confidence").join(group, F.col("id") == F.col("node"))
    several = several.select("id", F.col("label").alias("_fire"), (F.row_number().over(w.orderBy(F.desc("frp"), "id")) == 1).alias("_primary"), F.bool_or(sure).over(w).alias("_sure"))
    rows = _with_regions(spark, sf_dir, seen).join(several, "id", "left")
    rows = rows.withColumns({"fire": F.coalesce("_fire", "id"), "primary": F.coalesce("_primary", F.lit(True)), "sure": F.coalesce(F.col("_sure"), sure)})
    out = staged(rows.drop("_fire", "_primary", "_sure"), "fires-in-groups")
    discard(seen)
    return out


def dedup_groups(spark, sf_dir):
    """Every detection with its fire; groups are transitive."""
    return _grouped(spark, sf_dir).select("id", "fire", "primary", "sure")


def _mask(spark, sf_dir):
    """Cropland shares in percent on a grid of 0.05 degrees; 255 is no data."""
    rows = spark.range(264).select(F.col("id").alias("row")).crossJoin(spark.range(324).select(F.col("id").alias("col")))  # the grid's own size
    return rows.withColumn("share", F.when((F.col("row") + F.col("col")) % 3 == 0, 255).otherwise((F.floor(F.col("row") / 8) * 31 + F.floor(F.col("col") / 8) * 17) % 101))


def _crop_share(spark, sf_dir, spots):
    """(lat, lon, crop) of places: mean share of the nine cells around, null without data."""
    cell = lambda c, at: F.floor((F.col(c) - at) / 0.05)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    rows = spots.withColumn("_d", near).select("lat", "lon", (cell("lat", 24) + F.col("_d.i")).alias("row"), (cell("lon", 61) + F.col("_d.j")).alias("col"))
    rows = rows.join(_mask(spark, sf_dir).where("share <> 255"), ["row", "col"], "left")
    return rows.groupBy("lat", "lon").agg((F.avg("share") / 100).alias("crop"))


def block_shares(spark, sf_dir):
    """Mean cropland of blocks of 60 by 60 cells, and how many of them have data."""
    valid = F.when(F.col("share") != 255, F.col("share"))
    return _mask(spark, sf_dir).groupBy(F.floor(F.col("row") / 60).alias("by"), F.floor(F.col("col") / 60).alias("bx")).agg(rounded(F.avg(valid)).alias("mean"), F.count(valid).alias("n_valid"), F.count("*").alias("n_possible"))


def _in_window(day):
    md = F.date_format(day, "MM-dd")
    return md.between(*WINDOWS[0]) | md.between(*WINDOWS[1])


def _classified(spark, sf_dir):
    rows = _grouped(spark, sf_dir)
    spots = rows.select("lat", "lon").distinct()
    listed = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.round(24 + (F.col("s_suppkey") * 41 % 130) / 10.0, 4).alias("lat2"), F.round(61 + (F.col("s_suppkey") * 59 % 160) / 10.0, 4).alias("lon2"))
    near = places.within_radius(spots, listed, SOURCE_KM).select("lat", "lon").distinct().withColumn("listed", F.lit(True))
    cell = lambda d: F.shiftleft(F.floor((F.col("lat") + 90) / d).cast("long"), 20).bitwiseOR(F.floor((F.col("lon") + 180) / d).cast("long"))
    rows = rows.withColumn("cell", cell(0.02)).withColumn("in_window", _in_window(F.col("day")))
    lasting = rows.where("not in_window").groupBy("cell", F.year("day").alias("year")).agg(F.count_distinct("day").alias("days")).where("days >= 10").select("cell").distinct().withColumn("lasting", F.lit(True))
    rows = rows.join(_crop_share(spark, sf_dir, spots), ["lat", "lon"], "left").join(near, ["lat", "lon"], "left").join(lasting, "cell", "left")
    crop = F.col("crop")
    night = ~F.col("minute").between(180, 899)
    bits = [
        (crop >= CROP_HIGH, CROPLAND), ((crop < CROP_HIGH) & (crop >= CROP_LOW), MIXED), (crop < CROP_LOW, NONCROP), (crop.isNull(), NO_MASK),
        (F.col("in_window"), IN_WINDOW), (F.col("listed"), NEAR_SOURCE), (F.col("lasting"), PERSISTENT), (night, NIGHT),
    ]
    reasons = sum((F.when(F.coalesce(c, F.lit(False)), b).otherwise(0) for c, b in bits), F.lit(0))
    has = lambda m: F.col("reasons").bitwiseAND(F.lit(m)) != 0
    rows = rows.withColumn("reasons", reasons)
    return rows.withColumn("class", F.when(has(NONCROP | NEAR_SOURCE | PERSISTENT), "other").when(has(CROPLAND) & has(IN_WINDOW), "crop").otherwise("uncertain")).withColumn("daynight", F.when(night, "N").when(~night, "D"))


def classes(spark, sf_dir):
    """Detections by class and reasons."""
    return _classified(spark, sf_dir).groupBy("class", "reasons").agg(F.count("*").alias("n"), rounded(F.sum("frp"), 2).alias("frp"), rounded(F.avg("crop")).alias("crop"))


def fire_day_build(spark, sf_dir):
    """The rollup of every day: 22 measures by country, province and district, all from one aggregation."""
    rows = _classified(spark, sf_dir).withColumn("country", F.coalesce("country", F.lit("other")))
    sure, n20, head = F.col("confidence").isin("h", "n"), F.col("satellite") == "n20", F.col("primary") & F.col("sure")
    kind = F.col("class")
    n = lambda c, name: F.count_if(c).alias(name)
    mw = lambda c, name: F.sum(F.when(c, F.col("frp")).otherwise(0)).alias(name)
    counts = [
        n(F.lit(True), "n_raw"), n(sure, "n_hn"), n(F.col("primary"), "n_dedup"), n(head, "n_dedup_hn"), n(F.col("confidence") == "h", "n_high"), n(F.col("confidence") == "n", "n_nominal"), n(F.col("confidence") == "l", "n_low"),
        n(F.col("daynight") == "D", "n_day"), n(F.col("daynight") == "N", "n_night"), n(n20, "n_n20_raw"), n(n20 & sure, "n_n20_hn"), n(head & (kind == "crop"), "n_crop_hn"), n(head & (kind == "other"), "n_other_hn"),
        n(head & (kind == "uncertain"), "n_uncertain_hn"), n(n20 & sure & (kind == "crop"), "n_crop_n20_hn"),
    ]
    powers = [mw(F.lit(True), "frp_raw"), mw(sure, "frp_hn"), mw(head, "frp_dedup_hn"), mw(n20 & sure, "frp_n20_hn"), mw(head & (kind == "crop"), "frp_crop_hn"), mw(n20 & sure & (kind == "crop"), "frp_crop_n20_hn")]
    # Folded by day and all three regions first; the few rows of that go to each kind of region.
    fine = rows.groupBy("day", "country", "province", "district").agg(*counts, *powers, F.max("frp").alias("frp_max"))
    names = [c for c in fine.columns if c[:2] == "n_"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("region")) for k in ("country", "province", "district")]))
    out = fine.withColumn("_k", each).where("_k.region is not null").groupBy("day", "_k.kind", "_k.region")
    return out.agg(*[F.sum(c).alias(c) for c in names], *[rounded(F.sum(c), 1).alias(c) for c in fine.columns if c[:4] == "frp_" and c != "frp_max"], rounded(F.max("frp_max"), 1).alias("frp_max"))


def suspect_fire_days(spark, sf_dir):
    """Days of the peak months, of all years, with under a tenth of the median of the same dates in the reference years."""
    days = fires(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n"))
    thin = F.when((F.year("day") >= JUDGED_FROM) & (F.dayofmonth("day") % 9 == 0), F.floor(F.col("n") / 20)).otherwise(F.col("n"))
    days = days.withColumn("n", thin * 40).withColumn("doy", F.dayofyear("day"))
    near = days.where(F.year("day") < REFERENCE_UNTIL).select(F.explode(F.sequence(F.col("doy") - 3, F.col("doy") + 3)).alias("doy"), F.col("n").alias("m"))
    reference = near.groupBy("doy").agg(F.median("m").alias("reference"))  # a few years of seven days for each day of the year
    return days.where((F.year("day") >= JUDGED_FROM) & F.month("day").isin(4, 5, 10, 11)).join(reference, "doy").where("reference >= 200 and n < 0.1 * reference").select("day", F.col("n").cast("long").alias("n"), F.round("reference").cast("long").alias("reference"))


def _winds(spark, sf_dir):
    """Mean wind of each city and day: speed-weighted direction from which it blows, mean speed."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("city"), F.col("o_orderdate").cast("date").alias("day"), ((F.col("o_orderkey") * 37) % 360).cast("double").alias("deg"), (F.col("o_orderkey") % 12 + 0.5).alias("speed"))
    return rows.groupBy("city", "day").agg(vector_mean(F.col("deg"), F.col("speed")).alias("w")).select("city", "day", "w.deg", "w.speed")


def wind_means(spark, sf_dir):
    return _winds(spark, sf_dir).select("city", "day", rounded("deg", 1).alias("deg"), rounded("speed", 2).alias("speed"), compass(F.col("deg")).alias("compass")).groupBy("city", "compass").agg(F.count("*").alias("days"), rounded(F.avg("speed"), 2).alias("speed"))


def _cities(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("city"), (25.3 + (n % 5) * 2.6).alias("clat"), (62.6 + F.floor(n / 5) * 3.2).alias("clon"))


def _around(spark, sf_dir, km):
    """Fires within `km` of each city, with distance and bearing; places are paired with cities once."""
    rows = _grouped(spark, sf_dir).where("primary and sure")
    spots = rows.select("lat", "lon").distinct()
    pairs = places.within_radius(spots, _cities(spark, sf_dir).select("city", F.col("clat").alias("lat2"), F.col("clon").alias("lon2")), km)
    pairs = pairs.withColumn("bearing", bearing(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon"))).drop("lat2", "lon2")
    return rows.select("id", "day", "lat", "lon", "frp").join(pairs, ["lat", "lon"])


def fire_exposure(spark, sf_dir):
    """Fires round each city and day in rings, and upwind of it in a cone of 60 degrees to either side, with the power weighted by the angle's cosine."""
    rows = _around(spark, sf_dir, 200.0).join(_winds(spark, sf_dir), ["city", "day"], "left")
    off = angle_between(F.col("bearing"), F.col("deg"))
    cone = off <= 60
    # Nearest and strongest first by a struct, the id as the last word.
    return rows.groupBy("city", "day").agg(
        *[F.count_if(F.col("km") <= r).alias(f"fires_{r}km") for r in (50, 100, 200)], rounded(F.sum("frp"), 2).alias("frp"), F.count_if(cone).alias("upwind"), rounded(F.sum(F.when(cone, F.col("frp"))), 2).alias("frp_upwind"),
        rounded(F.sum(F.when(cone, F.col("frp") * F.cos(F.radians(off)))), 3).alias("frp_weighted"), rounded(F.min("km"), 3).alias("nearest_km"), F.min_by("id", F.struct("km", "id")).alias("nearest"), F.min_by("id", F.struct(-F.col("frp"), "id")).alias("strongest"),
    )


def smoke_outlook(spark, sf_dir):
    """For each city and day of the last season, and today's fires with the wind of the next three days: the power upwind and within 24 hours' reach, and its band."""
    near = _around(spark, sf_dir, 200.0).where("day >= date'1998-01-01'").withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("at", F.date_add("day", F.col("lead")))
    wind = _winds(spark, sf_dir).withColumnRenamed("day", "at")
    rows = near.join(wind, ["city", "at"], "left")
    reach = F.col("km") <= F.greatest(F.col("speed"), F.lit(1.0)) * 3.6 * 24
    upwind = (angle_between(F.col("bearing"), F.col("deg")) <= 60) & reach
    load = F.coalesce(F.sum(F.when(upwind, F.col("frp") * 30)), F.lit(0.0))
    out = rows.groupBy("city", "day", "lead").agg(F.max("deg").isNotNull().alias("known"), F.count("*").alias("fires"), F.count_if(upwind).alias("reachable"), rounded(load, 1).alias("load"))
    band = F.when(~F.col("known"), None)
    for most, name in BANDS:
        band = band.when(F.col("load") < most, name)
    return out.select("city", "day", "lead", "fires", "reachable", F.when(F.col("known"), F.col("load")).alias("load"), band.otherwise("very_high").alias("band"), F.when(F.col("known"), "ok").otherwise("no_forecast").alias("status"))


QUERIES = {f.__name__: f for f in (regions_of_detections, station_provinces, dedup_groups, block_shares, classes, fire_day_build, suspect_fire_days, wind_means, fire_exposure, smoke_outlook)}

_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
_F = """f0 AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate::DATE AS day, round(24 + (l_suppkey * 41 % 130) / 10.0::DOUBLE + (l_partkey % 7) * 0.003::DOUBLE, 4) AS lat, round(61 + (l_suppkey * 59 % 160) / 10.0::DOUBLE + (l_partkey % 5) * 0.003::DOUBLE, 4) AS lon,
    l_quantity AS frp, CASE l_returnflag WHEN 'R' THEN 'h' WHEN 'N' THEN 'n' ELSE 'l' END AS confidence, ['n20', 'n21', 'snpp'][l_linenumber % 3 + 1] AS satellite, CASE WHEN l_orderkey % 19 <> 0 THEN (l_orderkey * 7 + l_linenumber * 13) % 1440 END AS minute
    FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag) = 1))"""
_P = """e0 AS (SELECT 'district' AS kind, n_name AS name, 3 AS pr, k, round(25.3::DOUBLE + (n_nationkey % 5) * 2.6 + (0.8 + 0.6 * (k % 2)) * sin(k * radians(36.0)), 3) AS y, round(62.6::DOUBLE + (n_nationkey // 5) * 3.2 + (0.8 + 0.6 * (k % 2)) * cos(k * radians(36.0)), 3) AS x, 10 AS m FROM nation, range(10) t(k)
    UNION ALL SELECT 'province', r_name, 2, k, CASE WHEN k IN (0, 3) THEN 24.5005 + r_regionkey * 0.2 ELSE 36.2005 - r_regionkey * 0.1 END::DOUBLE, CASE WHEN k < 2 THEN 61.1005 + r_regionkey * 3.1 ELSE 64.0005 + r_regionkey * 3.1 END::DOUBLE, 4 FROM region, range(4) t(k)
    UNION ALL SELECT 'country', 'inland', 1, k, CASE WHEN k IN (0, 3) THEN 25.0 ELSE 36.5 END::DOUBLE, CASE WHEN k < 2 THEN 61.5 ELSE 76.0 END::DOUBLE, 4 FROM range(4) t(k)),
e AS (SELECT a.kind, a.name, a.pr, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM e0 a JOIN e0 b ON a.kind = b.kind AND a.name = b.name AND b.k = (a.k + 1) % a.m)"""
_HOLDS = "(y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1"
_R = f"""{_F}, {_P}, spots AS (SELECT DISTINCT lat, lon FROM f0), holds AS (SELECT lat, lon, kind, name FROM spots, e WHERE {_HOLDS} GROUP BY ALL HAVING count(*) % 2 = 1),
named AS (SELECT lat, lon, min(name) FILTER (kind = 'district') AS district, min(name) FILTER (kind = 'province') AS province, min(name) FILTER (kind = 'country') AS country FROM holds GROUP BY ALL),
f1 AS (SELECT f0.*, district, province, country FROM f0 LEFT JOIN named USING (lat, lon))"""
_G = f"""{_R}, pr AS (SELECT a.id AS a, b.id AS b FROM (SELECT day, id, satellite, minute, lat, lon FROM f1) a JOIN (SELECT day, id, satellite, minute, lat AS lat2, lon AS lon2 FROM f1) b ON a.day = b.day AND a.id < b.id AND a.satellite <> b.satellite
    AND abs(lat - lat2) < 0.02 AND abs(lon - lon2) < 0.03 AND coalesce(abs(a.minute - b.minute) <= 90, true) AND {_KM} <= 1.0),
reach(node, other) AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr UNION SELECT r.node, p.other FROM reach r JOIN (SELECT a AS node, b AS other FROM pr UNION SELECT b, a FROM pr) p ON r.other = p.node),
f2 AS (SELECT f1.*, least(f1.id, coalesce(m, f1.id)) AS fire FROM f1 LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) ON node = f1.id),
f3 AS (SELECT *, row_number() OVER (PARTITION BY fire ORDER BY frp DESC, id) = 1 AS "primary", bool_or(confidence IN ('h', 'n')) OVER (PARTITION BY fire) AS sure FROM f2)"""
_MASK = "mask AS (SELECT r AS row, c AS col, CASE WHEN (r + c) % 3 = 0 THEN 255 ELSE ((r // 8) * 31 + (c // 8) * 17) % 101 END AS share FROM range(264) t(r), range(324) u(c))"
_C = f"""{_G}, {_MASK},
crops AS (SELECT lat, lon, avg(share) / 100 AS crop FROM spots LEFT JOIN mask ON abs(row - floor((lat - 24) / 0.05)) <= 1 AND abs(col - floor((lon - 61) / 0.05)) <= 1 AND share <> 255 GROUP BY ALL),
src AS (SELECT round(24 + (s_suppkey * 41 % 130) / 10.0::DOUBLE, 4) AS lat2, round(61 + (s_suppkey * 59 % 160) / 10.0::DOUBLE, 4) AS lon2 FROM supplier WHERE s_suppkey % 10 = 0),
listed AS (SELECT DISTINCT lat, lon FROM spots, src WHERE {_KM} <= 1.0),
f4 AS (SELECT *, (floor((lat + 90) / 0.02)::BIGINT << 20) | floor((lon + 180) / 0.02)::BIGINT AS cell, strftime(day, '%m-%d') BETWEEN '04-15' AND '05-31' OR strftime(day, '%m-%d') BETWEEN '09-15' AND '11-30' AS in_window FROM f3),
lasting AS (SELECT DISTINCT cell FROM (SELECT cell, year(day) FROM f4 WHERE NOT in_window GROUP BY ALL HAVING count(DISTINCT day) >= 10)),
f5 AS (SELECT f4.*, crop, CASE WHEN minute IS NULL THEN NULL WHEN minute BETWEEN 180 AND 899 THEN 'D' ELSE 'N' END AS daynight,
    CASE WHEN crop >= 0.5 THEN 1 WHEN crop >= 0.2 THEN 2 WHEN crop IS NULL THEN 128 ELSE 4 END + CASE WHEN in_window THEN 8 ELSE 0 END + CASE WHEN listed.lat IS NOT NULL THEN 16 ELSE 0 END + CASE WHEN lasting.cell IS NOT NULL THEN 32 ELSE 0 END
    + CASE WHEN minute NOT BETWEEN 180 AND 899 THEN 64 ELSE 0 END AS reasons
    FROM f4 LEFT JOIN crops USING (lat, lon) LEFT JOIN listed USING (lat, lon) LEFT JOIN lasting USING (cell)),
f6 AS (SELECT *, CASE WHEN reasons & 52 <> 0 THEN 'other' WHEN reasons & 9 = 9 THEN 'crop' ELSE 'uncertain' END AS class FROM f5)"""
_N = {
    "n_raw": "true", "n_hn": "sure_", "n_dedup": '"primary"', "n_dedup_hn": "head", "n_high": "confidence = 'h'", "n_nominal": "confidence = 'n'", "n_low": "confidence = 'l'", "n_day": "daynight = 'D'", "n_night": "daynight = 'N'", "n_n20_raw": "n20", "n_n20_hn": "n20 AND sure_",
    "n_crop_hn": "head AND class = 'crop'", "n_other_hn": "head AND class = 'other'", "n_uncertain_hn": "head AND class = 'uncertain'", "n_crop_n20_hn": "n20 AND sure_ AND class = 'crop'",
}
_MW = {"frp_raw": "true", "frp_hn": "sure_", "frp_dedup_hn": "head", "frp_n20_hn": "n20 AND sure_", "frp_crop_hn": "head AND class = 'crop'", "frp_crop_n20_hn": "n20 AND sure_ AND class = 'crop'"}
_METRICS = ", ".join([f"count(*) FILTER ({c}) AS {n}" for n, c in _N.items()] + [f"round(coalesce(sum(frp) FILTER ({c}), 0) + 1e-9, 1) AS {n}" for n, c in _MW.items()] + ["round(max(frp) + 1e-9, 1) AS frp_max"])
_W = """w0 AS (SELECT o_custkey % 25 AS city, o_orderdate::DATE AS day, ((o_orderkey * 37) % 360)::DOUBLE AS d, o_orderkey % 12 + 0.5 AS s FROM orders),
w1 AS (SELECT city, day, avg(-s * sin(radians(d))) AS u, avg(-s * cos(radians(d))) AS v, avg(s) AS speed FROM w0 GROUP BY ALL),
w AS (SELECT city, day, CASE WHEN sqrt(u * u + v * v) >= 1e-9 THEN (630 - degrees(atan2(v, u))) % 360 END AS deg, speed FROM w1)"""
_A = f"""{_G}, {_W}, ct AS (SELECT n_nationkey AS city, 25.3::DOUBLE + (n_nationkey % 5) * 2.6 AS lat2, 62.6::DOUBLE + (n_nationkey // 5) * 3.2 AS lon2 FROM nation),
n0 AS (SELECT lat, lon, city, {_KM} AS km, (degrees(atan2(sin(radians(lon - lon2)) * cos(radians(lat)), cos(radians(lat2)) * sin(radians(lat)) - sin(radians(lat2)) * cos(radians(lat)) * cos(radians(lon - lon2)))) + 720) % 360 AS bearing FROM spots, ct),
near AS (SELECT f3.id, f3.day, frp, city, km, bearing FROM f3 JOIN n0 USING (lat, lon) WHERE "primary" AND sure AND km <= 200)"""
_OFF = "abs((bearing - deg + 540) % 360 - 180)"
ORACLE = {
    "regions_of_detections": sql(f"{_R} SELECT district, province, country, count(*) AS n, count(DISTINCT (lat, lon)) AS places, round(sum(frp) + 1e-9, 2) AS frp FROM f1 GROUP BY ALL"),
    "station_provinces": sql(f"""{_P}, st AS (SELECT s.station, lat, lon, r_name AS registered FROM s JOIN region ON r_regionkey = s.station % 5),
        pv AS (SELECT station, name FROM st, e WHERE kind = 'province' AND {_HOLDS} GROUP BY ALL HAVING count(*) % 2 = 1), p1 AS (SELECT station, min(name) AS province FROM pv GROUP BY ALL),
        dd AS (SELECT station, lat, lon, y1, x1, y2, x2, cos(radians(lat)) AS k FROM st JOIN e ON kind = 'province' AND name = registered),
        d1 AS (SELECT *, greatest(0.0, least(1.0, ((lon - x1) * k * (x2 - x1) * k + (lat - y1) * (y2 - y1)) / (pow((x2 - x1) * k, 2) + pow(y2 - y1, 2)))) AS t FROM dd),
        d2 AS (SELECT station, min(sqrt(pow((lon - x1) * k - t * (x2 - x1) * k, 2) + pow(lat - y1 - t * (y2 - y1), 2))) * 111.195 AS km, count(*) FILTER ({_HOLDS}) % 2 = 1 AS within FROM d1 GROUP BY ALL)
        SELECT st.station, registered, province, CASE WHEN within OR km <= 25 THEN round(km + 1e-9, 3) END AS border_km,
               CASE WHEN province = registered THEN 'match' WHEN within OR km <= 25 THEN 'kept' WHEN province IS NULL THEN 'outside' ELSE 'mismatch' END AS verdict FROM st LEFT JOIN p1 USING (station) JOIN d2 USING (station)"""),
    "dedup_groups": sql(f'{_G} SELECT id, fire, "primary", sure FROM f3').replace("WITH ", "WITH RECURSIVE ", 1),
    "block_shares": f"WITH {_MASK} SELECT row // 60 AS by, col // 60 AS bx, round(avg(share) FILTER (share <> 255) + 1e-9, 4) AS mean, count(*) FILTER (share <> 255) AS n_valid, count(*) AS n_possible FROM mask GROUP BY ALL",
    "classes": sql(f"{_C} SELECT class, reasons, count(*) AS n, round(sum(frp) + 1e-9, 2) AS frp, round(avg(crop), 4) AS crop FROM f6 GROUP BY ALL").replace("WITH ", "WITH RECURSIVE ", 1),
    "fire_day_build": sql(f"""{_C}, f7 AS (SELECT *, confidence IN ('h', 'n') AS sure_, "primary" AND sure AS head, satellite = 'n20' AS n20 FROM f6),
        f8 AS (SELECT *, 'country' AS kind, coalesce(country, 'other') AS region FROM f7 UNION ALL SELECT *, 'province', province FROM f7 WHERE province IS NOT NULL UNION ALL SELECT *, 'district', district FROM f7 WHERE district IS NOT NULL)
        SELECT day, kind, region, {_METRICS} FROM f8 GROUP BY day, kind, region""").replace("WITH ", "WITH RECURSIVE ", 1),
    "suspect_fire_days": sql(f"""{_F}, d0 AS (SELECT day, count(*) AS n FROM f0 GROUP BY day),
        d AS (SELECT day, dayofyear(day) AS doy, 40 * CASE WHEN year(day) >= {JUDGED_FROM} AND day(day) % 9 = 0 THEN floor(n / 20) ELSE n END AS n FROM d0),
        m AS (SELECT doy + k - 3 AS doy, median(n) AS reference FROM d, range(7) t(k) WHERE year(day) < {REFERENCE_UNTIL} GROUP BY ALL)
        SELECT day, n::BIGINT AS n, round(reference)::BIGINT AS reference FROM d JOIN m USING (doy) WHERE year(day) >= {JUDGED_FROM} AND month(day) IN (4, 5, 10, 11) AND reference >= 200 AND n < 0.1 * reference"""),
    "wind_means": sql(f"""{_W} SELECT city, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][floor((deg + 11.25) / 22.5)::INT % 16 + 1] AS compass, count(*) AS days,
        round(avg(round(speed + 1e-9, 2)) + 1e-9, 2) AS speed FROM w GROUP BY ALL"""),
    "fire_exposure": sql(f"""{_A}, x AS (SELECT near.*, deg, {_OFF} AS off FROM near LEFT JOIN w USING (city, day))
        SELECT city, day, count(*) FILTER (km <= 50) AS fires_50km, count(*) FILTER (km <= 100) AS fires_100km, count(*) AS fires_200km, round(sum(frp) + 1e-9, 2) AS frp, count(*) FILTER (off <= 60) AS upwind, round(sum(frp) FILTER (off <= 60) + 1e-9, 2) AS frp_upwind,
               round(sum(frp * cos(radians(off))) FILTER (off <= 60) + 1e-9, 3) AS frp_weighted, round(min(km) + 1e-9, 3) AS nearest_km, arg_min(id, (km, id)) AS nearest, arg_min(id, (-frp, id)) AS strongest FROM x GROUP BY city, day""").replace("WITH ", "WITH RECURSIVE ", 1),
    "smoke_outlook": sql(f"""{_A}, x AS (SELECT near.*, lead, deg, speed, {_OFF} <= 60 AND km <= greatest(speed, 1.0) * 86.4 AS up FROM (SELECT * FROM near, range(4) t(lead) WHERE near.day >= DATE '1998-01-01') near LEFT JOIN w ON w.city = near.city AND w.day = near.day + lead::INT),
        y AS (SELECT city, day, lead::INT AS lead, max(deg) IS NOT NULL AS known, count(*) AS fires, count(*) FILTER (up) AS reachable, round(coalesce(sum(frp * 30) FILTER (up), 0) + 1e-9, 1) AS load FROM x GROUP BY ALL)
        SELECT city, day, lead, fires, reachable, CASE WHEN known THEN load END AS load, CASE WHEN NOT known THEN NULL WHEN load < 100 THEN 'none' WHEN load < 300 THEN 'low' WHEN load < 1000 THEN 'elevated' WHEN load < 3000 THEN 'high' ELSE 'very_high' END AS band,
               CASE WHEN known THEN 'ok' ELSE 'no_forecast' END AS status FROM y""").replace("WITH ", "WITH RECURSIVE ", 1),
}
