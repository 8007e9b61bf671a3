"""What may lie behind a city's day, and what it asks for: drivers of a forecast, episodes of smoke, decisions by city."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import rounded
from ..functions.wind import angle_between
from ..operators import places
from ..session import staged, table
from ..sources.tables import sql, stations
from . import fire_days
from .observations import _days

# Levels that drivers are told by.
ELEVATED, SMOKE, HIGH_MEDIAN, MEDIAN = 75, 150, 75, 50
# An episode's rise over the days before, as a ratio and in ug/m3, and the share of upwind days that its fires exceed.
RISE, RISE_LEAST, UPWIND_SHARE = 1.2, 10.0, 0.75
# Share of children, levels for schools and hospitals, and the people from which each advice is given.
CHILDREN, SCHOOL, HOSPITAL = 0.35, 75.0, 150.0
ADVICE = {"school": ((100_000, "closure_recommended"), (10_000, "outdoor_restriction"), (None, "monitor")), "hospital": ((50_000, "high"), (5_000, "moderate"), (None, "low"))}
#: Km around people within which a kiln presses on them, and what a day's peak over its mean is called a ramp.
KILN_KM, RAMP = 25.0, 60.0


def forecast_drivers(spark, sf_dir):
    """Shares of stagnation, fires, transport and local causes in each city's day, as the day's station means tell that are
    taken for its forecast: many elevated and alike, ramps with very high values, great differences, or none of these."""
    days = _days(spark, sf_dir).where("pm25 is not null").join(stations(spark, sf_dir).select("station", "city"), "station")
    x = days.groupBy("city", "day").agg(
        F.count("*").alias("n"), F.avg("pm25").alias("mean"), F.max("pm25").alias("most"), (F.max("pm25") - F.min("pm25")).alias("spread"), F.avg((F.col("pm25") > ELEVATED).cast("int")).alias("high"),
        F.avg((F.col("pm25_max") - F.col("pm25") > RAMP).cast("int")).alias("ramp"), F.get(F.array_sort(F.collect_list("pm25")), F.floor(F.count("*") / 2).cast("int")).alias("median"),  # stations of a city
    )
    x = x.withColumn("cv", F.coalesce(F.try_divide("spread", "mean"), F.lit(0.0)))
    high, cv, ramp, most, median = (F.col(c) for c in ("high", "cv", "ramp", "most", "median"))
    at_most = lambda limit, value: F.least(F.lit(limit), value)
    x = x.withColumns({
        "stagnation": F.when((high > 0.6) & (cv < 0.5), at_most(0.9, 0.3 + high * 0.5 + (1 - cv) * 0.2)).when(high > 0.3, 0.2 + high * 0.3).otherwise(0.0),
        "fire": F.when((ramp > 0) & (most > SMOKE), at_most(0.9, ramp * 0.6 + (most - SMOKE) / 300)).otherwise(ramp * 0.4),
        "transport": F.when((cv > 0.6) & (median > MEDIAN), at_most(0.8, cv * 0.5 + 0.1)).when((cv > 0.3) & (median > HIGH_MEDIAN), cv * 0.3).otherwise(0.0),
    })
    names = ["stagnation", "fire", "transport", "local"]
    x = x.withColumn("local", at_most(0.7, F.greatest(F.lit(0.0), 1 - F.col("stagnation") - F.col("fire") - F.col("transport"))))
    total = sum(F.col(c) for c in names)
    x = x.withColumns({c: F.col(c) / total for c in names})
    main = F.array_max(F.array(*[F.struct(F.col(c).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(names)]))["c"]
    return x.select("city", "day", "n", rounded("median").alias("median"), *[rounded(c).alias(c) for c in names], main.alias("main"))


def smoke_episodes(spark, sf_dir):
    """Candidate episodes: a city's days whose value rises over the mean of the three days before, two of them known, while
    the power of fires upwind, that day or the day before, is above the upper quartile of the city's days. A screen only."""
    near = fire_days._around(spark, sf_dir, 200.0).join(fire_days._winds(spark, sf_dir), ["city", "day"])
    upwind = near.groupBy("city", "day").agg(F.coalesce(F.sum(F.when(angle_between(F.col("bearing"), F.col("deg")) <= 60, F.col("frp"))), F.lit(0.0)).alias("up"))
    values = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("city"), F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 1000).alias("pm25"))
    limits = upwind.groupBy("city").agg(F.percentile("up", F.lit(UPWIND_SHARE)).alias("limit"), F.count("*").alias("n_up"))  # days of a city
    series = staged(values.join(upwind, ["city", "day"], "full_outer"), "city-days")
    # Days before by their dates, not their rows: a calendar with gaps needs no spine.
    w = Window.partitionBy("city").orderBy(F.unix_date("day"))
    before, since = w.rangeBetween(-3, -1), w.rangeBetween(-1, 0)
    rows = series.withColumns({"base": F.when(F.count("pm25").over(before) >= 2, F.avg("pm25").over(before)), "_up": F.max("up").over(since)}).join(limits, "city")
    hit = (F.col("n_up") >= 4) & (F.col("_up") > F.col("limit")) & (F.col("pm25") >= RISE * F.col("base")) & (F.col("pm25") - F.col("base") >= RISE_LEAST)
    return rows.where(hit).select("city", "day", rounded("pm25", 3).alias("pm25"), rounded("base", 3).alias("base"), rounded("_up", 2).alias("upwind"), rounded("limit", 2).alias("limit"))


def _advice(kind, people):
    out = None
    for least, name in ADVICE[kind]:
        out = F.when(people > least, name) if out is None else out.otherwise(name) if least is None else out.when(people > least, name)
    return out


def decision_heads(spark, sf_dir):
    """Of each city, from the hazard at its people's places: children above the schools' level and their burden, people above
    the hospitals' and theirs, kilns and the people whom they press on, how far its people are from a site, and the advice."""
    j = F.col("s_suppkey")
    sites = table(spark, sf_dir, "supplier").select(j.alias("site"), (24 + (j * 41 % 1300) / 100.0).alias("lat2"), (61 + (j * 59 % 1600) / 100.0).alias("lon2"), (j * 17 % 300).cast("double").alias("v"), F.element_at(F.array(F.lit("school"), F.lit("hospital"), F.lit("kiln")), (j % 3 + 1).cast("int")).alias("kind"), F.col("s_nationkey").alias("nation"))
    people = stations(spark, sf_dir).select("station", "city", "lat", "lon", (F.col("station") % 1000 + 1).alias("people"))
    near = staged(places.nearest_anywhere(people, sites, "station", "site", 8), "nearest-sites")
    weight = 1 / F.pow(F.greatest("km", F.lit(0.001)), 2)
    surface = near.join(sites.select("site", "v"), "site").groupBy("station").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("h"), F.min("km").alias("km"))
    at = sites.where("kind = 'kiln'").groupBy("lat2", "lon2").agg(F.count("*").alias("c"))
    kilns = places.places_within(people, at, KILN_KM).join(at, ["lat2", "lon2"]).groupBy("lat", "lon").agg(F.sum("c").alias("kilns"))
    rows = people.join(surface, "station").join(kilns, ["lat", "lon"], "left").withColumn("kilns", F.coalesce("kilns", F.lit(0)))
    h, n = F.col("h"), F.col("people")
    out = rows.groupBy("city").agg(
        (CHILDREN * F.sum(F.when(h > SCHOOL, n).otherwise(0))).alias("children"), rounded(CHILDREN * F.sum(n * F.greatest(h - SCHOOL, F.lit(0.0))), 1).alias("child_burden"),
        F.sum(F.when(h > HOSPITAL, n).otherwise(0)).alias("patients"), rounded(F.sum(n * F.greatest(h - HOSPITAL, F.lit(0.0))), 1).alias("hospital_burden"),
        F.sum(n * F.col("kilns")).alias("kiln_pressure"), rounded(F.avg("km"), 3).alias("mean_km"), F.sum(F.when(F.col("km") > 10, n).otherwise(0)).alias("far_people"),
    )
    of = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    assets = sites.join(of, F.col("nation") == F.col("n_nationkey")).groupBy("city").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("school", "hospital", "kiln")])
    out = out.join(assets, "city", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("schools", "hospitals", "kilns")})
    return out.withColumns({"school_advice": _advice("school", F.col("children")), "hospital_alert": _advice("hospital", F.col("patients")), "children": rounded("children", 1)})


QUERIES = {f.__name__: f for f in (forecast_drivers, smoke_episodes, decision_heads)}

_KM = fire_days._KM
_CASE = {k: "CASE " + " ".join(f"WHEN {c} > {least} THEN '{name}'" if least else f"ELSE '{name}'" for least, name in ADVICE[k]) + " END" for k, c in (("school", "children"), ("hospital", "patients"))}


def _drivers_sql():
    from .observations import _DAY

    return f"""{_DAY}, x AS (SELECT city, day, count(*) AS n, avg(pm25) AS mean, max(pm25) AS most, max(pm25) - min(pm25) AS spread, avg((pm25 > {ELEVATED})::INT) AS high, avg((pm25_max - pm25 > {RAMP})::INT) AS ramp, list_sort(list(pm25))[count(*) // 2 + 1] AS median
            FROM d JOIN s USING (station) WHERE pm25 IS NOT NULL GROUP BY ALL), y AS (SELECT *, coalesce(spread / nullif(mean, 0), 0) AS cv FROM x),
        z AS (SELECT *, CASE WHEN high > 0.6 AND cv < 0.5 THEN least(0.9, 0.3 + high * 0.5 + (1 - cv) * 0.2) WHEN high > 0.3 THEN 0.2 + high * 0.3 ELSE 0 END::DOUBLE AS st, CASE WHEN ramp > 0 AND most > {SMOKE} THEN least(0.9, ramp * 0.6 + (most - {SMOKE}) / 300) ELSE ramp * 0.4 END::DOUBLE AS fi,
            CASE WHEN cv > 0.6 AND median > {MEDIAN} THEN least(0.8, cv * 0.5 + 0.1) WHEN cv > 0.3 AND median > {HIGH_MEDIAN} THEN cv * 0.3 ELSE 0 END::DOUBLE AS tr FROM y),
        u AS (SELECT *, least(0.7, greatest(0.0, 1 - st - fi - tr))::DOUBLE AS lo FROM z), t AS (SELECT *, st + fi + tr + lo AS total FROM u)
        SELECT city, day, n, round(median, 4) AS median, round(st / total, 4) AS stagnation, round(fi / total, 4) AS fire, round(tr / total, 4) AS transport, round(lo / total, 4) AS local,
               CASE WHEN st >= greatest(fi, tr, lo) THEN 'stagnation' WHEN fi >= greatest(tr, lo) THEN 'fire' WHEN tr >= lo THEN 'transport' ELSE 'local' END AS main FROM t"""


ORACLE = {
    "forecast_drivers": sql(_drivers_sql()),
    "smoke_episodes": sql(f"""{fire_days._A}, u AS (SELECT city, near.day, coalesce(sum(frp) FILTER ({fire_days._OFF} <= 60), 0) AS up FROM near JOIN w USING (city, day) GROUP BY ALL), p AS (SELECT o_custkey % 25 AS city, o_orderdate::DATE AS day, avg(o_totalprice) / 1000 AS pm25 FROM orders GROUP BY ALL),
        l AS (SELECT city, quantile_cont(up, {UPWIND_SHARE}) AS lim, count(*) AS n_up FROM u GROUP BY city), j AS (SELECT coalesce(p.city, u.city) AS city, coalesce(p.day, u.day) AS day, pm25, up FROM p FULL JOIN u ON p.city = u.city AND p.day = u.day),
        k AS (SELECT *, CASE WHEN count(pm25) OVER b >= 2 THEN avg(pm25) OVER b END AS base, max(up) OVER (PARTITION BY city ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS up2 FROM j WINDOW b AS (PARTITION BY city ORDER BY day RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
        SELECT city, day, round(pm25 + 1e-9, 3) AS pm25, round(base + 1e-9, 3) AS base, round(up2 + 1e-9, 2) AS upwind, round(lim + 1e-9, 2) AS "limit" FROM k JOIN l USING (city) WHERE n_up >= 4 AND up2 > lim AND pm25 >= {RISE} * base AND pm25 - base >= {RISE_LEAST}""").replace("WITH ", "WITH RECURSIVE ", 1),
    "decision_heads": sql(f"""z AS (SELECT s_suppkey AS site, 24 + (s_suppkey * 41 % 1300) / 100.0::DOUBLE AS lat2, 61 + (s_suppkey * 59 % 1600) / 100.0::DOUBLE AS lon2, (s_suppkey * 17 % 300)::DOUBLE AS v, ['school', 'hospital', 'kiln'][s_suppkey % 3 + 1] AS kind, s_nationkey FROM supplier),
        p AS (SELECT station, city, site, v, kind, {_KM} AS km FROM s, z), k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, site) AS rank FROM p), h AS (SELECT station, sum(v / pow(greatest(km, 0.001), 2)) / sum(1 / pow(greatest(km, 0.001), 2)) AS h, min(km) AS km FROM k WHERE rank <= 8 GROUP BY station),
        q AS (SELECT station, count(*) AS kilns FROM p WHERE kind = 'kiln' AND km <= {KILN_KM} GROUP BY station), y AS (SELECT city, h, km, coalesce(kilns, 0) AS kilns, s.station % 1000 + 1 AS n FROM s JOIN h USING (station) LEFT JOIN q USING (station)),
        a AS (SELECT n_name AS city, count(*) FILTER (kind = 'school') AS schools, count(*) FILTER (kind = 'hospital') AS hospitals, count(*) FILTER (kind = 'kiln') AS kilns FROM z JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
        b AS (SELECT city, {CHILDREN} * sum(CASE WHEN h > {SCHOOL} THEN n ELSE 0 END)::DOUBLE AS children, round({CHILDREN} * sum(n * greatest(h - {SCHOOL}, 0)) + 1e-9, 1) AS child_burden, sum(CASE WHEN h > {HOSPITAL} THEN n ELSE 0 END)::BIGINT AS patients, round(sum(n * greatest(h - {HOSPITAL}, 0)) + 1e-9, 1) AS hospital_burden,
              sum(n * kilns)::BIGINT AS kiln_pressure, round(avg(km) + 1e-9, 3) AS mean_km, sum(CASE WHEN km > 10 THEN n ELSE 0 END)::BIGINT AS far_people FROM y GROUP BY city)
        SELECT b.* REPLACE (round(children + 1e-9, 1) AS children), coalesce(schools, 0) AS schools, coalesce(hospitals, 0) AS hospitals, coalesce(kilns, 0) AS kilns, {_CASE["school"]} AS school_advice, {_CASE["hospital"]} AS hospital_alert FROM b LEFT JOIN a USING (city)"""),
}
