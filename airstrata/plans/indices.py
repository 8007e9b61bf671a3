"""Products of index functions: policies above the table, bands, gases and their units, heat index, wind, time and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, indices, wind
from ..functions.exprs import rounded
from ..sources.tables import WIDE, readings, sql, stations, wide_readings


def aqi_policies(spark, sf_dir):
    """The index of each reading under the three policies for values beyond the table, and its band."""
    x = F.col("pm25") * 2
    modes = [indices.pm25_index(x, m).alias(m) for m in ("extrapolate", "cap", "none")]
    rows = readings(spark, sf_dir).select("station", "ts", rounded(x, 2).alias("pm25"), *modes, indices.above_table(x).alias("capped"))
    return rows.withColumn("band", indices.band(F.col("extrapolate")))


def gas_indices(spark, sf_dir):
    """Sub-indices of gases in four units."""
    names, units = F.array(*map(F.lit, ("pm10", "o3", "co", "no2", "so2"))), F.array(*map(F.lit, ("ug/m3", "mg/m3", "ppb", "ppm", " PPB ", "grams")))
    rows = wide_readings(spark, sf_dir).select("id", F.get(names, (F.col("id") % 5).cast("int")).alias("gas"), F.get(units, (F.floor(F.col("id") / 5) % 6).cast("int")).alias("unit"), (F.col("no2") * 3).alias("value"))
    rows = rows.withColumn("scaled", indices.on_scale(F.col("gas"), F.col("value"), F.col("unit"))).withColumn("aqi", indices.gas_index(F.col("gas"), F.col("scaled")))
    return rows.select("id", "gas", "unit", rounded("scaled", 6).alias("scaled"), "aqi", exprs.category(F.col("aqi")).alias("category"))


def heat_index(spark, sf_dir):
    rows = wide_readings(spark, sf_dir).where("temp_c between 0 and 50 and humidity between 0 and 100")
    return rows.select("id", "temp_c", "humidity", indices.heat_index(F.col("temp_c"), F.col("humidity")).alias("heat"))


def units_and_wind(spark, sf_dir):
    """Conversions and directions of a reading's weather."""
    u, v = (F.col("wind_speed_ms") - 60) / 3, (F.col("wind_dir_deg") - 180) / 20
    name = F.get(F.array(*map(F.lit, [*wind.POINTS, " wsw ", "up"])), (F.col("id") % 18).cast("int"))
    return wide_readings(spark, sf_dir).select(
        "id", (F.col("pressure_kpa") * 10).alias("pressure_hpa"), rounded(F.col("wind_speed_ms") / 3.6).alias("speed_ms"), rounded(wind.from_degrees(u, v), 3).alias("from_deg"), rounded(wind.speed(u, v), 3).alias("speed"),
        wind.compass(F.col("wind_dir_deg")).alias("compass"), wind.compass_degrees(name).alias("compass_deg"), rounded(wind.angle_between(F.col("wind_dir_deg"), F.lit(350.0)), 3).alias("off"), (wind.angle_between(F.col("wind_dir_deg"), F.lit(350.0)) <= 60).alias("in_cone"),
    )


def places_and_times(spark, sf_dir):
    """Cells and their centres, coordinates clamped, distances in three forms, local time parts of stations and readings."""
    lat, lon = F.col("lat"), F.col("lon")
    cell = indices.cell_id(lat, lon)
    return stations(spark, sf_dir).select(
        "station", cell.alias("cell"), rounded(indices.cell_centre(cell)[0]).alias("cell_lat"), rounded(indices.cell_centre(cell)[1]).alias("cell_lon"), F.greatest(F.lit(25.0), F.least(F.lit(35.0), lat)).alias("clamped"),
        rounded(exprs.haversine_km(lat, lon, F.lit(31.5), F.lit(74.3)), 3).alias("km"), rounded(indices.cosine_km(lat, lon, F.lit(31.5), F.lit(74.3)), 3).alias("km_cosine"), ((lat.between(25, 33)) & lon.between(62, 70)).alias("in_box"),
    )


def time_parts(spark, sf_dir):
    """Acquisition times from a date and digits of hours and minutes, local days, day or night, season and week parts."""
    ts = F.col("ts")
    digits = F.date_format(ts, "Hmm")
    at = indices.acquired(ts.cast("date"), F.when(F.col("station") % 13 == 0, "9x").otherwise(digits))
    return readings(spark, sf_dir).select(
        "station", "ts", at.alias("acquired"), exprs.local_day(ts).alias("local_day"), indices.day_night(F.hour(ts)).alias("daynight"), F.weekday(ts).alias("weekday"), F.weekofyear(ts).alias("week"), F.floor(F.unix_timestamp(ts.cast("timestamp"))).alias("epoch"), exprs.season(F.month(ts)).alias("season"),
        indices.circular_days(F.dayofyear(ts), F.lit(360)).alias("days_to_360"),
    )


def text_helpers(spark, sf_dir):
    """Names as slugs, titles and keys, the last part of a source, test names by pattern, secrets blotted out."""
    name = F.when(F.col("station") % 17 == 0, F.concat("name", F.lit(" Test Unit"))).otherwise(F.col("name"))
    url = F.concat(F.lit("https://host/path?id="), F.col("station").cast("string"), F.lit("&api_key=abc"), F.col("station").cast("string"), F.lit("&q=1"))
    rows = stations(spark, sf_dir).select("station", name.alias("name"), F.concat_ws("|", "country", "city").alias("source"), url.alias("url"))
    return rows.select(
        "station", F.initcap(F.regexp_replace(F.lower("name"), "[#_]", " ")).alias("title"), F.regexp_replace(F.trim(F.lower("name")), "[^a-z0-9]+", "-").alias("slug"), F.element_at(F.split("source", "\\|"), -1).alias("last_part"),
        F.col("name").rlike(r"(?i)\b(test|demo|dummy|sample)\b").alias("is_test"), F.col("name").ilike("%000000_1%").alias("matches"), indices.redacted(F.col("url")).alias("redacted"),
    )


def cursor_codec(spark, sf_dir):
    """Opaque cursors of readings, and what they decode to."""
    text = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("station").cast("string"))
    cursor = indices.to_cursor(text)
    return readings(spark, sf_dir).where("pm25 > 90").select("station", "ts", cursor.alias("cursor"), indices.from_cursor(cursor).alias("decoded"))


def json_helpers(spark, sf_dir):
    """JSON merged with the right side winning, rows from an array, and a digest of the sorted object."""
    left = F.expr("map('k', cast(get_json_object(props, '$.k') as string), 'station', cast(station as string))")
    right = F.expr("map('k', cast(station % 7 as string), 'kind', source)")
    merged = F.map_from_entries(F.array_sort(F.concat(F.filter(F.map_entries(left), lambda e: ~F.array_contains(F.map_keys(right), e["key"])), F.map_entries(right))))
    return readings(spark, sf_dir).select("station", "ts", F.to_json(merged).alias("json")).withColumn("digest", F.sha2("json", 256))


QUERIES = {f.__name__: f for f in (aqi_policies, gas_indices, heat_index, units_and_wind, places_and_times, time_parts, text_helpers, cursor_codec, json_helpers)}


def _gas_sql():
    out = []
    for gas, (points, _, digits) in indices.GASES.items():
        c = f"trunc(scaled * {10 ** digits} + 1e-9) / {10.0 ** digits}"
        whens = " ".join(f"WHEN {c} BETWEEN {p[0]} AND {p[1]} THEN round_even(({p[3] - p[2]})::DOUBLE / ({p[1] - p[0]!r})::DOUBLE * ({c} - ({p[0]})::DOUBLE) + {p[2]}, 0)" for p in points)
        out.append(f"WHEN '{gas}' THEN CASE {whens} END")
    return f"(CASE gas {' '.join(out)} END)::BIGINT"


def _policy_sql():
    from .observations import _index_sql

    return _index_sql("v")


_SCALE = "CASE WHEN gas = 'pm10' THEN CASE WHEN u = 'ug/m3' THEN value END ELSE CASE u WHEN 'ppb' THEN value WHEN 'ppm' THEN value * 1000 WHEN 'ug/m3' THEN value * 24.45 / w WHEN 'mg/m3' THEN value * 24.45 / w * 1000 END / CASE WHEN gas IN ('o3', 'co') THEN 1000.0 ELSE 1.0 END END"
_KM = lambda a, b: f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({a} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({a})) * pow(sin(radians({b} - lon) / 2), 2))))"
ORACLE = {
    "aqi_policies": sql(f"""y AS (SELECT station, ts, pm25 * 2 AS v FROM r), z AS (SELECT *, {_policy_sql()} AS i, floor(v * 10 + 1e-9) / 10 > 325.4 AS above FROM y)
        SELECT station, ts, round(v + 1e-9, 2) AS pm25, i AS extrapolate, least(i, 500) AS cap, CASE WHEN NOT above THEN i END AS "none", above AS capped,
        CASE WHEN i IS NULL THEN 'unknown' WHEN i <= 50 THEN 'good' WHEN i <= 100 THEN 'moderate' WHEN i <= 150 THEN 'unhealthy_sensitive' WHEN i <= 200 THEN 'unhealthy' WHEN i <= 300 THEN 'very_unhealthy' ELSE 'hazardous' END AS band FROM z"""),
    "gas_indices": sql(f"""{WIDE.strip()}, y AS (SELECT id, ['pm10', 'o3', 'co', 'no2', 'so2'][id % 5 + 1] AS gas, ['ug/m3', 'mg/m3', 'ppb', 'ppm', ' PPB ', 'grams'][(id // 5) % 6 + 1] AS unit, no2 * 3 AS value FROM x),
        z AS (SELECT *, lower(trim(unit)) AS u, CASE gas {' '.join(f"WHEN '{g}' THEN {m}" for g, m in exprs.MOLAR_MASS.items())} END AS w FROM y), s1 AS (SELECT id, gas, unit, {_SCALE} AS scaled FROM z), s2 AS (SELECT *, {_gas_sql()} AS aqi FROM s1)
        SELECT id, gas, unit, round(scaled + 1e-9, 6) AS scaled, aqi, CASE WHEN aqi IS NULL THEN 'Unknown' WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category FROM s2"""),
    "heat_index": sql(f"""{WIDE.strip()}, y AS (SELECT id, temp_c, humidity AS h, temp_c * 9 / 5 + 32 AS t FROM x WHERE temp_c BETWEEN 0 AND 50 AND humidity BETWEEN 0 AND 100)
        SELECT id, temp_c, h AS humidity, CASE WHEN t < 80 THEN temp_c ELSE round((-42.379 + 2.04901523 * t + 10.14333127 * h - 0.22475541 * t * h - 0.00683783 * t * t - 0.05481717 * h * h + 0.00122874 * t * t * h + 0.00085282 * t * h * h - 0.00000199 * t * t * h * h - 32) * 5 / 9 + 1e-9, 1) END AS heat FROM y"""),
    "units_and_wind": sql(f"""{WIDE.strip()}, y AS (SELECT *, (wind_speed_ms - 60) / 3 AS u, (wind_dir_deg - 180) / 20 AS v, upper(trim([{', '.join(f"'{p}'" for p in wind.POINTS)}, ' wsw ', 'up'][id % 18 + 1])) AS nm, abs((wind_dir_deg - 350 + 540) % 360 - 180) AS off FROM x)
        SELECT id, pressure_kpa * 10 AS pressure_hpa, round(wind_speed_ms / 3.6 + 1e-9, 4) AS speed_ms, round((630 - degrees(atan2(v, u))) % 360 + 1e-9, 3) AS from_deg, round(sqrt(u * u + v * v) + 1e-9, 3) AS speed,
               [{', '.join(f"'{p}'" for p in wind.POINTS)}][floor((wind_dir_deg + 11.25) / 22.5)::INT % 16 + 1] AS compass, CASE nm {' '.join(f"WHEN '{p}' THEN {d}" for p, d in zip(wind.POINTS, wind.POINT_DEGREES))} END AS compass_deg, round(off + 1e-9, 3) AS off, off <= 60 AS in_cone FROM y"""),
    "places_and_times": sql(f"""y AS (SELECT station, lat, lon, (floor((lat + 90) / 0.02)::BIGINT << 20) | floor((lon + 180) / 0.02)::BIGINT AS cell FROM s)
        SELECT station, cell, round(((cell >> 20) + 0.5) * 0.02 - 90, 4) AS cell_lat, round(((cell & 1048575) + 0.5) * 0.02 - 180, 4) AS cell_lon, greatest(25.0, least(35.0, lat)) AS clamped, round({_KM('31.5', '74.3')} + 1e-9, 3) AS km,
               round(6371.0 * acos(least(1.0, greatest(-1.0, sin(radians(lat)) * sin(radians(31.5)) + cos(radians(lat)) * cos(radians(31.5)) * cos(radians(74.3 - lon))))) + 1e-9, 3) AS km_cosine, lat BETWEEN 25 AND 33 AND lon BETWEEN 62 AND 70 AS in_box FROM y"""),
    "time_parts": sql("""SELECT station, ts, CASE WHEN station % 13 <> 0 THEN date_trunc('minute', ts)::TIMESTAMP END AS acquired, (ts + INTERVAL 5 HOUR)::DATE AS local_day, CASE WHEN hour(ts) BETWEEN 3 AND 14 THEN 'D' ELSE 'N' END AS daynight, (isodow(ts) - 1)::INT AS weekday, weekofyear(ts)::INT AS week, floor(epoch(ts))::BIGINT AS epoch,
        CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'pre_monsoon' WHEN month(ts) BETWEEN 6 AND 9 THEN 'monsoon' ELSE 'post_monsoon' END AS season, least(abs(dayofyear(ts) - 360), 366 - abs(dayofyear(ts) - 360))::INT AS days_to_360 FROM r"""),
    "text_helpers": sql(r"""y AS (SELECT station, CASE WHEN station % 17 = 0 THEN name || ' Test Unit' ELSE name END AS name, country, city FROM s)
        SELECT station, array_to_string(list_transform(string_split(regexp_replace(lower(name), '[#_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, regexp_replace(trim(lower(name)), '[^a-z0-9]+', '-', 'g') AS slug, city AS last_part,
               regexp_matches(name, '(?i)\b(test|demo|dummy|sample)\b') AS is_test, name ILIKE '%000000_1%' AS matches, 'https://host/path?id=' || station || '&api_key=***&q=1' AS redacted FROM y"""),
    "cursor_codec": sql("""SELECT station, ts, replace(replace(rtrim(to_base64((strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || station)::BLOB), '='), '+', '-'), '/', '_') AS cursor, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || station AS decoded FROM r WHERE pm25 > 90"""),
    "json_helpers": sql("""y AS (SELECT station, ts, '{"k":"' || station % 7 || '","kind":"' || source || '","station":"' || station || '"}' AS json FROM r) SELECT station, ts, json, sha256(json) AS digest FROM y"""),
}
