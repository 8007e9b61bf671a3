"""Incremental ingestion as tables: windows and checkpoints, fill-only merges, upserts with revisions, liveness, planning, retention."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import rounded
from ..operators import merging, series
from ..session import shared_dir, table
from ..sources import versions
from ..sources.tables import AS_OF, SIGNAL, WIDE, readings, signal, sql, stations, wide_readings

_NOW = f"timestamp_ntz'{AS_OF}'"
FIELDS = ["pm25", "pm10", "no2"]


def _arrivals(spark, sf_dir):
    """Sparse rows of (station, hour) as they arrive, some fields missing, several rows an hour."""
    rows = wide_readings(spark, sf_dir).withColumn("hour", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    drop = lambda c, k: F.when(F.col("id") % k != 0, F.col(c)).alias(c)
    return rows.select("id", F.col("station").alias("key"), "hour", drop("pm25", 3), drop("pm10", 2), drop("no2", 5), F.col("provider").alias("source"))


def next_windows(spark, sf_dir):
    """What each stream reads next: from its checkpoint less the overlap to the window's end or now; a first backfill without one."""
    last = readings(spark, sf_dir).where("station % 7 <> 0").groupBy("station").agg(F.max("ts").alias("through"))
    rows = stations(spark, sf_dir).select("station").join(last, "station", "left")
    window = merging.next_window(F.col("through"), F.expr(_NOW), overlap_hours=72, window_hours=168, backfill_hours=72)
    return rows.select("station", "through", window.alias("w")).select("station", "through", "w.from", "w.to")


def reconcile_windows(spark, sf_dir):
    """Older windows to read again, in chunks of seven days up to the overlap."""
    last = readings(spark, sf_dir).groupBy("station").agg(F.max("ts").alias("through"))
    chunks = merging.reconcile_windows(F.col("through"), lookback_days=30, overlap_hours=72, chunk_days=7)
    return last.select("station", F.explode(chunks).alias("w")).select("station", "w.from", "w.to")


def fill_merge(spark, sf_dir):
    """One row of each key and hour: the first value of each field in order of arrival."""
    rows = merging.first_values(_arrivals(spark, sf_dir), ["key", "hour"], FIELDS, "id")
    return rows.select("key", "hour", *[rounded(c).alias(c) for c in FIELDS])


def _sides(spark, sf_dir):
    """A store, and a batch of which a part is new, a part changed, a part sparse, a part withdrawn."""
    rows = merging.first_values(_arrivals(spark, sf_dir), ["key", "hour"], FIELDS, "id").withColumn("k", F.col("key") + F.dayofmonth("hour"))
    store = rows.where("k % 5 <> 0").select("key", "hour", *FIELDS)
    new = rows.where("k % 3 <> 0").select("key", "hour", *[F.when(F.col("k") % 4 == i, F.col(c) + 1).when(F.col("k") % 7 != i, F.col(c)).alias(c) for i, c in enumerate(FIELDS)], F.when(F.col("k") % 11 == 0, F.array(F.lit("no2"))).alias("withdraw"))
    return store, new


def upsert_fields(spark, sf_dir):
    """A store after a batch: nulls never erase, withdrawn fields do, and the state tells what happened to each row."""
    store, new = _sides(spark, sf_dir)
    rows = merging.upsert(store, new, ["key", "hour"], FIELDS, "withdraw")
    return rows.select("key", "hour", *[rounded(c).alias(c) for c in FIELDS], "state")


def revision_log(spark, sf_dir):
    """A row for each value that a batch changes from one known value to another, beyond a relative and absolute 1e-9."""
    store, new = _sides(spark, sf_dir)
    rows = merging.revisions(store, new, ["key", "hour"], FIELDS)
    return rows.select("key", "hour", "field", rounded("old").alias("old"), rounded("new").alias("new"))


def upsert_twice(spark, sf_dir):
    """The same batch again changes nothing: all its rows are unchanged, whatever they did at first."""
    store, new = _sides(spark, sf_dir)
    first = merging.upsert(store, new, ["key", "hour"], FIELDS, "withdraw").drop("state")
    return merging.upsert(first, new, ["key", "hour"], FIELDS, "withdraw").groupBy("state").agg(F.count("*").alias("n"))


def source_priority(spark, sf_dir):
    """Of each key and hour, values of the preferred source win over later ones; others are replaced by later ones."""
    rows = _arrivals(spark, sf_dir)
    order = Window.partitionBy("key", "hour").orderBy((F.col("source") == "view").desc(), F.desc("id"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("key", "hour", "source", rounded("pm25").alias("pm25"))


def last_writer(spark, sf_dir):
    return series.latest_by(_arrivals(spark, sf_dir), ["key", "hour"], "id", "source", "pm10").select("key", "hour", "source", rounded("pm10").alias("pm10"))


def liveness(spark, sf_dir):
    """The inventory after a run: listed stations start afresh, those that the run could have seen age, the others wait;
    dormant from 6 misses, inactive from 28."""
    old = stations(spark, sf_dir).where("station % 9 <> 0").select("station", "city", (F.col("station") % 31).alias("misses"))
    listed = stations(spark, sf_dir).where("station % 3 = 0").select("station", "city")
    fetched = stations(spark, sf_dir).where("station % 5 <> 0 and length(city) % 4 <> 0").select("city").distinct()
    rows = merging.aged(old, listed, fetched, "station", "city")
    return rows.select("station", "misses", (F.col("misses") >= 6).alias("dormant"), (F.col("misses") < 28).alias("active"))


def days_to_build(spark, sf_dir):
    """Days that are not built, have changed since, or are among the last four."""
    found = readings(spark, sf_dir).groupBy(F.col("ts").cast("date").alias("day")).agg(F.max("ts").alias("changed"))
    built = found.where("day(day) % 4 <> 0").select("day", F.when(F.dayofmonth("day") % 6 != 0, F.col("changed")).otherwise(F.col("changed") - F.expr("interval 1 hour")).alias("built"))
    recent = F.datediff(F.to_date(F.lit("2024-01-31")), "day") < 4
    why = F.when(F.col("built").isNull(), "new").when(F.col("built") < F.col("changed"), "changed").when(recent, "recent")
    return found.join(built, "day", "left").select("day", why.alias("why")).where("why is not null")


def refreshed_days(spark, sf_dir):
    """A continuous aggregate after a refresh of its last days: old days as stored, the window's as they are now."""
    days = signal(spark, sf_dir).groupBy("station", F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("pm25"), F.count("pm25").alias("n"))
    stored = days.where("day < date'2024-01-25'").withColumn("pm25", F.col("pm25") + 1)
    fresh = days.where("day between date'2024-01-20' and date'2024-01-29'")
    return merging.replaced(stored, fresh, ["station", "day"]).select("station", "day", rounded("pm25").alias("pm25"), "n")


def retained(spark, sf_dir):
    """What a retention of ten days leaves, by source, with the payload of long rows cut: days before go from a versioned
    table, the day that the limit falls in is rewritten, and the files that no version needs are deleted."""
    path = f"{shared_dir(spark)}/airstrata/retained-{uuid.uuid4().hex}"
    versions.replace(readings(spark, sf_dir).withColumn("day", F.col("ts").cast("date")), path, "day", "load")
    versions.retain(spark, path, "day", "ts", str(datetime.datetime.fromisoformat(AS_OF) - datetime.timedelta(days=10)))
    versions.vacuum(spark, path, least_hours=0.0)
    return versions.read(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.sum(F.length(F.substring("props", 1, 8))).alias("bytes"))


def rejected(spark, sf_dir):
    """Readings by why they are refused: no time, in the future beyond an hour, before the cutoff; the rest pass."""
    at = F.when(F.col("id") % 41 == 0, None).otherwise(F.col("ts") + F.expr("make_dt_interval(cast(if(id % 37 = 0, 3, 0) as int))"))
    now, cutoff = "timestamp_ntz'2024-01-29 00:00:00'", "timestamp_ntz'2024-01-02 00:00:00'"
    rows = wide_readings(spark, sf_dir).withColumn("at", at)
    why = F.when(F.col("at").isNull(), "ts_missing").when(F.col("at") > F.expr(f"{now} + interval 1 hour"), "ts_future").when(F.col("at") < F.expr(cutoff), "ts_before_cutoff").otherwise("accepted")
    return rows.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def shifted_history(spark, sf_dir):
    """History an hour late beside current values: the shifted hour fills what the current one has not."""
    rows = _arrivals(spark, sf_dir).withColumn("hour", F.date_trunc("hour", F.col("hour")).cast("timestamp_ntz"))
    current = rows.where("source = 'view'").select("key", "hour", "pm25", "pm10", F.lit(0).alias("rank"), "id")
    past = rows.where("source = 'click'").select("key", (F.col("hour") + F.expr("interval 1 hour")).alias("hour"), "pm25", F.lit(None).cast("double").alias("pm10"), F.lit(1).alias("rank"), "id")
    both = current.unionByName(past).withColumn("order", F.struct("rank", "id"))
    return merging.first_values(both, ["key", "hour"], ["pm25", "pm10"], "order").select("key", "hour", rounded("pm25").alias("pm25"), rounded("pm10").alias("pm10"))


def run_status(spark, sf_dir):
    """Runs by outcome: failed on an error or an empty inventory, partial if some failed, success if none did."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((n % 6).alias("expected"), (n % 4).alias("attempted"), F.least(n % 3, n % 4).alias("failed"), (n % 17 == 0).alias("error"))
    status = F.when(F.col("error") | (F.col("expected") == 0), "failed").when(F.col("failed") == 0, "success").when(F.col("failed") < F.col("attempted"), "partial").otherwise("failed")
    worst = F.element_at(F.array(F.lit("success"), F.lit("partial"), F.lit("failed")), F.max(F.when(F.col("status") == "failed", 3).when(F.col("status") == "partial", 2).otherwise(1)))
    return rows.withColumn("status", status).groupBy("expected").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("succeeded"), worst.alias("worst"))


def stale_status(spark, sf_dir):
    """Forecast files by how old they are: fresh up to six hours, stale up to two days, expired beyond, missing."""
    age = (F.unix_timestamp(F.expr(f"timestamp'{AS_OF}'")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 3600.0
    rows = stations(spark, sf_dir).select("station").join(readings(spark, sf_dir).groupBy("station").agg(F.max("ts").alias("last")), "station", "left")
    return rows.groupBy(F.when(F.col("last").isNull(), "missing").when(age <= 6, "fresh").when(age <= 48, "stale").otherwise("expired").alias("status")).agg(F.count("*").alias("n"))


def identity_events(spark, sf_dir):
    """A registry against a new listing by source id: kept, moved (beyond 0.5 km), renamed, new, or in conflict with another's name."""
    old = stations(spark, sf_dir).where("station % 8 <> 0").select("station", "name", "lat", "lon")
    name = F.when(F.col("station") % 13 == 0, F.concat("name", F.lit(" II"))).when(F.col("station") % 29 == 0, F.lit("Customer#000000001")).otherwise(F.col("name"))
    new = stations(spark, sf_dir).where("station % 10 <> 0").select("station", name.alias("name2"), (F.col("lat") + F.when(F.col("station") % 11 == 0, 0.02).otherwise(0.0)).alias("lat2"), F.col("lon").alias("lon2"))
    rows = merging.identity_events(old, new, "station")
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.min("station").alias("first"))


def metadata_merge(spark, sf_dir):
    """Maps of metadata: what is curated stays, what is new wins elsewhere, and a history keeps the last three changes."""
    rows = stations(spark, sf_dir).where("station <= 500")
    old = F.create_map(F.lit("name"), F.col("name"), F.lit("city"), F.col("city"), F.lit("curated_city"), F.lit("yes"))
    new = F.create_map(F.lit("name"), F.upper("name"), F.lit("city"), F.lit("elsewhere"), F.lit("owner"), F.col("provider"))
    history = F.transform(F.sequence(F.lit(1), (F.col("station") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("v"), i.cast("string")))
    kept = merging.merged_metadata(old, new, "curated_")
    return rows.select("station", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"), F.array_join(merging.appended_history(history, F.lit("now"), 3), ",").alias("history"))


QUERIES = {
    f.__name__: f
    for f in (
        next_windows, reconcile_windows, fill_merge, upsert_fields, revision_log, upsert_twice, source_priority, last_writer, liveness, days_to_build, refreshed_days, retained, rejected, shifted_history, run_status, stale_status, identity_events, metadata_merge,
    )
}

_A = f"""{WIDE.strip()}, a AS (SELECT id, station AS key, date_trunc('day', ts)::TIMESTAMP AS hour, CASE WHEN id % 3 <> 0 THEN pm25 END AS pm25, CASE WHEN id % 2 <> 0 THEN pm10 END AS pm10, CASE WHEN id % 5 <> 0 THEN no2 END AS no2, provider AS source FROM x)"""
_FIRST = ", ".join(f"arg_min({c}, id) FILTER ({c} IS NOT NULL) AS {c}" for c in FIELDS)
_M = f"{_A}, m AS (SELECT key, hour, {_FIRST} FROM a GROUP BY ALL)"
_SIDES = f"""{_M}, mk AS (SELECT *, key + day(hour) AS k FROM m), st AS (SELECT key, hour, {', '.join(FIELDS)} FROM mk WHERE k % 5 <> 0),
nw AS (SELECT key, hour, {', '.join(f'CASE WHEN k % 4 = {i} THEN {c} + 1 WHEN k % 7 <> {i} THEN {c} END AS {c}2' for i, c in enumerate(FIELDS))}, k % 11 = 0 AS withdrawn FROM mk WHERE k % 3 <> 0),
j AS (SELECT coalesce(st.key, nw.key) AS key, coalesce(st.hour, nw.hour) AS hour, st.key IS NOT NULL AS had, nw.key IS NOT NULL AS came, coalesce(withdrawn, false) AS w, * EXCLUDE (key, hour, key_1, hour_1, withdrawn) FROM (SELECT * FROM st) st FULL JOIN nw ON st.key = nw.key AND st.hour = nw.hour)"""
_SIDES = _SIDES.replace("* EXCLUDE (key, hour, key_1, hour_1, withdrawn)", ", ".join([*FIELDS, *(f"{c}2" for c in FIELDS)]))
_MERGED = ", ".join(f"{'CASE WHEN w THEN NULL ELSE coalesce(no2' + '2, no2) END' if c == 'no2' else f'coalesce({c}2, {c})'} AS {c}" for c in FIELDS)
_SAME = " AND ".join(f"({'CASE WHEN w THEN NULL ELSE coalesce(no22, no2) END' if c == 'no2' else f'coalesce({c}2, {c})'}) IS NOT DISTINCT FROM {c}" for c in FIELDS)
ORACLE = {
    "next_windows": sql(f"""l AS (SELECT station, max(ts) AS through FROM r WHERE station % 7 <> 0 GROUP BY station), c AS (SELECT s.station, through, least(through, TIMESTAMP '{AS_OF}') AS cur FROM s LEFT JOIN l USING (station))
        SELECT station, through, CASE WHEN through IS NULL THEN TIMESTAMP '{AS_OF}' ELSE cur END - INTERVAL 72 HOUR AS "from", CASE WHEN through IS NULL THEN TIMESTAMP '{AS_OF}' ELSE least(TIMESTAMP '{AS_OF}', cur + INTERVAL 168 HOUR) END AS "to" FROM c"""),
    "reconcile_windows": sql("""l AS (SELECT station, max(ts) AS through FROM r GROUP BY station), c AS (SELECT station, through - INTERVAL 30 DAY + to_days((7 * i)::INT) AS a, through - INTERVAL 72 HOUR AS e FROM l, range(5) t(i))
        SELECT station, a AS "from", least(a + INTERVAL 7 DAY, e) AS "to" FROM c WHERE a < e"""),
    "fill_merge": sql(f"{_M} SELECT key, hour, {', '.join(f'round({c}, 4) AS {c}' for c in FIELDS)} FROM m"),
    "upsert_fields": sql(f"""{_SIDES}, u AS (SELECT key, hour, {_MERGED}, CASE WHEN NOT had THEN 'inserted' WHEN NOT came OR ({_SAME}) THEN 'unchanged' ELSE 'updated' END AS state FROM j)
        SELECT key, hour, {', '.join(f'round({c}, 4) AS {c}' for c in FIELDS)}, state FROM u"""),
    "revision_log": sql(f"{_SIDES} " + " UNION ALL ".join(f"SELECT key, hour, '{c}' AS field, round({c}, 4) AS old, round({c}2, 4) AS new FROM j WHERE abs({c} - {c}2) > greatest(1e-9, 1e-9 * greatest(abs({c}), abs({c}2)))" for c in FIELDS)),
    "upsert_twice": sql(f"{_SIDES} SELECT 'unchanged' AS state, count(*) AS n FROM j"),
    "source_priority": sql(f"{_A}, z AS (SELECT DISTINCT ON (key, hour) key, hour, source, pm25 FROM a ORDER BY key, hour, source = 'view' DESC, id DESC) SELECT key, hour, source, round(pm25, 4) AS pm25 FROM z"),
    "last_writer": sql(f"{_A}, z AS (SELECT DISTINCT ON (key, hour) key, hour, source, pm10 FROM a ORDER BY key, hour, id DESC) SELECT key, hour, source, round(pm10, 4) AS pm10 FROM z"),
    "liveness": sql("""old AS (SELECT station, city, station % 31 AS misses FROM s WHERE station % 9 <> 0), li AS (SELECT station, city FROM s WHERE station % 3 = 0),
        fe AS (SELECT DISTINCT city FROM s WHERE station % 5 <> 0 AND length(city) % 4 <> 0 UNION SELECT city FROM li), u AS (SELECT station, 0 AS misses FROM li UNION ALL SELECT station, misses + CASE WHEN city IN (SELECT city FROM fe) THEN 1 ELSE 0 END FROM old WHERE station NOT IN (SELECT station FROM li))
        SELECT station, misses, misses >= 6 AS dormant, misses < 28 AS active FROM u"""),
    "days_to_build": sql("""fd AS (SELECT ts::DATE AS day, max(ts) AS changed FROM r GROUP BY ALL), w AS (SELECT day, CASE WHEN day(day) % 4 = 0 THEN 'new' WHEN day(day) % 6 = 0 THEN 'changed' WHEN DATE '2024-01-31' - day < 4 THEN 'recent' END AS why FROM fd) SELECT * FROM w WHERE why IS NOT NULL"""),
    "refreshed_days": sql(f"""{SIGNAL.strip()}, d AS (SELECT station, hour::DATE AS day, avg(pm25) AS pm25, count(pm25) AS n FROM q GROUP BY ALL)
        SELECT station, day, round(CASE WHEN day >= DATE '2024-01-20' THEN pm25 ELSE pm25 + 1 END, 4) AS pm25, n FROM d WHERE day <= DATE '2024-01-29'"""),
    "retained": sql(f"SELECT source, count(*) AS n, min(ts) AS first, sum(length(substr(props, 1, 8)))::BIGINT AS bytes FROM r WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY source"),
    "rejected": sql(f"""{WIDE.strip()}, y AS (SELECT CASE WHEN id % 41 <> 0 THEN ts + to_days(CASE WHEN id % 37 = 0 THEN 3 ELSE 0 END) END AS tm FROM x)
        SELECT CASE WHEN tm IS NULL THEN 'ts_missing' WHEN tm > TIMESTAMP '2024-01-29 01:00:00' THEN 'ts_future' WHEN tm < TIMESTAMP '2024-01-02' THEN 'ts_before_cutoff' ELSE 'accepted' END AS why, count(*) AS n FROM y GROUP BY ALL"""),
    "shifted_history": sql(f"""{_A}, u AS (SELECT key, hour, pm25, pm10, 0 AS rank, id FROM a WHERE source = 'view' UNION ALL SELECT key, hour + INTERVAL 1 HOUR, pm25, NULL, 1, id FROM a WHERE source = 'click')
        SELECT key, hour, round(arg_min(pm25, (rank, id)) FILTER (pm25 IS NOT NULL), 4) AS pm25, round(arg_min(pm10, (rank, id)) FILTER (pm10 IS NOT NULL), 4) AS pm10 FROM u GROUP BY ALL"""),
    "run_status": sql("""q0 AS (SELECT id % 6 AS expected, id % 4 AS attempted, least(id % 3, id % 4) AS failed, id % 17 = 0 AS error FROM o), q1 AS (SELECT *, CASE WHEN error OR expected = 0 THEN 'failed' WHEN failed = 0 THEN 'success' WHEN failed < attempted THEN 'partial' ELSE 'failed' END AS status FROM q0)
        SELECT expected, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'success' END AS worst FROM q1 GROUP BY expected"""),
    "stale_status": sql(f"""l AS (SELECT station, max(ts) AS last FROM r GROUP BY station), g AS (SELECT last, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last))) / 3600.0 AS age FROM s LEFT JOIN l USING (station))
        SELECT CASE WHEN last IS NULL THEN 'missing' WHEN age <= 6 THEN 'fresh' WHEN age <= 48 THEN 'stale' ELSE 'expired' END AS status, count(*) AS n FROM g GROUP BY ALL"""),
    "identity_events": sql("""od AS (SELECT station, name, lat, lon FROM s WHERE station % 8 <> 0), nw AS (SELECT station, CASE WHEN station % 13 = 0 THEN name || ' II' WHEN station % 29 = 0 THEN 'Customer#000000001' ELSE name END AS name2, station % 11 = 0 AS far FROM s WHERE station % 10 <> 0),
        j AS (SELECT coalesce(od.station, nw.station) AS station, name, name2, far, od.station IS NULL AS fresh, nw.station IS NULL AS gone FROM od FULL JOIN nw ON od.station = nw.station),
        ev AS (SELECT station, CASE WHEN gone THEN 'unlisted' WHEN name2 IS DISTINCT FROM name AND EXISTS (SELECT 1 FROM od z WHERE z.name = name2 AND z.station <> j.station) THEN 'conflict' WHEN fresh THEN 'new' WHEN far THEN 'moved' WHEN name2 <> name THEN 'renamed' ELSE 'kept' END AS event FROM j)
        SELECT event, count(*) AS n, min(station) AS first FROM ev GROUP BY event"""),
    "metadata_merge": sql("""SELECT station, 'city=' || city || ';curated_city=yes;name=' || upper(name) || ';owner=' || provider AS metadata,
        array_to_string(list_append(list_transform(range(1, (station % 5 + 2)::BIGINT), lambda i: 'v' || i), 'now')[-3:], ',') AS history FROM s WHERE station <= 500"""),
}
