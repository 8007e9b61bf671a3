"""Statistics of pairs, forecasts, seasons and places: correlation, bias, calibration, climatology, trends, hazard, paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import rounded, season_year
from ..operators import places, series
from ..session import staged, table
from ..sources.tables import SIGNAL, daily, readings, signal, sql, stations


def _pairs(spark, sf_dir):
    """Forecasts and observations of each site and hour, with the lead in days."""
    rows = signal(spark, sf_dir).where("pm25 between 0 and 900")
    off = ((F.col("h") * 37 + F.col("station") * 11) % 61 - 30).cast("double")
    return rows.select("station", "group", "hour", (F.col("h") % 4).alias("lead"), F.col("pm25").alias("seen"), (F.col("pm25") + off + (F.col("h") % 4) * 3).alias("said"))


def forecast_audit(spark, sf_dir):
    """Errors, bias and fit of forecasts by lead, the share within 25, and the trend of the error between halves."""
    e = F.col("said") - F.col("seen")
    rows = _pairs(spark, sf_dir).groupBy("lead").agg(
        F.count("*").alias("n"), rounded(F.avg(F.abs(e))).alias("mae"), rounded(F.sqrt(F.avg(e * e))).alias("rmse"), rounded(F.avg(e)).alias("bias"), rounded(F.regr_r2("seen", "said")).alias("r2"), rounded(F.avg((F.abs(e) <= 25).cast("double"))).alias("within"),
        rounded(F.avg(F.when(F.dayofmonth("hour") <= 15, F.abs(e)))).alias("before"), rounded(F.avg(F.when(F.dayofmonth("hour") > 15, F.abs(e)))).alias("after"),
    )
    delta = F.col("after") - F.col("before")
    return rows.select("*", F.when(delta > 2, "worse").when(delta < -2, "better").otherwise("stable").alias("trend"))


def correlations(spark, sf_dir):
    """Pearson's and Spearman's correlation of forecast and observation by group, from ten pairs on and where both vary, with its strength."""
    days = _pairs(spark, sf_dir).groupBy("group", F.col("hour").cast("date").alias("day")).agg(F.avg("said").alias("x"), F.avg("seen").alias("y"))
    rank = lambda c: F.rank().over(Window.partitionBy("group").orderBy(c)) + (F.count("*").over(Window.partitionBy("group", c)) - 1) / 2
    rows = days.withColumn("rx", rank("x")).withColumn("ry", rank("y")).groupBy("group")
    out = rows.agg(F.count("*").alias("n"), F.corr("x", "y").alias("p"), F.corr("rx", "ry").alias("s"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    fit = (F.col("n") >= 10) & (F.col("sx") > 0) & (F.col("sy") > 0)
    size = F.abs(F.when(fit, F.col("p")))
    return out.select("group", "n", rounded(F.when(fit, F.col("p"))).alias("pearson"), rounded(F.when(fit, F.col("s"))).alias("spearman"), F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size.isNotNull(), "weak").otherwise("none").alias("strength"))


def pair_stats(spark, sf_dir):
    """Lines between two sites of a group over their common hours, from 24 pairs on."""
    rows = signal(spark, sf_dir).where("pm25 between 0 and 900").select("group", "station", "hour", "pm25")
    rows = rows.join(rows.groupBy("group").agg(F.min("station").alias("a")), "group")
    first = rows.where("station = a").select("group", "hour", F.col("pm25").alias("x"))
    pairs = rows.where("station <> a").join(first, ["group", "hour"])
    out = pairs.groupBy("group", "station").agg(F.count("*").alias("n"), F.regr_slope("pm25", "x").alias("m"), F.regr_intercept("pm25", "x").alias("b"), F.regr_r2("pm25", "x").alias("r2"), F.avg(F.abs(F.col("pm25") - F.col("x"))).alias("mae")).where("n >= 24")
    return out.select("group", "station", "n", rounded("m").alias("slope"), rounded("b", 3).alias("intercept"), rounded("r2").alias("r2"), rounded("mae", 3).alias("mae"))


def bin_bias(spark, sf_dir):
    """Mean bias in ten bins of equal frequency by the observation's quantiles, of five pairs or more.

    Quantiles are exact by counting: pairs are folded to one row for each observed value, with its count and sum of errors,
    and all that follows is on these; no task holds all pairs and none meet them in a join."""
    values = _pairs(spark, sf_dir).groupBy("seen").agg(F.count("*").alias("c"), F.sum(F.col("said") - F.col("seen")).alias("e"))
    parts = values.withColumn("part", F.floor(F.col("seen") / 10))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each ten units of the scale
    sums = parts.groupBy("part").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0)))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("seen").rowsBetween(Window.unboundedPreceding, 0))
    total = values.agg(F.sum("c").alias("total"))
    ranked = parts.join(sums.select("part", "base"), "part").select("seen", "c", "e", (F.col("base") + upto).alias("upto")).crossJoin(F.broadcast(total))  # one row
    # A value is in the bin of its first rank, so that equal values share a bin.
    rows = ranked.groupBy(F.floor((F.col("upto") - F.col("c")) * 10 / F.col("total")).alias("bin"))
    return rows.agg(F.sum("c").alias("n"), F.min("seen").alias("low"), F.max("seen").alias("high"), rounded(F.sum("e") / F.sum("c")).alias("bias")).where("n >= 5")


def calibrated(spark, sf_dir):
    """Isotonic calibration of daily forecasts in five folds by date: each day is told by a fit on the other folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    days = _pairs(spark, sf_dir).groupBy("group", F.col("hour").cast("date").alias("day")).agg(F.avg("said").alias("said"), F.avg("seen").alias("seen"))
    days = staged(days.withColumn("fold", F.pmod(F.xxhash64("day"), F.lit(5)).cast("int")), "forecast-days")  # fits read these few rows, not the hours
    days = VectorAssembler(inputCols=["said"], outputCol="features").transform(days)
    out = None
    for fold in range(5):
        fit = IsotonicRegression(featuresCol="features", labelCol="seen", predictionCol="calibrated").fit(days.where(F.col("fold") != fold))
        part = fit.transform(days.where(F.col("fold") == fold)).select("group", "day", "fold", "said", "seen", "calibrated")
        out = part if out is None else out.unionByName(part)
    return out


#: Folds by date, and pieces of a line through the means of as many bins.
FOLDS, PIECES = 5, 5


def calibrated_pieces(spark, sf_dir):
    """The same by a line in pieces: for each fold the means of five bins of the other folds' forecasts, of equal counts, are
    its knots, a table of few rows; a day meets the piece that it lies on in a range join, beyond the ends the end's value."""
    days = _pairs(spark, sf_dir).groupBy("group", F.col("hour").cast("date").alias("day")).agg(F.avg("said").alias("said"), F.avg("seen").alias("seen"))
    days = days.withColumn("fold", F.dayofyear("day") % FOLDS)
    train = days.withColumn("out", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).where("out <> fold")
    inner = series.percentiles(train, ["out"], "said", tuple(k / PIECES for k in range(1, PIECES)), 5.0)
    cuts = [F.col(f"p{100 * k // PIECES}") for k in range(1, PIECES)]
    bins = train.join(F.broadcast(inner), "out").withColumn("bin", sum((F.col("said") >= c).cast("int") for c in cuts))  # a row a fold
    knots = bins.groupBy("out", "bin").agg(F.avg("said").alias("x"), F.avg("seen").alias("y"))
    w = Window.partitionBy("out").orderBy("x")
    pieces = knots.select("out", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), (F.row_number().over(w) == 1).alias("first"))
    low = F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("x"))
    pieces = pieces.withColumn("low", low).withColumn("high", F.coalesce("x2", F.lit(float("inf")))).drop("first")
    at = F.greatest("x", F.least("said", F.coalesce("x2", "x")))
    line = F.col("y") + F.coalesce(F.try_divide((at - F.col("x")) * (F.col("y2") - F.col("y")), F.col("x2") - F.col("x")), F.lit(0.0))
    rows = days.join(F.broadcast(pieces), (F.col("fold") == F.col("out")) & (F.col("said") >= F.col("low")) & (F.col("said") < F.col("high")), "left")  # a fold's few pieces
    return rows.select("group", "day", "fold", rounded("said").alias("said"), rounded("seen").alias("seen"), rounded(F.coalesce(line, F.col("said"))).alias("calibrated"))


def drift_ranking(spark, sf_dir):
    """Population stability of each group's values between two halves over twenty bins, the five largest first."""
    rows = signal(spark, sf_dir).where("pm25 between 0 and 900").withColumn("bin", F.floor(F.col("pm25") / 50)).withColumn("late", F.col("h") >= 360)
    n = rows.groupBy("group", "bin").agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    own = Window.partitionBy("group")  # a score of bins
    p, q = ((F.col(c) + 0.5) / (F.sum(c).over(own) + 0.5) for c in "ab")
    shares = n.select("group", ((p - q) * F.ln(p / q)).alias("part"))
    return shares.groupBy("group").agg(rounded(F.sum("part")).alias("psi")).orderBy(F.desc("psi"), "group").limit(5)


def _climatology(spark, sf_dir):
    """(season_out, doy, n, total, squares) of the days within 15 of each day of the year: all seasons' sums less one's."""
    days = daily(spark, sf_dir).groupBy("day").agg(F.avg("value").alias("v")).select(F.dayofyear("day").alias("d"), season_year(F.col("day")).alias("season"), "v")
    near = days.withColumn("doy", F.explode(F.transform(F.sequence(F.lit(-15), F.lit(15)), lambda k: F.pmod(F.col("d") + k - 1, F.lit(366)) + 1)))
    by = near.groupBy("season", "doy").agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"))
    every = by.groupBy("doy").agg(*[F.sum(c).alias(c) for c in "ntq"])
    seasons = by.select(F.col("season").alias("season_out")).distinct()
    # One row a season and day of the year, whatever the data's size.
    own = by.select(F.col("season").alias("season_out"), "doy", *[F.col(c).alias(f"{c}1") for c in "ntq"])
    rows = every.crossJoin(F.broadcast(seasons)).join(own, ["season_out", "doy"], "left")
    less = rows.select("season_out", "doy", *[(F.col(c) - F.coalesce(f"{c}1", F.lit(0))).alias(c) for c in "ntq"]).where("n > 0")
    out = less.unionByName(every.withColumn("season_out", F.lit(-1)))
    mean = F.col("t") / F.col("n")
    return out.select("season_out", "doy", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("q") / F.col("n") - mean * mean) * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("sd"))


def climatology(spark, sf_dir):
    """Mean and sample spread for each day of the year, with each season left out and with none (-1)."""
    return _climatology(spark, sf_dir).select("season_out", "doy", "n", rounded("mean", 2).alias("mean"), rounded("sd", 1).alias("sd"))


def zscores(spark, sf_dir):
    """Daily values against the climatology without their own season, as deviations (none under ten days or without spread) and in percent of normal."""
    days = daily(spark, sf_dir).groupBy("day").agg(F.avg("value").alias("v")).withColumn("season_out", season_year(F.col("day"))).withColumn("doy", F.dayofyear("day"))
    clim = _climatology(spark, sf_dir)
    known = clim.select("season_out").distinct().withColumn("known", F.lit(True))
    rows = days.join(F.broadcast(known), "season_out", "left").withColumn("season_out", F.when(F.col("known"), F.col("season_out")).otherwise(-1))  # seasons: one row a year
    rows = rows.join(clim, ["season_out", "doy"], "left")
    z = F.when((F.col("n") >= 10) & (F.col("sd") > 0), (F.col("v") - F.col("mean")) / F.col("sd"))
    return rows.select("day", rounded("v", 2).alias("v"), rounded(z, 3).alias("z"), rounded(100 * F.col("v") / F.col("mean"), 2).alias("percent"))


def fire_trends(spark, sf_dir):
    """Days of each season on a full calendar, some of them not known: counts, rolling means of seven (five at least), sums that skip gaps and stay null on them, shares of the season's total."""
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n")).withColumn("n", F.when(F.dayofyear("day") % 13 > 1, F.col("n")))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    rows = ends.join(days, "day", "left").withColumn("season", season_year(F.col("day")))
    w = Window.partitionBy("season").orderBy("day")
    week = w.rowsBetween(-6, 0)
    mean7 = F.when(F.col("n").isNotNull() & (F.count("n").over(week) >= 5), F.avg("n").over(week))
    total = F.sum("n").over(Window.partitionBy("season"))
    return rows.select("day", "season", "n", rounded(mean7).alias("mean7"), F.when(F.col("n").isNotNull(), F.sum("n").over(w)).alias("cumulative"), rounded(F.col("n") / total, 6).alias("share"))


def rolling_month(spark, sf_dir):
    """Each city's daily means on a full calendar, days of under two sites not known, with means of thirty days, ten at least."""
    days = signal(spark, sf_dir).where("pm25 between 0 and 900").groupBy("group", F.col("hour").cast("date").alias("day")).agg(F.avg("pm25").alias("v"), F.count_distinct("station").alias("sites"))
    days = days.withColumn("v", F.when((F.col("sites") >= 2) & ((F.dayofmonth("day") + F.col("group")) % 5 != 0), F.col("v")))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    rows = days.select("group").distinct().join(F.broadcast(ends)).join(days, ["group", "day"], "left")  # a row a day
    w = Window.partitionBy("group").orderBy("day").rowsBetween(-29, 0)
    return rows.select("group", "day", rounded("v").alias("v"), rounded(F.when(F.count("v").over(w) >= 10, F.avg("v").over(w))).alias("mean30"))


def network_comparison(spark, sf_dir):
    """Two networks' city-days, joined by city and day, compared by month where five days or more have both."""
    rows = readings(spark, sf_dir).where("pm25 is not null and qc <> 'INVALID'").join(stations(spark, sf_dir).select("station", "city", "provider"), "station")
    first = F.col("provider").isin("BUILDING", "MACHINERY", "HOUSEHOLD")
    mean = lambda c, name: rows.where(c).groupBy("city", F.col("ts").cast("date").alias("day")).agg(F.avg("pm25").alias(name))
    both = mean(first, "a").join(mean(~first, "b"), ["city", "day"])
    e = F.col("b") - F.col("a")
    out = both.groupBy("city", F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), rounded(F.avg(F.abs(e))).alias("mae"), rounded(F.sqrt(F.avg(e * e))).alias("rmse"), rounded(F.avg(e)).alias("bias"), rounded(F.regr_r2("b", "a")).alias("r2"), rounded(F.avg("a")).alias("mean_a"), rounded(F.avg("b")).alias("mean_b"),
    )
    return out.where("n >= 5")


def weekly_folds(spark, sf_dir):
    """Sums by week, null where a week has no known day, with means weighted by counts."""
    rows = signal(spark, sf_dir).withColumn("v", F.when((F.col("h") >= 168) | (F.col("station") % 4 != 0), F.col("pm25"))).withColumn("n", F.col("h") % 5 + 1)
    return rows.groupBy("station", F.date_trunc("week", "hour").cast("timestamp_ntz").alias("week")).agg(rounded(F.sum("v"), 2).alias("total"), F.count("v").alias("n"), rounded(F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).alias("weighted"))


def monthly_quartiles(spark, sf_dir):
    """Quartiles and the 95th percentile of days by month, the record of each, and the winter that it is in."""
    days = daily(spark, sf_dir).groupBy("day").agg(F.avg("value").alias("v"))
    rows = days.groupBy(F.month("day").alias("month"))  # days are few: one for each date
    winter = F.year("day") + F.when(F.month("day") >= 10, 1).otherwise(0)
    return rows.agg(*[rounded(F.percentile("v", F.lit(q)), 2).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.95)], rounded(F.max("v"), 2).alias("record"), F.min_by("day", F.struct(-F.col("v"), "day")).alias("record_day"), F.max(winter).alias("last_winter"))


def winter_maxima(spark, sf_dir):
    """The largest day of each of the last six winters (October on, named by the year they end in)."""
    days = daily(spark, sf_dir).groupBy("day").agg(F.avg("value").alias("v")).where("month(day) >= 10 or month(day) <= 3")
    winter = (F.year("day") + F.when(F.month("day") >= 10, 1).otherwise(0)).alias("winter")
    return days.groupBy(winter).agg(rounded(F.max("v"), 2).alias("max"), F.min_by("day", F.struct(-F.col("v"), "day")).alias("day")).orderBy(F.desc("winter")).limit(6)


def hazard_exposure(spark, sf_dir):
    """A hazard surface from the eight nearest sites of every populated place, and by city the people above levels and the burden beyond 100."""
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (24 + (F.col("s_suppkey") * 41 % 1300) / 100.0).alias("lat2"), (61 + (F.col("s_suppkey") * 59 % 1600) / 100.0).alias("lon2"), (F.col("s_suppkey") * 17 % 300).cast("double").alias("v"))
    people = stations(spark, sf_dir).select("lat", "lon", "city", (F.col("station") % 1000 + 1).alias("people"))
    spots = people.select("lat", "lon").distinct().withColumn("place", F.struct("lat", "lon"))
    near = places.nearest(spots, sites, "place", "site", 400.0, 8).join(sites.select("site", "v"), "site")
    weight = 1 / F.pow(F.greatest("km", F.lit(0.001)), 2)
    surface = near.groupBy("place.lat", "place.lon").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("hazard"))
    rows = people.join(surface, ["lat", "lon"])
    h, n = F.col("hazard"), F.col("people")
    return rows.groupBy("city").agg(F.sum(n).alias("people"), *[F.sum(F.when(h > x, n).otherwise(0)).alias(f"above_{x}") for x in (35, 55, 150)], rounded(F.sum(n * F.greatest(h - 100, F.lit(0.0))), 2).alias("burden"), rounded(F.sum(h * n) / F.sum(n)).alias("weighted"))


def _paths(spark, sf_dir):
    """Back-trajectories of cities: 25 hourly points each, through a wind that turns."""
    n = F.col("n_nationkey")
    step = lambda i: F.struct((25.3 + (n % 5) * 2.6 + i * 0.06 * F.cos(n + i / 9.0)).alias("lat"), (62.6 + F.floor(n / 5) * 3.2 - i * 0.07 * F.sin(n + i / 7.0)).alias("lon"), i.alias("i"))
    rows = table(spark, sf_dir, "nation").select(n.cast("long").alias("city"), F.inline(F.transform(F.sequence(F.lit(0), F.lit(24)), step)))
    return rows.select("city", "i", "lat", "lon", (F.expr("timestamp_ntz'1996-05-02 00:00:00'") - F.expr("make_dt_interval(0, i, 0, 0)")).alias("at"))


def path_matches(spark, sf_dir):
    """Fires within 50 km and two hours of a path's point, or of unknown time that day: by city how many, and how far along."""
    at = F.expr("timestamp_ntz'1996-05-01 00:00:00'") + F.expr("make_dt_interval(0, cast(l_orderkey % 24 as int), 0, 0)")
    fires = table(spark, sf_dir, "lineitem").where("month(l_shipdate) = 5").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_quantity").alias("frp"))
    fires = fires.select("l_orderkey", "l_suppkey", "frp", (24 + (F.col("l_suppkey") * 41 % 1300) / 100.0).alias("lat2"), (61 + (F.col("l_suppkey") * 59 % 1600) / 100.0).alias("lon2"), F.when(F.col("l_orderkey") % 7 != 0, at).alias("seen"))
    pairs = places.within_radius(_paths(spark, sf_dir), fires, 50.0)
    off = F.abs(F.unix_timestamp(F.col("seen").cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp")))
    rows = pairs.where(F.coalesce(off <= 7200, F.lit(True)))
    first = rows.groupBy("city", "l_orderkey", "l_suppkey").agg(F.max("frp").alias("frp"), F.min("i").alias("i"))
    return first.groupBy("city").agg(F.count("*").alias("fires"), rounded(F.sum("frp"), 2).alias("frp"), F.min("i").alias("first_hour"), rounded(F.avg("i")).alias("mean_hour"))


def path_residence(spark, sf_dir):
    """Hours of every path in each cell of a degree, and when it enters and leaves; `path_sectors` has the sectors."""
    rows = _paths(spark, sf_dir).withColumn("cy", F.floor("lat")).withColumn("cx", F.floor("lon"))
    return rows.groupBy("city", "cy", "cx").agg(F.count("*").alias("hours"), F.min("i").alias("enters"), F.max("i").alias("leaves"))


def nearest_times(spark, sf_dir):
    """For every reading day the stored forecast time that is nearest to its noon, the earlier of two."""
    days = signal(spark, sf_dir).select(F.col("hour").cast("date").alias("day")).distinct().withColumn("noon", F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours"))
    times = signal(spark, sf_dir).where("station = 1 and h % 7 = 3").select("hour", F.col("hour").cast("date").alias("d"))
    near = days.withColumn("d", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1)))).join(times, "d")
    off = F.abs(F.unix_timestamp(F.col("hour").cast("timestamp")) - F.unix_timestamp(F.col("noon").cast("timestamp")))
    return near.groupBy("day").agg(F.min_by("hour", F.struct(off, "hour")).alias("nearest"), F.min(off).cast("long").alias("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        forecast_audit, correlations, pair_stats, bin_bias, calibrated, calibrated_pieces, drift_ranking, climatology, zscores, fire_trends, rolling_month, network_comparison, weekly_folds, monthly_quartiles, winter_maxima, hazard_exposure, path_matches, path_residence, nearest_times,
    )
}

_S = SIGNAL.strip()
_P = f"""{_S}, p AS (SELECT station, "group", hour, h % 4 AS lead, pm25 AS seen, pm25 + ((h * 37 + station * 11) % 61 - 30)::DOUBLE + (h % 4) * 3 AS said FROM q WHERE pm25 BETWEEN 0 AND 900)"""
_D = "v AS (SELECT day, avg(value) AS v FROM o GROUP BY day)"
_SEASON = "(CASE WHEN month(day) >= 7 THEN year(day) ELSE year(day) - 1 END)"
_CLIM = f"""{_D}, vd AS (SELECT day, dayofyear(day) AS d, {_SEASON} AS season, v FROM v), nr AS (SELECT season, (d + k + 350) % 366 + 1 AS doy, v FROM vd, range(31) t(k)), so AS (SELECT DISTINCT season AS season_out FROM nr UNION ALL SELECT -1),
cl AS (SELECT season_out, doy, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd FROM nr JOIN so ON season <> season_out GROUP BY ALL)"""
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
_PATH = """pa AS (SELECT n_nationkey AS city, i::INT AS i, 25.3::DOUBLE + (n_nationkey % 5) * 2.6 + i * 0.06 * cos(n_nationkey + i / 9.0::DOUBLE) AS lat, 62.6::DOUBLE + (n_nationkey // 5) * 3.2 - i * 0.07 * sin(n_nationkey + i / 7.0::DOUBLE) AS lon, TIMESTAMP '1996-05-02' - to_hours(i::INT) AS at_ FROM nation, range(25) t(i))"""
ORACLE = {
    "forecast_audit": sql(f"""{_P}, e AS (SELECT *, said - seen AS e FROM p), a AS (SELECT lead, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) AS bias, round(regr_r2(seen, said), 4) AS r2, round(avg((abs(e) <= 25)::INT), 4) AS within,
        round(avg(abs(e)) FILTER (day(hour) <= 15), 4) AS before, round(avg(abs(e)) FILTER (day(hour) > 15), 4) AS after FROM e GROUP BY lead) SELECT *, CASE WHEN after - before > 2 THEN 'worse' WHEN after - before < -2 THEN 'better' ELSE 'stable' END AS trend FROM a"""),
    "correlations": sql(f"""{_P}, d AS (SELECT "group", hour::DATE AS day, avg(said) AS x, avg(seen) AS y FROM p GROUP BY ALL), k AS (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY x) + (count(*) OVER (PARTITION BY "group", x) - 1) / 2 AS rx, rank() OVER (PARTITION BY "group" ORDER BY y) + (count(*) OVER (PARTITION BY "group", y) - 1) / 2 AS ry FROM d),
        c AS (SELECT "group", count(*) AS n, corr(x, y) AS p, corr(rx, ry) AS sp, stddev_pop(x) > 0 AND stddev_pop(y) > 0 AND count(*) >= 10 AS fit FROM k GROUP BY "group")
        SELECT "group", n, CASE WHEN fit THEN round(p, 4) END AS pearson, CASE WHEN fit THEN round(sp, 4) END AS spearman, CASE WHEN NOT fit THEN 'none' WHEN abs(p) >= 0.7 THEN 'strong' WHEN abs(p) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM c"""),
    "pair_stats": sql(f"""{_S}, g AS (SELECT * FROM q WHERE pm25 BETWEEN 0 AND 900), fst AS (SELECT "group", min(station) AS a FROM g GROUP BY ALL), x0 AS (SELECT g."group", hour, pm25 AS x FROM g JOIN fst ON g."group" = fst."group" AND station = a),
        j AS (SELECT g."group", station, pm25, x FROM g JOIN fst ON g."group" = fst."group" AND station <> a JOIN x0 ON x0."group" = g."group" AND x0.hour = g.hour)
        SELECT "group", station, count(*) AS n, round(regr_slope(pm25, x), 4) AS slope, round(regr_intercept(pm25, x) + 1e-9, 3) AS intercept, round(regr_r2(pm25, x), 4) AS r2, round(avg(abs(pm25 - x)) + 1e-9, 3) AS mae FROM j GROUP BY ALL HAVING count(*) >= 24"""),
    "bin_bias": sql(f"""{_P}, k AS (SELECT *, floor((rank() OVER (ORDER BY seen) - 1) * 10 / (count(*) OVER ())::DOUBLE)::BIGINT AS bin FROM p) SELECT bin, count(*) AS n, min(seen) AS low, max(seen) AS high, round(avg(said - seen), 4) AS bias FROM k GROUP BY bin HAVING count(*) >= 5"""),
    "calibrated_pieces": sql(f"""{_P}, dd AS (SELECT "group", hour::DATE AS day, avg(said) AS said, avg(seen) AS seen, dayofyear(hour::DATE) % {FOLDS} AS fold FROM p GROUP BY ALL), tr AS (SELECT dd.*, k AS out FROM dd, range({FOLDS}) t(k) WHERE k <> fold),
        cu AS (SELECT out, {", ".join(f"quantile_cont(said, {k / PIECES}) AS c{k}" for k in range(1, PIECES))} FROM tr GROUP BY out), kn AS (SELECT out, {" + ".join(f"(said >= c{k})::INT" for k in range(1, PIECES))} AS bin, avg(said) AS x, avg(seen) AS y FROM tr JOIN cu USING (out) GROUP BY ALL),
        pc AS (SELECT out, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS n FROM kn WINDOW w AS (PARTITION BY out ORDER BY x))
        SELECT "group", day, fold, round(said, 4) AS said, round(seen, 4) AS seen, round(y + coalesce((greatest(x, least(said, coalesce(x2, x))) - x) * (y2 - y) / (x2 - x), 0), 4) AS calibrated FROM dd JOIN pc ON fold = out AND (n = 1 OR said >= x) AND (x2 IS NULL OR said < x2)"""),
    "drift_ranking": sql(f"""{_S}, n AS (SELECT "group", floor(pm25 / 50) AS bin, count(*) FILTER (h < 360) AS a, count(*) FILTER (h >= 360) AS b FROM q WHERE pm25 BETWEEN 0 AND 900 GROUP BY ALL),
        u AS (SELECT "group", (a + 0.5) / (sum(a) OVER w + 0.5)::DOUBLE AS p, (b + 0.5) / (sum(b) OVER w + 0.5)::DOUBLE AS k FROM n WINDOW w AS (PARTITION BY "group")) SELECT "group", round(sum((p - k) * ln(p / k)), 4) AS psi FROM u GROUP BY "group" ORDER BY psi DESC, "group" LIMIT 5"""),
    "climatology": sql(f"{_CLIM} SELECT season_out::INT AS season_out, doy::INT AS doy, n, round(mean + 1e-9, 2) AS mean, round(sd + 1e-9, 1) AS sd FROM cl"),
    "zscores": sql(f"""{_CLIM} SELECT day, round(v + 1e-9, 2) AS v, CASE WHEN n >= 10 AND sd > 0 THEN round((v - mean) / sd + 1e-9, 3) END AS z, round(100 * v / mean + 1e-9, 2) AS percent FROM vd LEFT JOIN cl ON season = season_out AND d = doy"""),
    "fire_trends": sql("""c AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT day, CASE WHEN dayofyear(day) % 13 > 1 THEN n END AS n FROM c), k AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day),
        j AS (SELECT k.day, CASE WHEN month(k.day) >= 7 THEN year(k.day) ELSE year(k.day) - 1 END::INT AS season, n FROM k LEFT JOIN d USING (day))
        SELECT day, season, n, round(CASE WHEN n IS NOT NULL AND count(n) OVER w >= 5 THEN avg(n) OVER w END, 4) AS mean7, CASE WHEN n IS NOT NULL THEN sum(n) OVER (PARTITION BY season ORDER BY day) END::BIGINT AS cumulative, round(n / sum(n) OVER (PARTITION BY season) + 1e-9, 6) AS share FROM j WINDOW w AS (PARTITION BY season ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "rolling_month": sql(f"""{_S}, c0 AS (SELECT "group", hour::DATE AS day, avg(pm25) AS v, count(DISTINCT station) AS sites FROM q WHERE pm25 BETWEEN 0 AND 900 GROUP BY ALL), d0 AS (SELECT "group", day, CASE WHEN sites >= 2 AND (day(day) + "group") % 5 <> 0 THEN v END AS v FROM c0),
        k AS (SELECT "group", unnest(generate_series((SELECT min(day) FROM d0), (SELECT max(day) FROM d0), INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT "group" FROM d0))
        SELECT "group", day, round(v, 4) AS v, round(CASE WHEN count(v) OVER w >= 10 THEN avg(v) OVER w END, 4) AS mean30 FROM k LEFT JOIN d0 USING ("group", day) WINDOW w AS (PARTITION BY "group" ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""),
    "network_comparison": sql("""x AS (SELECT city, ts::DATE AS day, provider IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS one, pm25 FROM r JOIN s USING (station) WHERE pm25 IS NOT NULL AND qc <> 'INVALID'), y AS (SELECT city, day, avg(pm25) FILTER (one) AS a, avg(pm25) FILTER (NOT one) AS b FROM x GROUP BY ALL)
        SELECT city, strftime(day, '%Y-%m') AS month, count(*) AS n, round(avg(abs(b - a)), 4) AS mae, round(sqrt(avg((b - a) * (b - a))), 4) AS rmse, round(avg(b - a), 4) AS bias, round(regr_r2(b, a), 4) AS r2, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b
        FROM y WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 5"""),
    "weekly_folds": sql(f"""{_S}, z AS (SELECT station, date_trunc('week', hour)::TIMESTAMP AS week, CASE WHEN h >= 168 OR station % 4 <> 0 THEN pm25 END AS v, h % 5 + 1 AS k FROM q)
        SELECT station, week, round(sum(v) + 1e-9, 2) AS total, count(v) AS n, round(sum(v * k) / sum(k) FILTER (v IS NOT NULL), 4) AS weighted FROM z GROUP BY ALL"""),
    "monthly_quartiles": sql(f"""{_D} SELECT month(day)::INT AS month, round(quantile_cont(v, 0.25) + 1e-9, 2) AS p25, round(quantile_cont(v, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(v, 0.75) + 1e-9, 2) AS p75, round(quantile_cont(v, 0.95) + 1e-9, 2) AS p95, round(max(v) + 1e-9, 2) AS record, arg_min(day, (-v, day)) AS record_day,
        max(year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END)::INT AS last_winter FROM v GROUP BY ALL"""),
    "winter_maxima": sql(f"{_D} SELECT (year(day) + CASE WHEN month(day) >= 10 THEN 1 ELSE 0 END)::INT AS winter, round(max(v) + 1e-9, 2) AS max, arg_min(day, (-v, day)) AS day FROM v WHERE month(day) >= 10 OR month(day) <= 3 GROUP BY winter ORDER BY winter DESC LIMIT 6").replace("AS max, arg_min(day, (-v, day)) AS day FROM v", "AS max, arg_min(v.day, (-v.v, v.day)) AS day FROM v"),
    "hazard_exposure": sql(f"""z AS (SELECT s_suppkey AS site, 24 + (s_suppkey * 41 % 1300) / 100.0::DOUBLE AS lat2, 61 + (s_suppkey * 59 % 1600) / 100.0::DOUBLE AS lon2, (s_suppkey * 17 % 300)::DOUBLE AS v FROM supplier), p AS (SELECT station, city, site, v, {_KM} AS km FROM s, z),
        k AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY km, site) AS n FROM p WHERE km <= 400), h AS (SELECT station, city, station % 1000 + 1 AS people, sum(v / pow(greatest(km, 0.001), 2)) / sum(1 / pow(greatest(km, 0.001), 2)) AS hazard FROM k WHERE n <= 8 GROUP BY ALL)
        SELECT city, sum(people)::BIGINT AS people, sum(CASE WHEN hazard > 35 THEN people ELSE 0 END)::BIGINT AS above_35, sum(CASE WHEN hazard > 55 THEN people ELSE 0 END)::BIGINT AS above_55, sum(CASE WHEN hazard > 150 THEN people ELSE 0 END)::BIGINT AS above_150,
               round(sum(people * greatest(hazard - 100, 0)) + 1e-9, 2) AS burden, round(sum(hazard * people) / sum(people), 4) AS weighted FROM h GROUP BY city"""),
    "path_matches": sql(f"""{_PATH}, fr AS (SELECT l_orderkey, l_suppkey, max(l_quantity) AS frp, 24 + (l_suppkey * 41 % 1300) / 100.0::DOUBLE AS lat2, 61 + (l_suppkey * 59 % 1600) / 100.0::DOUBLE AS lon2, CASE WHEN l_orderkey % 7 <> 0 THEN TIMESTAMP '1996-05-01' + to_hours((l_orderkey % 24)::INT) END AS seen FROM lineitem WHERE month(l_shipdate) = 5 GROUP BY l_orderkey, l_suppkey),
        m AS (SELECT city, l_orderkey, l_suppkey, max(frp) AS frp, min(i) AS i FROM pa, fr WHERE {_KM} <= 50 AND coalesce(abs(epoch(seen) - epoch(at_)) <= 7200, true) GROUP BY ALL)
        SELECT city, count(*) AS fires, round(sum(frp) + 1e-9, 2) AS frp, min(i) AS first_hour, round(avg(i), 4) AS mean_hour FROM m GROUP BY city"""),
    "path_residence": sql(f"{_PATH} SELECT city, floor(lat)::BIGINT AS cy, floor(lon)::BIGINT AS cx, count(*) AS hours, min(i) AS enters, max(i) AS leaves FROM pa GROUP BY ALL"),
    "nearest_times": sql(f"""{_S}, d AS (SELECT DISTINCT hour::DATE AS day FROM q), t AS (SELECT hour FROM q WHERE station = 1 AND h % 7 = 3), c AS (SELECT day, hour, abs(epoch(hour) - epoch(day::TIMESTAMP + INTERVAL 12 HOUR)) AS off FROM d, t)
        SELECT day, arg_min(hour, (off, hour)) AS nearest, min(off)::BIGINT AS seconds FROM c GROUP BY day"""),
}
