"""All queries of the time-series engine with their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import scalars
from cadenza.functions.ordered import KEY, tasks_for
from cadenza.functions.scalars import rnd
from cadenza.operators import align, analysis, bands, climbs, decoupling, estimate, exports, history, power, profile, records, retrieval, streams, workout, zonesets
from cadenza.plans.oracles import DAYS, DUR, FTP, HR, KG, POWER, SQL
from cadenza.sources import shared
from cadenza.sources.events import activities, samples, table
from cadenza.sources.store import BUCKETS, CellStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES = SQL


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def aligned(spark: SparkSession, sf_dir: str, view: str = "rides", moving: bool = False) -> DataFrame:
    return align.align(samples(spark, sf_dir, view), moving=moving)


@query
def align_grid(spark, sf_dir):
    return aligned(spark, sf_dir, moving=True).select(KEY, "i", "offset", "valid", "moving", *[rnd(F.col(s), 6).alias(s) for s in align.SIGNALS])


@query
def availability(spark, sf_dir):
    return align.availability(samples(spark, sf_dir, "rides"))


@query
def gap_summary(spark, sf_dir):
    gaps = align.gaps(align.cleaned(samples(spark, sf_dir, "rides")))
    return gaps.groupBy(KEY).agg(
        F.count("*").alias("gap_count"), F.sum("duration_s").alias("gap_seconds"), F.max("duration_s").alias("longest_gap_s"), F.count_if(~F.col("filled")).alias("unfilled_gaps")
    )


@query
def quality(spark, sf_dir):
    found = align.quality(aligned(spark, sf_dir), ("watts", "heartrate")).join(activities(spark, sf_dir, "rides").select(KEY, "device_watts"), KEY)
    return found.withColumn("power_source", align.power_source(F.col("watts_available"), F.col("device_watts"))).drop("device_watts")


@query
def power_metrics(spark, sf_dir):
    return power.power_metrics(aligned(spark, sf_dir), F.lit(FTP), F.lit(KG))


@query
def power_metrics_daily(spark, sf_dir):
    return power.power_metrics(aligned(spark, sf_dir, "days"), F.lit(FTP), F.lit(KG))


@query
def power_curve(spark, sf_dir):
    return power.curve(aligned(spark, sf_dir), DUR).drop("best_raw").withColumn("best_wkg", rnd(F.col("best") / KG, 3))


@query
def signal_summary(spark, sf_dir):
    return power.signal_summary(aligned(spark, sf_dir))


@query
def time_in_power_zones(spark, sf_dir):
    return bands.time_in_zones(aligned(spark, sf_dir), "watts", POWER)


@query
def time_in_hr_zones(spark, sf_dir):
    return bands.time_in_zones(aligned(spark, sf_dir), "heartrate", HR, closed_top=True)


@query
def torque_cadence(spark, sf_dir):
    return bands.torque_by_cadence(aligned(spark, sf_dir))


@query
def efforts(spark, sf_dir):
    return bands.efforts(aligned(spark, sf_dir), FTP)


@query
def work_above_ftp(spark, sf_dir):
    return bands.work_above(aligned(spark, sf_dir), FTP)


@query
def decoupling_halves(spark, sf_dir):
    return decoupling.decoupling(aligned(spark, sf_dir, moving=True), warmup_min=1, low_w=10.0, moving_only=True, min_seconds=100)


QUERIES["decoupling"] = QUERIES.pop("decoupling_halves")


def period_efforts(spark: SparkSession, sf_dir: str, signal: str) -> tuple[DataFrame, DataFrame]:
    """Best efforts among the newest 30 activities of a period, some of which are excluded; only these are aligned."""
    all_ = activities(spark, sf_dir, "days")
    excluded = all_.where(F.col("athlete_id") % 13 == 5)
    listed = records.listed(all_, F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"), 30, excluded)
    return analysis.best_efforts(samples(spark, sf_dir, "days"), listed, DAYS, signal)


@query
def best_effort_period(spark, sf_dir):
    return period_efforts(spark, sf_dir, "watts")[0]


@query
def best_effort_hr(spark, sf_dir):
    return period_efforts(spark, sf_dir, "heartrate")[0]


@query
def best_effort_skips(spark, sf_dir):
    return period_efforts(spark, sf_dir, "watts")[1].select(KEY, "day", "status")


@query
def estimates(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    of = lambda d: F.max(F.when(F.col("duration_s") == d, F.col("best")))
    best = power.curve(rows, (300, 1200)).groupBy(KEY).agg(of(300).alias("short"), of(1200).alias("long"))
    beats = power.curve(rows, (1200,), "heartrate").select(KEY, F.col("best").alias("beats"))
    return best.join(beats, KEY).select(
        KEY, estimate.vo2max(F.col("short"), F.lit(KG)).alias("vo2max"), estimate.ftp(F.col("long")).alias("ftp"), estimate.lthr(F.col("beats")).alias("lthr")
    )


@query
def climb_grade(spark, sf_dir):
    return climbs.grades(climbs.smooth(aligned(spark, sf_dir))).select(KEY, "i", rnd(F.col("smooth"), 4).alias("smooth"), rnd(F.col("grade"), 3).alias("grade"))


def found_climbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align.align(samples(spark, sf_dir, "rides"), most=None).join(activities(spark, sf_dir, "rides").select(KEY, "device_watts"), KEY)
    return climbs.climbs(rows, F.lit(KG), F.col("device_watts"))


@query
def climb_segments(spark, sf_dir):
    return found_climbs(spark, sf_dir)


@query
def climb_trend(spark, sf_dir):
    return climbs.trend(found_climbs(spark, sf_dir), "climb", "avg_w")


@query
def climb_trend_hr(spark, sf_dir):
    return climbs.trend(found_climbs(spark, sf_dir), "climb", "avg_hr")


@query
def climb_gain(spark, sf_dir):
    return climbs.total_gain(found_climbs(spark, sf_dir))


@query
def climb_vs_best(spark, sf_dir):
    """Each climb of a week against the history of its rider, who rides in five groups and pushes harder uphill in some."""
    g = F.regexp_extract(KEY, "^r([0-9]+)", 1).cast("bigint")
    uphill = F.when(F.floor(F.col("sample_idx") / 40) % 2 == 0, 1 + (g % 5) / 4.0).otherwise(1.0)
    ridden = samples(spark, sf_dir, "weeks").withColumn("watts", F.col("watts") * uphill)
    all_ = activities(spark, sf_dir, "weeks").withColumn("rider", F.floor(F.col("athlete_id") / 5))
    cells = align.align(ridden)
    found = climbs.climbs(cells.join(all_.select(KEY, "device_watts"), KEY), F.lit(KG), F.col("device_watts"))
    listed = history.recent(all_, "2024-02-20", by="rider")
    rows = history.climbs_against_history(found, cells, listed, all_, "rider")
    return rows.select(KEY, "climb", "duration_s", "avg_w", "status", "best_w", "best_activity_id", "best_day", "percent_of_best")


def parameters(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(activity_id, device_watts, ftp_w, weight_kg, hr_max_bpm) of each activity, as of its day, from entries among the orders:
    an entry ends where the next of its kind begins, every fifth of them after 9 days."""
    k, metrics = F.col("o_orderkey"), ("ftp_w", "weight_kg", "hr_max_bpm")
    value = F.get(F.array((50 + k % 20).cast("double"), (60 + k % 9).cast("double"), (160 + k % 30).cast("double")), (k % 3).cast("int"))
    start = F.date_add(F.lit("2023-12-20").cast("date"), (k % 50).cast("int"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 60).alias("athlete_id"), F.get(F.array(*map(F.lit, metrics)), (k % 3).cast("int")).alias("metric"), start.alias("effective_from"), value.alias("value"), k.alias("k"))
    entries = rows.groupBy("athlete_id", "metric", "effective_from").agg(F.max("value").alias("value"), F.max("k").alias("k"))
    until = F.date_sub(F.lead("effective_from").over(Window.partitionBy("athlete_id", "metric").orderBy("effective_from")), 1)
    short = F.when(F.col("k") % 5 == 0, F.date_add("effective_from", 9))
    entries = entries.withColumn("effective_to", F.least(until, short)).drop("k")
    acts = activities(spark, sf_dir, view).select(KEY, "athlete_id", "day", "device_watts")
    return profile.as_of_all(acts, entries, ["athlete_id"], "day", metrics).drop("athlete_id", "day")


@query
def activity_analysis(spark, sf_dir):
    """Every module of every week's series."""
    found = analysis.whole(aligned(spark, sf_dir, "weeks").join(parameters(spark, sf_dir, "weeks"), KEY), min_seconds=200)
    flags = [x for m in analysis.MODULES for x in (F.col(f"{m}.available").alias(f"{m}_available"), F.col(f"{m}.code").alias(f"{m}_code"))]
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select(
        KEY, *flags, "modules_available", F.array_join("errors", ",").alias("errors"), "activity_details.cells", "activity_details.valid_seconds", "activity_details.coverage_pct", "activity_details.power_source",
        *[f"power_metrics.{c}" for c in ("avg_w", "np_w", "vi", "intensity", "tss", "work_kj", "avg_wkg", "np_windows")], listed(F.col("power_metrics.unavailable_metrics")).alias("lacking"),
        *[f"heartrate_summary.{c}" for c in ("mean_hr", "max_hr", "min_hr")], "cadence_summary.mean_cadence", listed(F.col("power_zones.seconds")).alias("power_seconds"),
        F.get("power_zones.percent", F.lit(1)).alias("z2_percent"), listed(F.col("heartrate_zones.seconds")).alias("hr_seconds"), F.col("heartrate_zones.unclassified_seconds").alias("hr_unclassified"),
        *[f"decoupling.{c}" for c in ("first_ef", "second_ef", "decoupling_pct")], "climbs.climb_count", "climbs.total_gain_m", F.array_max(F.transform("climbs.climbs", lambda c: c["vam"])).alias("best_vam"),
    )


@query
def compare_activities(spark, sf_dir):
    """Eleven cells of each week's series, with thresholds and weights as of its day."""
    return analysis.compare(aligned(spark, sf_dir, "weeks").join(parameters(spark, sf_dir, "weeks"), KEY))


@query
def comparison_requests(spark, sf_dir):
    """Each user compares the weeks of their own events, and every third user one of the group after theirs."""
    g, week = F.floor(F.col("user_id") / 10).cast("bigint"), F.floor(F.datediff("ts", F.lit("1970-01-01").cast("date")) / 7)
    key = lambda group: F.concat(F.lit("r"), group.cast("string"), F.lit("-w"), week.cast("string"))
    ids = F.when((F.col("user_id") % 3 == 0) & (week % 2 == 0), F.array(key(g), key(g + 1))).otherwise(F.array(key(g)))
    asked = table(spark, sf_dir, "events").select(F.col("user_id").alias("comparison"), g.alias("athlete_id"), F.explode(ids).alias(KEY))
    found = analysis.comparisons(asked, activities(spark, sf_dir, "weeks"))
    return found.withColumn("ids", F.array_join("ids", ","))


@query
def compare_rejected(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias(KEY))
    return analysis.rejected(asked, activities(spark, sf_dir, "rides"), F.lit(1))


@query
def stream_stats(spark, sf_dir):
    return records.series_stats(samples(spark, sf_dir, "rides"))


@query
def downsample(spark, sf_dir):
    return records.downsampled(aligned(spark, sf_dir), "watts", 100).select(KEY, "i", "place", rnd(F.col("watts"), 6).alias("watts"))


@query
def uniform_sample(spark, sf_dir):
    return records.sampled(aligned(spark, sf_dir, moving=True), 100).select(KEY, "i", "moving")


@query
def verbose_streams(spark, sf_dir):
    high, far = F.col("altitude"), F.col("distance")
    rows = samples(spark, sf_dir, "rides").withColumns({"velocity_smooth": far / F.col("t"), "lat": high / 3.1, "lng": -far / 91.7, "grade": high / 7 - 30})
    return streams.spoken(rows).select(KEY, "sample_idx", "seconds_from_start", "clock", "metres", "kilometres", "kmh", "latitude", "longitude", "grade", "watts", "moving")


@query
def stream_page(spark, sf_dir):
    """The second page of 40 points of each series at low resolution: power, heart rate and the moving flag."""
    found = streams.points(aligned(spark, sf_dir, moving=True), ["watts", "heartrate"], ["moving"], "low")
    rows = streams.page(found, 2, 40, "watts")
    hundredths = F.transform("data", lambda x: F.floor(x * 100 + 0.5).cast("bigint").cast("string"))
    return rows.select(KEY, "signal", "page", "pages", "points", "status", F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"), F.array_join(hundredths, ",").alias("data"))


@query
def chunk_assign(spark, sf_dir):
    return records.chunks(aligned(spark, sf_dir), records.chunk_size(5), "valid")


@query
def profile_asof(spark, sf_dir):
    entries = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("athlete_id"), F.to_date("o_orderdate").alias("effective_from")).agg(F.max("o_totalprice").alias("value"))
    entries = entries.withColumn("effective_to", F.date_sub(F.lead("effective_from").over(Window.partitionBy("athlete_id").orderBy("effective_from")), 1))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(KEY), (F.col("l_orderkey") % 500).alias("athlete_id"), F.to_date("l_shipdate").alias("day"))
    rows = rows.groupBy(KEY).agg(F.min("athlete_id").alias("athlete_id"), F.min("day").alias("day"))
    return profile.as_of(rows, entries, ["athlete_id"], "day")


@query
def profile_overlap_violations(spark, sf_dir):
    start = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("athlete_id"), start.alias("effective_from"), F.date_add(start, (F.col("o_orderkey") % 400).cast("int")).alias("effective_to"))
    rows = rows.groupBy("athlete_id", "effective_from").agg(F.min("effective_to").alias("effective_to"))
    return profile.overlaps(rows, ["athlete_id"])


@query
def activity_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    return rows.where(scalars.one_of(F.col("o_orderstatus"), ["F", "O"]) & scalars.one_of(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query
def activity_page(spark, sf_dir):
    return records.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 3, 50, F.desc("o_orderdate"), "o_orderkey")


@query
def recent_activities(spark, sf_dir):
    return records.newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 30, "o_orderdate", "o_orderkey")


@query
def segment_bbox(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("lat"), F.col("s_nationkey").cast("double").alias("lng"))
    return rows.where(records.within(F.col("lat"), F.col("lng"), 10, 3, 60, 15))


@query
def leaderboard_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return records.leaderboard(rows, ["l_suppkey"], F.asc("l_extendedprice"), 10, "l_orderkey", "l_linenumber", "l_partkey").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query
def athlete_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return rows.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("activities"), rnd(F.sum(cents) / 100.0, 2).alias("distance"), F.max("o_totalprice").alias("biggest"))


@query
def format_durations(spark, sf_dir):
    s = F.floor(F.col("value") * 60)
    return table(spark, sf_dir, "events").select("event_id", scalars.clock(s).alias("clock"), scalars.short_duration(s).alias("short"), scalars.local_text(F.col("ts")).alias("local"), scalars.pace(F.col("value")).alias("pace"))


@query
def hr_order_violations(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    metric = F.get(F.array(*map(F.lit, profile.HEART_ORDER)), (k % 3).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("athlete_id"), metric.alias("metric"), (80 + k % 120).cast("double").alias("value"), day.alias("effective_from"), F.date_add(day, (k % 30).cast("int")).alias("effective_to")
    )
    return profile.order_violations(rows, ["athlete_id"], profile.HEART_ORDER)


@query
def profile_violations(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("entry"),
        pick(("ftp_w", "weight_kg", "hr_max_bpm", "speed"), 4).alias("metric"),
        (F.col("o_totalprice") / 1000).alias("value"),
        pick(("W", "kg", "bpm", "W", "W"), 5).alias("unit"),
        day.alias("effective_from"),
        F.date_add(day, (k % 11 - 2).cast("int")).alias("effective_to"),
    )
    return profile.violations(rows).select("entry", "metric", "problem")


@query
def profile_multi_asof(spark, sf_dir):
    metrics = ("ftp_w", "weight_kg", "hr_max_bpm")
    orders = table(spark, sf_dir, "orders").withColumn("athlete_id", F.col("o_custkey") % 200)
    metric = F.get(F.array(*map(F.lit, metrics)), (F.col("o_orderkey") % 3).cast("int"))
    entries = orders.groupBy("athlete_id", metric.alias("metric"), F.to_date("o_orderdate").alias("effective_from")).agg(F.max("o_totalprice").alias("value"))
    w = Window.partitionBy("athlete_id", "metric").orderBy("effective_from")
    entries = entries.withColumn("effective_to", F.date_sub(F.lead("effective_from").over(w), 1))
    rows = orders.select(F.col("o_orderkey").alias(KEY), "athlete_id", F.date_add(F.to_date("o_orderdate"), 40).alias("day"))
    return profile.as_of_all(rows, entries, ["athlete_id"], "day", metrics)


@query
def profile_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("athlete_id"), F.to_date("o_orderdate").alias("effective_from"), F.col("o_totalprice").alias("value"))
    entries = lambda odd: (
        rows.where(F.col("k") % 2 == odd).groupBy("athlete_id", "effective_from").agg(F.max("value").alias("value")).withColumn("effective_to", F.lit(None).cast("date"))
    )
    return profile.upserted(entries(0), entries(1), ["athlete_id"], overwrite=False)


@query
def leaderboard_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        F.col("l_returnflag").alias("gender"),
        F.col("l_quantity").alias("age"),
        (40 + F.col("l_suppkey") % 60).alias("weight"),
        (F.col("l_linenumber") % 2 == 0).alias("followed"),
        F.array((F.col("l_partkey") % 7).cast("int"), (F.col("l_partkey") % 7 - 2).cast("int")).alias("clubs"),
        F.to_date("l_shipdate").alias("day"),
    )
    kept = records.leaderboard_filter(
        rows, F.lit("1997-10-15").cast("date"), gender="R", age_group="25_34", weight_class="65_74", following=True, club_id=1, date_range="this_year"
    )
    best = kept.orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey").limit(100)
    w = Window.orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")  # 100 rows
    return best.withColumn("rank", F.row_number().over(w)).select("l_orderkey", "l_linenumber", "rank")


@query
def climb_category(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("climb_category"))
    return records.climb_category(rows, True, 2, 4)


@query
def athlete_period_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("o_orderpriority", "sport")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    return records.period_totals(rows, ["c_nationkey", "sport"], F.to_date("o_orderdate"), F.lit("1998-06-30").cast("date"), 28, distance=cents)


@query
def record_counts(spark, sf_dir):
    hit = F.count_if(scalars.one_of(F.col("o_orderstatus"), ["F"]))
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("fetched"), hit.alias("matching"), F.least(hit, F.lit(50)).alias("returned"))


@query
def unit_conversions(spark, sf_dir):
    metres, e = F.col("value") * 1000, F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        rnd(scalars.km(metres), 3).alias("km"),
        rnd(scalars.miles(metres), 3).alias("miles"),
        rnd(scalars.feet(F.col("value")), 3).alias("feet"),
        rnd(scalars.kmh(F.col("value")), 3).alias("kmh"),
        scalars.time_of_day(metres).alias("clock_of_day"),
        scalars.shortened(F.col("props"), 8).alias("short"),
        scalars.joined(F.col("event_type"), F.when(e % 3 != 0, F.col("props"))).alias("joined"),
        scalars.valid_id(F.when(e % 2 == 0, F.concat(F.lit(" "), e.cast("string"))).otherwise(F.concat(F.lit("x"), e.cast("string")))).alias("id"),
        scalars.types_key(F.array(F.col("event_type"), F.lit("heartrate"))).alias("types"),
        scalars.decoded(e % 4, {1: "1", 2: "2", 3: "3"}, "open").alias("source"),
    )


@query
def photo_urls(spark, sf_dir):
    urls = F.create_map(F.lit("100"), F.concat("event_type", F.lit("/s")), F.lit("600"), F.concat("event_type", F.lit("/l")))
    return scalars.entries(table(spark, sf_dir, "events").select("user_id", "event_id", urls.alias("urls")), "urls", "size", "url")


@query
def route_gpx(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("place"), (F.col("o_orderkey") % 90).cast("double").alias("lat"), (F.col("o_orderkey") % 180).cast("double").alias("lng"))
    return exports.track_points(points, "o_custkey")


@query
def workout_segments(spark, sf_dir):
    """A workout line for each event, numbered along each user's events; lines are read one by one, no text is gathered."""
    k = F.get_json_object("props", "$.k").cast("int")
    target = F.get(F.array(*map(F.lit, ("tempo", "80% FTP", "Very hard", "steady"))), k % 4)
    line = F.concat(F.lit("- "), "event_type", F.lit(": "), k.cast("string"), F.when(k % 2 == 0, " min at ").otherwise(" sec at "), target)
    line = F.concat(line, F.when(k % 3 == 0, F.concat(F.lit(" [Cadence: "), k.cast("string"), F.lit(", Notes: go]"))).otherwise(""))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return workout.segments_of_lines(table(spark, sf_dir, "events").select("user_id", place.alias("place"), line.alias("line")), "user_id")


@query
def activity_by_id(spark, sf_dir):
    return retrieval.by_id(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey", " 100 ")


@query
def activity_details(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 5000).alias("seconds"))
    return retrieval.details(rows, F.col("o_totalprice"), F.col("seconds"), F.col("o_orderstatus") == "F").select("o_orderkey", "km", "kmh", "pace")


@query
def segment_efforts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp_ntz").alias("start"))
    return retrieval.in_period(rows, "start", "1996-02-01 00:00:00", "1996-03-15 00:00:00")


@query
def activity_laps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("metres"), F.sum("l_quantity").alias("seconds"))
    metres = F.floor(F.col("metres") + 0.5).cast("bigint")
    return retrieval.laps(rows, "l_orderkey", "l_linenumber", metres, F.col("seconds") * 60).select("l_orderkey", "lap", "km", "kmh", "total_km")


@query
def athlete_zones(spark, sf_dir):
    edge = lambda i: F.floor(F.col("c_custkey") % 40).cast("int") + 100 + 20 * i
    each = [F.struct((F.lit(0) if i == 0 else edge(i)).cast("int").alias("min"), (F.lit(-1) if i == 4 else edge(i + 1)).cast("int").alias("max")) for i in range(5)]
    return retrieval.zones(table(spark, sf_dir, "customer").select("c_custkey", F.array(*each).alias("zones")), "zones")


@query
def athlete_shoes(spark, sf_dir):
    shoe = F.struct(F.concat(F.lit("shoe"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("distance"), (F.col("o_orderstatus") == "F").alias("primary"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(shoe).alias("shoes"))
    return retrieval.gear(rows, "shoes")


@query
def starred_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3 == 0).alias("starred"), (F.col("p_size") * 137).cast("double").alias("metres"), (F.col("p_partkey") % 2 == 0).alias("metric"))
    return retrieval.starred(rows, "starred", F.col("metres"), F.col("metric")).select("p_partkey", "length", "unit")


@query
def cell_store(spark, sf_dir):
    """A store filled twice: at first with half of the series, some of them without a few samples, then with all."""
    all_, g = shared.written(samples(spark, sf_dir, "rides"), "samples"), F.substring(KEY, 2, 20).cast("bigint")  # read by both fills, twice each
    some = all_.where((g % 2 == 0) & ((g % 4 != 0) | (F.col("sample_idx") % 50 != 7)))
    buckets = max(BUCKETS, tasks_for(spark, all_.count()))
    store = CellStore(spark, f"{shared.folder(spark)}/cadenza/{uuid.uuid4().hex}", buckets=buckets)
    store.fill(some)
    second = store.fill(all_).select(KEY, F.lit(2).alias("fill"))
    watts = F.sum(F.floor(F.col("watts") * 100 + 0.5).cast("bigint"))
    per = store.cells().groupBy(KEY).agg(F.count("*").alias("cells"), F.count_if("valid").alias("valid_cells"), watts.alias("watts"))
    return per.join(second, KEY, "left").select(KEY, "cells", "valid_cells", "watts", F.coalesce("fill", F.lit(1)).alias("fill"))


@query
def cache_newest(spark, sf_dir):
    """The newest 200 orders as long as their prices stay below a limit."""
    return records.kept_newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), F.col("o_orderdate"), F.col("o_totalprice"), "o_orderkey", 200, 20_000_000)


@query
def cache_bytes(spark, sf_dir):
    """The newest orders as long as their prices add up to no more than a limit, however many they are."""
    return records.kept_newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), F.col("o_orderdate"), F.col("o_totalprice"), "o_orderkey", None, 128 << 20)


def zone_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, athlete_id, set, signal, zones, effective_from, problem): even customers make power zones of their own, some
    with a fault, odd ones heart-rate zones from a threshold."""
    k = F.col("c_custkey")
    lowers = [F.lit(0.0), *[(j * (10 + k % 7)).cast("double") for j in range(1, 5)]]
    own = zonesets.zone_array([f"P{j}" for j in range(5)], lowers)
    faulty = F.transform(own, lambda z, j: F.struct(z["name"].alias("name"), z["lower"].alias("lower"), (z["upper"] + F.when((j == 1) & (k % 22 == 0), 1).otherwise(0)).alias("upper")))
    lthr = (k % 50 + 89).cast("double")
    beats = zonesets.lthr_zones(lthr, F.when(k % 5 != 0, lthr + k % 3 * 8))
    even = k % 2 == 0
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        (F.floor(k / 2) % 60).alias("athlete_id"),
        F.when(even, "own_power").otherwise("lthr").alias("set"),
        F.when(even, "watts").otherwise("heartrate").alias("signal"),
        F.when(even, faulty).otherwise(beats).alias("zones"),
        F.date_add(F.lit("2023-12-01").cast("date"), (k % 53).cast("int")).alias("effective_from"),
    )
    return rows.withColumn("problem", zonesets.problem(F.col("zones"), F.col("set") == "lthr"))


@query
def zone_problems(spark, sf_dir):
    """Each athlete's sets of zones that break a rule."""
    return zone_sets(spark, sf_dir).where("problem is not null").select("c_custkey", "set", "problem")


@query
def time_in_own_zones(spark, sf_dir):
    """Time in each athlete's own sets of zones as of the week, power and heart rate side by side."""
    fine = zone_sets(spark, sf_dir).where("problem is null")
    by = ["athlete_id", "set", "effective_from"]
    one = fine.groupBy(*by).agg(F.min_by(F.struct("signal", "zones"), "c_custkey").alias("x")).select(*by, "x.*")
    until = F.date_sub(F.lead("effective_from").over(Window.partitionBy("athlete_id", "set").orderBy("effective_from")), 1)
    held = zonesets.assigned(activities(spark, sf_dir, "weeks"), one.withColumn("effective_to", until))
    return zonesets.time_in_sets(aligned(spark, sf_dir, "weeks"), held)


@query
def span_slices(spark, sf_dir):
    """The cells of a span of the week for each event: how many, how many valid, and their power."""
    week = F.floor(F.datediff("ts", F.lit("1970-01-01").cast("date")) / 7).cast("string")
    key = F.concat(F.lit("r"), F.floor(F.col("user_id") / 10).cast("bigint").cast("string"), F.lit("-w"), week)
    start = F.col("event_id") * 37 % 900 - 20
    spans = table(spark, sf_dir, "events").select(key.alias(KEY), "event_id", start.alias("from_i"), (start + F.col("event_id") % 90 - 5).alias("to_i"))
    cells = align.sliced(aligned(spark, sf_dir, "weeks"), spans)
    watts = F.sum(F.when(F.col("valid"), F.floor(F.col("watts") * 100 + 0.5).cast("bigint")))
    return cells.groupBy("event_id").agg(F.count("*").alias("cells"), F.count_if("valid").alias("valid_cells"), F.max("i").alias("last_i"), watts.alias("watts"))


@query
def sanitize_envelopes(spark, sf_dir):
    """Nested results of each event, some numbers of which aren't finite."""
    e, v = F.col("event_id"), F.col("value")
    odd = lambda n, x: F.when(e % n == 0, float("nan")).when(e % n == 1, float("inf")).when(e % n == 2, float("-inf")).otherwise(x)
    curve = F.array(odd(5, v), v, odd(7, v * 2))
    metrics = F.struct(odd(11, v).alias("np"), F.struct(curve.alias("curve"), F.lit("W").alias("unit")).alias("power"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 13 != 0, metrics).alias("metrics"), F.create_map(F.lit("z1"), odd(17, v), F.lit("z2"), F.lit(0.0)).alias("zones"))
    found = scalars.sanitized(rows)
    curve = F.col("metrics.power.curve")
    return found.select("event_id", F.col("metrics.np").alias("np"), F.get(curve, F.lit(0)).alias("c0"), F.get(curve, F.lit(1)).alias("c1"), F.get(curve, F.lit(2)).alias("c2"), F.col("zones")["z1"].alias("z1"), F.col("zones")["z2"].alias("z2"), F.array_join("changed", "; ").alias("changed"))


@query
def athlete_routes(spark, sf_dir):
    """The second page of three of each customer's routes, newest first; lines of an order are its segments."""
    segments = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route_id")).agg(F.collect_list("l_linenumber").alias("segments"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("athlete_id"), "o_orderdate", F.col("o_totalprice").alias("metres"), (F.col("o_totalprice") / 37).alias("climbed"), (F.col("o_orderkey") % 4).alias("type"))
    return retrieval.routes(rows.join(segments, "route_id", "left"), "athlete_id", 2, 3, F.desc("o_orderdate"), "route_id").drop("o_orderdate")


@query
def athlete_clubs(spark, sf_dir):
    """A club for each nation: its members' segments are its sports."""
    members = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"), F.collect_set("c_mktsegment").alias("sports"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    city = F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("c"), F.col("n_nationkey").cast("string")))
    rows = nations.join(members, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_nationkey").alias("club_id"), F.col("n_name").alias("name"), "sports", "members", city.alias("city"), F.lit("").alias("state"), F.col("r_name").alias("country"), (F.col("n_nationkey") % 2 == 0).alias("private")
    )
    return retrieval.clubs(rows)


@query
def parameter_sources(spark, sf_dir):
    """The threshold power of each order's day, with where it comes from: an override, an entry of any source, or nowhere."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(k.alias("k"), (F.col("o_custkey") % 300).alias("athlete_id"), day.alias("day"), F.col("o_totalprice").alias("price"))
    source = F.get(F.array(*map(F.lit, ("manual", "estimated_20min", "estimated_hr20min"))), (F.col("k") % 3).cast("int"))
    entries = orders.where("k % 2 = 0").groupBy("athlete_id", F.col("day").alias("effective_from")).agg(F.max_by(F.struct(F.col("price").alias("value"), source.alias("source")), "k").alias("x"))
    entries = entries.select("athlete_id", "effective_from", "x.*")
    until = F.date_sub(F.lead("effective_from").over(Window.partitionBy("athlete_id").orderBy("effective_from")), 1)
    rows = orders.where("k % 2 = 1").select("k", "athlete_id", "day", F.when(F.col("k") % 5 == 0, F.col("price") + 1).alias("asked"))
    return profile.resolved_as_of(rows, entries.withColumn("effective_to", F.least(until, F.date_add("effective_from", 60))), ["athlete_id"], "day", "asked").drop("asked")
