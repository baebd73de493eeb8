"""Series and entity views over the event and order tables, for queries without recorded activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, dealt

#: Users whose events make one series together.
USERS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def group() -> Column:
    return F.floor(F.col("user_id") / USERS).cast("bigint")


def key_of(view: str) -> Column:
    """rides: a series of each group of users; days and weeks: one of each group and day, or week."""
    name = F.concat(F.lit("r"), group().cast("string"))
    if view == "weeks":
        week = F.floor(F.datediff("ts", F.lit("1970-01-01").cast("date")) / 7)
        return F.concat(name, F.lit("-w"), week.cast("string"))
    return name if view == "rides" else F.concat(name, F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))


def samples(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(activity_id, sample_idx, t, watts, heartrate, cadence, altitude, distance, moving): every event is a sample.

    A sample comes 1 to 3 seconds after the one before, now and then 6. The road rises for 40 samples and
    falls for 40. Every seventh group has no power, every fifth no heart rate, every eleventh no altitude.
    """
    k, g = F.get_json_object("props", "$.k").cast("int"), group()
    events = table(spark, sf_dir, "events")
    rows = dealt(events.select(key_of(view).alias(KEY), "ts", "event_id", "value", k.alias("k"), g.alias("g")), events.count())
    order = Window.partitionBy(KEY).orderBy("ts", "event_id")
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    rows = rows.withColumn("step", F.when(F.col("event_id") % 701 == 0, 6).otherwise(1 + F.col("k") % 3))
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    rise = F.when(F.floor(F.col("n") / 40) % 2 == 0, F.col("step") * (50 + F.col("k") % 10)).otherwise(-F.col("step") * (40 + F.col("k") % 10))
    has = lambda every: F.col("g") % every != every - 1
    beats = F.least(F.lit(178.0), F.floor(95 + 0.19 * F.col("value") + 0.5).cast("double"))
    return rows.select(
        KEY,
        F.col("n").alias("sample_idx"),
        F.sum("step").over(up).cast("double").alias("t"),
        F.when(has(7), F.col("value")).alias("watts"),
        F.when(has(5) & (F.col("k") % 10 != 0), beats).alias("heartrate"),
        F.col("k").cast("double").alias("cadence"),
        F.when(has(11), (10_000 + F.sum(rise).over(up)) / 100.0).alias("altitude"),
        (F.sum(F.col("step") * (70 + F.col("k") % 20)).over(up) / 10.0).alias("distance"),
        (F.col("k") % 17 != 0).alias("moving"),
    )


def activities(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """(activity_id, athlete_id, day, device_watts) of each series: power is measured, estimated or unknown by group."""
    rows = table(spark, sf_dir, "events").select(key_of(view).alias(KEY), group().alias("athlete_id"), "ts")
    rows = rows.groupBy(KEY).agg(F.min("athlete_id").alias("athlete_id"), F.to_date(F.min("ts")).alias("day"))
    measured = F.when(F.col("athlete_id") % 4 == 1, F.lit(False)).when(F.col("athlete_id") % 4 != 3, F.lit(True))
    return rows.withColumn("device_watts", measured)
