"""Best efforts of an athlete's history over durations that come from the data, each activity left out of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, prefixes
from cadenza.functions.scalars import rnd
from cadenza.operators.power import with_signal
from cadenza.sources.shared import written

#: Days of history, and activities of an athlete that are listed for it.
HISTORY_DAYS, HISTORY_MOST = 42, 30


def recent(activities: DataFrame, to: object, days: int = HISTORY_DAYS, most: int = HISTORY_MOST, by: str = "athlete_id") -> DataFrame:
    """The newest `most` activities of each athlete in the `days` before the day `to`, both ends included, with their place `pos`."""
    if days <= 0 or most <= 0:
        raise ValueError("days and most must be positive")
    to = F.lit(to).cast("date")
    rows = activities.where(F.col("day").between(F.date_sub(to, days), to))
    pos = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("day"), KEY))
    return rows.withColumn("pos", pos).where(F.col("pos") <= most)


def running_sums(aligned: DataFrame, signal: str = "watts") -> DataFrame:
    """(activity_id, sums, valid): arrays of running sums of the signal, in millionths, and of running counts of valid cells.

    Both begin with a 0, so the sum of the `d` cells before place `k` is sums[k] - sums[k - d]. A series has 86,400 cells at
    most, see align.cleaned(). Series without the signal are left out.
    """
    rows = prefixes(aligned.where(with_signal(aligned, signal)), signal)
    cells = F.array_sort(F.collect_list(F.struct("i", "s", "ok")))
    per = rows.groupBy(KEY).agg(cells.alias("cells"))
    running = lambda field: F.concat(F.array(F.lit(0).cast("bigint")), F.transform("cells", lambda c: c[field].cast("bigint")))
    return per.select(KEY, running("s").alias("sums"), running("ok").alias("valid"))


def best_over(sums: DataFrame, durations: DataFrame) -> DataFrame:
    """(activity_id, duration_s, best, start_i, end_i): the best mean of each activity over each of its durations, the earliest
    of equals; durations without a wholly valid window are left out.

    sums is what running_sums() gives, durations has (activity_id, durations array). Every window is the difference of two
    look-ups in the arrays. The windows of a duration are made and compared within the series' row: as rows of their own each
    would carry the arrays through a sort.
    """
    rows = sums.join(durations.select(KEY, "durations"), KEY)
    fine = F.filter(F.array_distinct("durations"), lambda d: (d > 0) & (d < F.size("sums")))

    def best(d: Column) -> Column:
        gone = lambda c, at: F.get(c, at) - F.get(c, at - d.cast("int"))
        window = lambda at: F.when(gone("valid", at) == d, F.struct(gone("sums", at).alias("s"), (-at).alias("minus")))
        return F.array_max(F.transform(F.sequence(d.cast("int"), F.size("sums") - 1), window))

    per = rows.select(KEY, F.inline(F.transform(fine, lambda d: F.struct(d.alias("duration_s"), best(d).alias("b"))))).where("b is not null")
    end = -F.col("b.minus")
    return per.select(KEY, "duration_s", rnd(F.col("b.s") / F.col("duration_s") / 1e6, 2).alias("best"), (end - F.col("duration_s")).cast("bigint").alias("start_i"), (end - 1).cast("bigint").alias("end_i"))


def two_best(efforts: DataFrame, by: str = "athlete_id") -> DataFrame:
    """(by, duration_s, first, second): the best effort over each duration and the best of another activity, as structs
    (activity_id, day, best); of equals the one listed earlier. efforts has (by, activity_id, day, pos, duration_s, best)."""
    one = F.struct((-F.col("best")).alias("minus"), "pos", KEY, "day", "best")
    top = F.row_number().over(Window.partitionBy(by, "duration_s").orderBy(F.desc("best"), "pos"))
    rows = efforts.withColumn("__top", top).where("__top <= 2")
    per = rows.groupBy(by, "duration_s").agg(F.array_sort(F.collect_list(one)).alias("t"))
    pick = lambda k: F.when(F.size("t") > k, F.struct(F.get("t", F.lit(k))[KEY].alias(KEY), F.get("t", F.lit(k))["day"].alias("day"), F.get("t", F.lit(k))["best"].alias("best")))
    return per.select(by, "duration_s", pick(0).alias("first"), pick(1).alias("second"))


def climbs_against_history(found: DataFrame, history: DataFrame, listed: DataFrame, activities: DataFrame, by: str = "athlete_id") -> DataFrame:
    """found (see climbs.climbs()) with duration_s, status, best_w, best_activity_id, best_day and percent_of_best: each climb's
    power against the best mean over as many seconds in the athlete's history without the climb's own activity.

    history has the cells of the listed activities, listed (see recent()) their athlete, day, pos and device_watts; only measured
    power counts, on both sides, though an unmeasured activity takes up a place in the list. activities has the athlete and
    device_watts of the climbs' activities. A record is over 100 percent. status is compared, not_measured, no_power or no_history.

    Durations are gathered for each athlete (86,400 at most), every listed series makes its windows of them in one pass, and the
    two best activities of each duration are kept: a climb takes the first that isn't its own, so nothing is joined with itself.
    """
    mine = activities.select(KEY, by, F.col("device_watts").alias("__measured"))
    rows = found.join(mine, KEY, "left").withColumn("duration_s", (F.col("to_i") - F.col("from_i")).cast("bigint"))
    rows = written(rows, "climbs")  # a row a climb, read twice, so that climbs are looked for once
    asked = rows.where("__measured and duration_s > 0").groupBy(by).agg(F.collect_set("duration_s").alias("durations"))
    used = listed.where("device_watts").select(KEY, by, "day", "pos")
    sums = running_sums(history.join(used.select(KEY), KEY, "left_semi"))
    efforts = best_over(sums, used.join(asked, by).select(KEY, "durations")).join(used, KEY)
    other = F.when(F.col(f"first.{KEY}") != F.col(KEY), F.col("first")).otherwise(F.col("second"))
    rows = rows.join(two_best(efforts, by), [by, "duration_s"], "left").withColumn("__other", other)
    status = F.when(~F.coalesce("__measured", F.lit(False)), "not_measured").when(F.col("avg_w").isNull(), "no_power").when(F.col("__other").isNull(), "no_history").otherwise("compared")
    rows = rows.withColumn("status", status)
    shown = lambda x: F.when(F.col("status") == "compared", x)
    return rows.select(
        *found.columns,
        "duration_s",
        "status",
        shown(F.col("__other.best")).alias("best_w"),
        shown(F.col(f"__other.{KEY}")).alias("best_activity_id"),
        shown(F.col("__other.day")).alias("best_day"),
        shown(rnd(F.col("avg_w") / F.nullif("__other.best", F.lit(0.0)) * 1000, 0) / 10.0).alias("percent_of_best"),
    )
