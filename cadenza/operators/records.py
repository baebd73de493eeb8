"""Record queries: filters, pages, leaderboards, totals, series statistics, down-sampling and chunks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import km, kmh, micro, rnd, time_of_day
from cadenza.sources.shared import written


def newest(rows: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(by), tie).limit(n)


def page(rows: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """The rows of one page, from 1; an offset and a limit, so no global window."""
    if number < 1 or size < 1:
        raise ValueError("pages count from 1")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def within(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def leaderboard(rows: DataFrame, by: Sequence[str], score: Column, k: int, *ties: str) -> DataFrame:
    """The k best rows of each group with their `rank`."""
    w = Window.partitionBy(*by).orderBy(score, *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def series_stats(samples: DataFrame) -> DataFrame:
    """Statistics of each series' own samples, without their data: heart rate, power, speed in km/h and naive normalised power."""
    w = Window.partitionBy(KEY).orderBy("sample_idx")
    speed = (F.col("distance") - F.lag("distance").over(w)) / F.nullif(F.col("t") - F.lag("t").over(w), F.lit(0.0))
    mean = lambda c: F.sum(micro(F.col(c))) / 1e6 / F.nullif(F.count(c), F.lit(0))
    per = (
        samples.withColumn("speed", speed)
        .groupBy(KEY)
        .agg(
            F.count("*").alias("samples"),
            F.max("heartrate").alias("hr_max"),
            F.min("heartrate").alias("hr_min"),
            rnd(mean("heartrate"), 0).alias("hr_avg"),
            F.max("watts").alias("watts_max"),
            rnd(mean("watts"), 0).alias("watts_avg"),
            rnd(kmh(F.max("speed")), 1).alias("speed_max"),
            rnd(kmh(mean("speed")), 1).alias("speed_avg"),
        )
    )
    return per.join(naive_np(samples), KEY)


def target_cells(i: Column, n: Column, most: int) -> Column:
    """Whether i is one of `most` evenly spaced places among n, ends included; every place if there are no more than that."""
    if most < 2:
        return (n <= most) | (i == 0)
    at = lambda j: F.floor(j * (n - 1) / (most - 1) + 0.5).cast("bigint")
    j = F.floor(i * (most - 1) / F.greatest(n - 1, F.lit(1))).cast("bigint")
    near = [(at(j + d) == i) & (j + d).between(0, most - 1) for d in (-1, 0, 1, 2)]
    return (n <= most) | near[0] | near[1] | near[2] | near[3]


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """`most` evenly spaced cells of each series, the first and the last among them."""
    n = F.count("*").over(Window.partitionBy(KEY))
    return rows.withColumn("__n", n).where(target_cells(F.col("i"), F.col("__n"), most)).drop("__n")


def downsampled(rows: DataFrame, signal: str, most: int, reach: int = 3, share: float = 0.1) -> DataFrame:
    """(activity_id, i, place, signal): about `most` cells of each series: evenly spaced ones, with the peaks and valleys
    near them that differ by more than `share`; in order, without repeats, cut off after `most`. One pass by activity."""
    w = Window.partitionBy(KEY).orderBy("i")
    n = F.count("*").over(Window.partitionBy(KEY))
    cell = lambda d: F.when((F.col("i") + d).between(0, F.col("n") - 1), F.struct(F.lead(signal, d).over(w).alias("v"), (F.col("i") + d).alias("i")))
    near = rows.withColumn("n", n).withColumn("near", F.array_compact(F.array(*[cell(d) for d in range(-reach, reach + 1)])))
    near = near.where(target_cells(F.col("i"), F.col("n"), most))
    high = F.array_max(F.transform("near", lambda x: F.struct(x["v"].alias("v"), (-x["i"]).alias("minus"))))
    low = F.array_min("near")
    far = lambda v: F.abs(v - F.col(signal)) > share * F.abs(F.col(signal))
    pick = lambda i, v: F.struct(i.alias("i"), v.alias(signal))
    near = near.withColumns({"high": high, "low": low})
    picks = F.array(
        pick(F.col("i"), F.col(signal)),
        F.when(far(F.col("high.v")), pick(-F.col("high.minus"), F.col("high.v"))),
        F.when(far(F.col("low.v")), pick(F.col("low.i"), F.col("low.v"))),
    )
    kept = near.select(KEY, F.inline(F.array_compact(picks))).groupBy(KEY, "i").agg(F.first(signal).alias(signal))
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def naive_np(samples: DataFrame, window: int = 30) -> DataFrame:
    """(activity_id, naive_np): normalised power over runs of samples, whatever their times, whole watts; 0 with fewer."""
    w = Window.partitionBy(KEY).orderBy("sample_idx")
    total = F.sum(micro(F.coalesce("watts", F.lit(0.0)))).over(w.rowsBetween(-window + 1, 0))
    mean = F.when(F.row_number().over(w) >= window, total / float(window) / 1e6)
    per = samples.select(KEY, F.pow(mean, F.lit(4.0)).alias("f")).groupBy(KEY).agg(F.avg("f").alias("f"))
    return per.select(KEY, F.coalesce(rnd(F.pow("f", F.lit(0.25)), 0), F.lit(0.0)).alias("naive_np"))


def chunks(rows: DataFrame, size: int, *signals: str) -> DataFrame:
    """(activity_id, chunk, points, payload): series cut into chunks of `size` cells, the payload their signals as JSON."""
    point = F.struct("i", *signals)
    per = rows.groupBy(KEY, F.expr(f"i div {int(size)}").alias("chunk")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    values = F.struct(*[F.col(f"points.{s}").alias(s) for s in ("i", *signals)])
    return per.select(KEY, "chunk", F.size("points").cast("bigint").alias("points"), F.to_json(values).alias("payload"))


def unpivoted(totals: DataFrame, by: Sequence[str], kinds: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(by, kind, measures...): columns named `<kind>_<measure>` as a row for each kind."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{k}_{m}").alias(m) for m in measures]) for k in kinds])
    return totals.select(*by, F.inline(each))


def period_totals(rows: DataFrame, by: Sequence[str], day: Column, today: Column, recent_days: int, **sums: Column) -> DataFrame:
    """(by, period, activities, sums...): totals of the recent days, of the year to date and of all time, empty ones too.

    A row adds to every period it lies in, so the table is read once.
    """
    inside = {"recent": (day > F.date_sub(today, recent_days)) & (day <= today), "ytd": (F.year(day) == F.year(today)) & (day <= today), "all": F.lit(True)}
    aggs = [
        x
        for p, hit in inside.items()
        for x in (F.count_if(hit).alias(f"{p}_activities"), *[F.coalesce(F.sum(F.when(hit, c)), F.lit(0)).alias(f"{p}_{n}") for n, c in sums.items()])
    ]
    return unpivoted(rows.groupBy(*by).agg(*aggs), by, list(inside), ["activities", *sums]).withColumnRenamed("kind", "period")


#: The age groups and weight classes of a leaderboard, by their lower ends.
AGE_GROUPS = ((0, "0_19"), (20, "20_24"), (25, "25_34"), (35, "35_44"), (45, "45_54"), (55, "55_64"), (65, "65_69"), (70, "70_74"), (75, "75_plus"))
WEIGHT_CLASSES = ((0, "0_54"), (55, "55_64"), (65, "65_74"), (75, "75_84"), (85, "85_94"), (95, "95_plus"))


def class_of(value: Column, classes: Sequence[tuple[int, str]]) -> Column:
    """The name of the last class that begins at or below value."""
    out = F.lit(None).cast("string")
    for least, name in classes:
        out = F.when(value >= least, name).otherwise(out)
    return out


def date_range(day: Column, today: Column, name: str) -> Column:
    """Whether a day is in this_year, this_month, this_week (from Monday) or today."""
    unit = {"this_year": "year", "this_month": "month", "this_week": "week", "today": "day"}[name]
    return (day >= F.to_date(F.date_trunc(unit, today))) & (day <= today)


def leaderboard_filter(rows: DataFrame, today: Column | None = None, **wanted: object) -> DataFrame:
    """Efforts that fit every filter given: gender, age_group (by age), weight_class (by weight), following, club_id (in
    clubs), date_range (by day)."""
    tests = {
        "gender": lambda v: F.col("gender") == v,
        "age_group": lambda v: class_of(F.col("age"), AGE_GROUPS) == v,
        "weight_class": lambda v: class_of(F.col("weight"), WEIGHT_CLASSES) == v,
        "following": lambda v: F.col("followed") if v else F.lit(True),
        "club_id": lambda v: F.array_contains("clubs", v),
        "date_range": lambda v: date_range(F.col("day"), today if today is not None else F.current_date(), v),
    }
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(tests[name](value))
    return rows


def climb_category(rows: DataFrame, riding: bool, least: int | None = None, most: int | None = None) -> DataFrame:
    """Segments within a range of climb categories (0 to 5); for other sports than riding the range doesn't count."""
    for bound in (least, most):
        if bound is not None and not 0 <= bound <= 5:
            raise ValueError("climb categories go from 0 to 5")
    if riding and least is not None:
        rows = rows.where(F.col("climb_category") >= least)
    if riding and most is not None:
        rows = rows.where(F.col("climb_category") <= most)
    return rows


def listed(rows: DataFrame, first: Column, last: Column, most: int, excluded: DataFrame | None = None) -> DataFrame:
    """The newest `most` activities of a period, both days included, with their place `pos`; the excluded ones go afterwards,
    so they still take up places."""
    rows = rows.where(F.col("day").between(first, last)).orderBy(F.desc("day"), KEY).limit(most)
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("day"), KEY)))  # `most` rows
    return rows if excluded is None else rows.join(excluded.select(KEY), KEY, "left_anti")


def chunk_size(types: int, verbose: bool = False) -> int:
    """Points of a chunk of about 50 kB."""
    return max(50, min(1000 if verbose else 2000, (50 * 1024 - 500) // ((120 if verbose else 25) * max(1, types))))


def kept_newest(rows: DataFrame, at: Column, size: Column, tie: str, most: int | None = 200, most_bytes: int = 128 << 20) -> DataFrame:
    """rows newest first by `at`, up to `most` of them and as long as their sizes add up to `most_bytes` at most.

    Sizes of rows that don't fit count on, so all later ones are left out as well. Sizes aren't negative, null ones are 0, null times last; tie, a
    column, orders equal times. With `most` the newest rows are picked first. Without it the sum runs over all rows in two
    levels: they are written in ranges of time, the sum of each range is taken, and within a range only local sums are
    added to it. The ranges' sums, a row for each shuffle partition, are all that reaches the driver; ranges that begin
    beyond the limit aren't read again.
    """
    order = [F.col("__at").desc_nulls_last(), F.col(tie).asc_nulls_last()]
    rows = rows.withColumns({"__at": at, "__size": F.coalesce(size.cast("bigint"), F.lit(0))})
    if most is not None:
        newest = rows.orderBy(*order).limit(most)
        total = F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # `most` rows
        return newest.withColumn("__total", total).where(F.col("__total") <= most_bytes).drop("__at", "__size", "__total")
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__range").agg(F.sum("__size").alias("s"), F.max("__at").alias("at")).orderBy("__range").collect()
    before, start = 0, {}
    for r in sums:
        if before <= most_bytes:
            start[r["__range"]] = before
        before += r["s"]
    if not start:
        return ranged.drop("__at", "__size", "__range")
    base = F.get(F.from_json(F.lit(json.dumps([start.get(k, 0) for k in range(max(start) + 1)])), "array<bigint>"), F.col("__range"))
    local = F.sum("__size").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    reached = ranged.where(F.col("__range") <= max(start)).withColumn("__total", base + local)
    return reached.where(F.col("__total") <= most_bytes).drop("__at", "__size", "__range", "__total")
