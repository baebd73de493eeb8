"""Streams of activities as asked for: signals, resolution, pages, statistics, compact and spoken forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import km, kmh, rnd, time_of_day
from cadenza.operators.records import target_cells

#: The points of a series at each resolution.
RESOLUTIONS = {"low": 100, "medium": 1000, "high": 10_000}
#: Cells beside an evenly spaced one among which a peak or valley is looked for, and by how much of its value it must differ.
REACH, SHARE = 3, 0.1


def points(rows: DataFrame, signals: Sequence[str], flags: Sequence[str] = (), resolution: str = "low", reach: int = REACH, share: float = SHARE) -> DataFrame:
    """(activity_id, signal, place, i, value) of each signal of rows (activity_id, i, signals..., flags...) at a resolution.

    A series of no more cells than the resolution keeps all of them. Else signals keep evenly spaced cells with the peaks and
    valleys near them, each by itself, in order and cut off after the resolution's count; flags, whose value is 1 or 0, only
    the evenly spaced ones. All signals are picked in one pass over the rows by activity, and only picked cells go on.
    """
    most = RESOLUTIONS[resolution]
    w = Window.partitionBy(KEY).orderBy("i")
    n = F.count("*").over(Window.partitionBy(KEY))
    both = F.struct("i", *[F.col(s).cast("double").alias(s) for s in signals], *[F.col(s).cast("double").alias(s) for s in flags])
    beside = [F.lead(both, d).over(w) for d in range(-reach, reach + 1) if d]
    near = rows.withColumns({"__n": n, "__near": F.array_compact(F.array(both, *beside)), "__own": both}).where(target_cells(F.col("i"), F.col("__n"), most))
    # at the ends nothing is looked for
    inner = F.filter("__near", lambda x: (x["i"] > 0) & (x["i"] < F.col("__n") - 1))
    inside = (F.col("__n") > most) & (F.col("i") > 0) & (F.col("i") < F.col("__n") - 1)
    pick = lambda s, x: F.struct(F.lit(s).alias("signal"), x["i"].alias("i"), x[s].alias("value"))

    def picks(s: str) -> list[Column]:
        own = F.col("__own")
        high = F.array_max(F.transform(inner, lambda x: F.struct(x[s].alias(s), (-x["i"]).alias("minus"))))
        low = F.array_min(F.transform(inner, lambda x: F.struct(x[s].alias(s), x["i"].alias("i"))))
        far = lambda x: inside & (F.abs(x[s] - own[s]) > share * F.abs(own[s]))
        top = F.struct(F.lit(s).alias("signal"), (-high["minus"]).alias("i"), high[s].alias("value"))
        return [pick(s, own), F.when(far(high), top), F.when(far(low), pick(s, low))]

    each = F.array_compact(F.array(*[x for s in signals for x in picks(s)], *[pick(s, F.col("__own")) for s in flags]))
    kept = near.select(KEY, F.inline(each)).groupBy(KEY, "signal", "i").agg(F.first("value").alias("value"))
    place = F.row_number().over(Window.partitionBy(KEY, "signal").orderBy("i"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select(KEY, "signal", "place", "i", "value")


def page(found: DataFrame, number: int, size: int, reference: str) -> DataFrame:
    """(activity_id, signal, page, pages, points, indexes, data, status) of one page, from 1, of what points() gives.

    The reference signal's count of points makes the pages. A page that an activity doesn't have gives a row with the
    status invalid_page, without data, for each of its signals; data and indexes are arrays in order, `size` long at most.
    """
    if size < 1:
        raise ValueError("pages need a size")
    counts = F.max(F.when(F.col("signal") == reference, F.col("place"))).over(Window.partitionBy(KEY))
    rows = found.withColumn("pages", F.ceil(counts / size).cast("int"))
    here = F.when((F.col("place") > (number - 1) * size) & (F.col("place") <= number * size), F.struct("place", "i", "value"))
    per = rows.groupBy(KEY, "signal").agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list(here)).alias("p"))
    fine = F.lit(number).between(F.lit(1), F.col("pages"))
    shown = F.when(fine, F.col("p")).otherwise(F.slice("p", 1, 0))
    return per.select(
        KEY, "signal", F.lit(number).alias("page"), "pages", F.size(shown).alias("points"), F.transform(shown, lambda x: x["i"]).alias("indexes"), F.transform(shown, lambda x: x["value"]).alias("data"),
        F.when(fine, "ok").otherwise("invalid_page").alias("status"),
    )


def spoken(samples: DataFrame) -> DataFrame:
    """(activity_id, sample_idx, ...) with each signal that is there in its spoken form: clock time, kilometres (2 decimals),
    km/h (1), degrees (6) and grade (1); power, heart rate, cadence, temperature and the moving flag as they are."""
    forms = {
        "t": {"seconds_from_start": F.col("t"), "clock": time_of_day(F.col("t"))},
        "distance": {"metres": F.col("distance"), "kilometres": rnd(km(F.col("distance")), 2)},
        "velocity_smooth": {"metres_per_second": F.col("velocity_smooth"), "kmh": rnd(kmh(F.col("velocity_smooth")), 1)},
        "lat": {"latitude": rnd(F.col("lat"), 6)},
        "lng": {"longitude": rnd(F.col("lng"), 6)},
        "grade": {"grade": rnd(F.col("grade"), 1)},
    }
    plain = [c for c in ("watts", "heartrate", "cadence", "temp", "altitude", "moving") if c in samples.columns]
    return samples.select(KEY, "sample_idx", *[c.alias(n) for s, each in forms.items() if s in samples.columns for n, c in each.items()], *plain)
