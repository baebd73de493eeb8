"""Time in bands: zones, cadence bins with torque, work above a threshold and its efforts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, along, upto
from cadenza.functions.scalars import micro, rnd
from cadenza.operators.power import with_signal

Band = tuple[str, float, float | None]
#: Power zones as shares of FTP, heart-rate zones as shares of the maximum, work ranges of FTP.
POWER_ZONES: tuple[Band, ...] = (("Z1", 0.0, 0.55), ("Z2", 0.55, 0.75), ("Z3", 0.75, 0.90), ("Z4", 0.90, 1.05), ("Z5", 1.05, 1.20), ("Z6", 1.20, 1.50), ("Z7", 1.50, None))
HR_ZONES: tuple[Band, ...] = (("Z1", 0.0, 0.60), ("Z2", 0.60, 0.70), ("Z3", 0.70, 0.80), ("Z4", 0.80, 0.90), ("Z5", 0.90, None))
WORK_RANGES: tuple[Band, ...] = (("100-120 %", 1.0, 1.2), ("120-150 %", 1.2, 1.5), (">150 %", 1.5, None))
GAP_TOLERANCE = 2


def absolute(zones: Sequence[Band], reference: float) -> list[Band]:
    return [(n, lo * reference, None if hi is None else hi * reference) for n, lo, hi in zones]


def lthr_zones(lthr: float, hr_max: float | None = None) -> list[Band]:
    """Five zones at whole beats; the top one closes above the maximum, if that isn't below it."""
    if lthr <= 0:
        raise ValueError("lthr must be positive")
    half_up = lambda x: math.floor(x + 0.5)
    cuts = [0, half_up(0.69 * lthr), half_up(0.84 * lthr), half_up(0.95 * lthr), half_up(1.05 * lthr) + 1]
    top = half_up(hr_max) + 1 if hr_max is not None and hr_max >= cuts[4] else None
    return [(f"Z{i + 1}", float(lo), float(hi) if hi is not None else None) for i, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], top], strict=True))]


def contiguous(zones: Sequence[Band], closed_top: bool = False) -> list[Band]:
    """The zones by lower bound; raises for a gap, an overlap, a start above 0 or a closed top not asked for."""
    zones = sorted(zones, key=lambda z: z[1])
    if not zones or zones[0][1] > 0:
        raise ValueError("zones must start at 0 or below")
    for (_, _, hi), (_, lo, _) in zip(zones, zones[1:], strict=False):
        if hi is None or abs(hi - lo) > 1e-9:
            raise ValueError("zones must meet without gaps or overlaps")
    if zones[-1][2] is not None and not closed_top:
        raise ValueError("the top zone must be open")
    return list(zones)


def band_of(value: Column, zones: Sequence[Band]) -> Column:
    """Number of the half-open band that holds value, null for none."""
    out = F.lit(None).cast("int")
    for k, (_, lo, hi) in enumerate(zones):
        fits = value >= lo if hi is None else (value >= lo) & (value < hi)
        out = F.when(fits, k).otherwise(out)
    return out


def _all_bands(df: DataFrame, zones: Sequence[Band]) -> DataFrame:
    """A row of each band for each activity of df."""
    each = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(n).alias("zone"), F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper")) for k, (n, lo, hi) in enumerate(zones)])
    return df.select("*", F.inline(each))


def time_in_zones(aligned: DataFrame, signal: str, zones: Sequence[Band], closed_top: bool = False) -> DataFrame:
    """(activity_id, zone, lower, upper, seconds, minutes, percent, work_kj, unclassified_seconds), empty zones too.

    Percentages are of classified seconds. The bands sit in the plan as a case expression, so the cells
    are aggregated once, by activity, without a join. Without the signal the figures are null, without power
    the work.
    """
    zones = contiguous(zones, closed_top)
    rows = aligned.where("valid").select(
        KEY, band_of(F.col(signal), zones).alias("band"), micro(F.col("watts")).alias("w"), with_signal(aligned, signal).alias("has"), with_signal(aligned, "watts").alias("power")
    )
    per_band = lambda k: (
        F.count_if(F.col("band") == k).alias(f"n{k}"),
        F.sum(F.when(F.col("band") == k, F.col("w")).otherwise(0)).alias(f"w{k}"),
    )
    per = rows.groupBy(KEY).agg(
        *[x for k in range(len(zones)) for x in per_band(k)],
        F.count("band").alias("classified"),
        F.count_if(F.col("band").isNull()).alias("unclassified_seconds"),
        F.max("has").alias("has"),
        F.max("power").alias("power"),
    )
    per = per.withColumns({"n": F.array(*[f"n{k}" for k in range(len(zones))]), "w": F.array(*[f"w{k}" for k in range(len(zones))])})
    seconds, work = F.get("n", F.col("band")), F.get("w", F.col("band"))
    shown = lambda x: F.when(F.col("has"), x)
    percent = F.when(F.col("classified") > 0, rnd(seconds / F.nullif("classified", F.lit(0)) * 100, 2)).otherwise(0.0)
    return _all_bands(per, zones).select(
        KEY,
        "zone",
        rnd(F.col("lower"), 4).alias("lower"),
        rnd(F.col("upper"), 4).alias("upper"),
        shown(seconds).alias("seconds"),
        shown(rnd(seconds / 60.0, 2)).alias("minutes"),
        shown(percent).alias("percent"),
        F.when(F.col("has") & F.col("power"), rnd(work / 1e6 / 1000, 2)).alias("work_kj"),
        shown(F.col("unclassified_seconds")).alias("unclassified_seconds"),
    )


def _in_bands(aligned: DataFrame, bands: Column, count: int, *columns: Column) -> DataFrame:
    """A row for each cell and band it is in, and for each activity and band one whose `cell` is false, so that none lacks."""
    marks = F.when(F.col("i") == 0, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(k.alias("band"), F.lit(False).alias("cell"))))
    hits = F.transform(bands, lambda k: F.struct(k.alias("band"), F.lit(True).alias("cell")))
    both = F.concat(hits, F.coalesce(marks, F.array().cast("array<struct<band:int,cell:boolean>>")))
    return aligned.select(KEY, "i", *columns, F.inline(both))


def torque_by_cadence(aligned: DataFrame, width: float = 10.0, most: float = 150.0) -> DataFrame:
    """A row for each cadence bin of each activity: seconds, percent, mean power, mean and most torque, work.

    Cells without cadence are excluded, the last bin is open, empty bins are there with null means. Activities without
    power or cadence have null figures. The cells are read once.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    bins = math.ceil(most / width)
    has = with_signal(aligned, "watts") & with_signal(aligned, "cadence")
    used = F.col("valid") & (F.col("cadence") > 0) & has
    band = F.least(F.floor(F.col("cadence") / width), F.lit(bins - 1)).cast("int")
    none = F.array().cast("array<int>")
    out_ = F.sum(F.when(F.col("valid") & ~used, 1).otherwise(0)).over(Window.partitionBy(KEY))
    rows = aligned.withColumns({"out": out_, "torque": F.when(used, F.col("watts") / (2 * math.pi * F.col("cadence") / 60)), "has": has})
    rows = _in_bands(rows, F.when(used, F.array(band)).otherwise(none), bins, micro(F.col("watts")).alias("w"), "torque", "out", "has")
    cell = lambda x: F.when(F.col("cell"), x)
    per = rows.groupBy(KEY, "band").agg(
        F.count_if("cell").alias("seconds"),
        F.sum(cell(F.col("w"))).alias("w"),
        F.sum(cell(micro(F.col("torque")))).alias("t"),
        F.max(cell(F.col("torque"))).alias("top"),
        F.max("out").alias("excluded_seconds"),
        F.max("has").alias("has"),
    )
    n, shown = F.nullif("seconds", F.lit(0)), lambda x: F.when(F.col("has"), x)
    analysed = F.sum("seconds").over(Window.partitionBy(KEY))
    return per.withColumn("analysed", analysed).select(
        KEY,
        (F.col("band") * width).alias("lower_rpm"),
        F.when(F.col("band") < bins - 1, (F.col("band") + 1) * width).alias("upper_rpm"),
        shown(F.col("seconds")).alias("seconds"),
        shown(F.coalesce(rnd(F.col("seconds") / F.nullif("analysed", F.lit(0)) * 100, 2), F.lit(0.0))).alias("percent"),
        rnd(F.col("w") / 1e6 / n, 2).alias("mean_power_w"),
        rnd(F.col("t") / 1e6 / n, 3).alias("mean_torque_nm"),
        rnd(F.col("top"), 3).alias("max_torque_nm"),
        shown(F.coalesce(rnd(F.col("w") / 1e6 / 1000, 3), F.lit(0.0))).alias("work_kj"),
        shown(F.col("excluded_seconds")).alias("excluded_seconds"),
    )


def _efforts(aligned: DataFrame, ftp: float, ranges: Sequence[Band], tolerance: int) -> DataFrame:
    """(activity_id, band, island, from_i, to_i, seconds, w, valid_seconds, has): islands of in-range cells of all ranges in
    one pass over the cells; a row without an island for each activity and range."""
    has = with_signal(aligned, "watts")
    inside = lambda lo, hi: (F.col("watts") >= lo) if hi is None else (F.col("watts") >= lo) & (F.col("watts") < hi)
    bands = F.array_compact(F.array(*[F.when(F.col("valid") & has & inside(lo, hi), F.lit(k)) for k, (_, lo, hi) in enumerate(absolute(ranges, ftp))]))
    whole, w = Window.partitionBy(KEY), Window.partitionBy(KEY, "band", "cell").orderBy("i")
    rows = aligned.withColumns({"bad": F.sum((~F.col("valid")).cast("int")).over(upto(along())), "valid_seconds": F.sum(F.col("valid").cast("int")).over(whole), "has": has})
    rows = _in_bands(rows, bands, len(ranges), micro(F.col("watts")).alias("w"), "bad", "valid_seconds", "has")
    new = (F.col("i") - F.lag("i").over(w) - 1 > tolerance) | (F.lag("bad").over(w) != F.col("bad"))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.when(F.col("cell"), F.sum("new").over(upto(w))))
    return rows.groupBy(KEY, "band", "island").agg(
        F.min("i").alias("from_i"), F.max("i").alias("to_i"), F.count_if("cell").alias("seconds"), F.sum(F.when(F.col("cell"), F.col("w")).otherwise(0)).alias("w"), F.max("valid_seconds").alias("valid_seconds"), F.max("has").alias("has")
    )


def efforts(aligned: DataFrame, ftp: float, ranges: Sequence[Band] = WORK_RANGES, tolerance: int = GAP_TOLERANCE) -> DataFrame:
    """(activity_id, range, island, from_i, to_i, seconds) of each effort: in-range seconds that at most `tolerance`
    others part; an invalid cell always parts them. Only in-range seconds count."""
    name = F.get(F.array(*[F.lit(n) for n, _, _ in ranges]), F.col("band"))
    return _efforts(aligned, ftp, ranges, tolerance).where("island is not null").select(KEY, name.alias("range"), "island", "from_i", "to_i", "seconds")


def work_above(aligned: DataFrame, ftp: float, ranges: Sequence[Band] = WORK_RANGES, tolerance: int = GAP_TOLERANCE) -> DataFrame:
    """A row for each range of each activity: seconds, percent of valid, work, work above FTP and its efforts; null
    figures without power."""
    if ftp <= 0:
        raise ValueError("ftp must be positive")
    zones = absolute(ranges, ftp)
    found = _efforts(aligned, ftp, ranges, tolerance)
    per = found.groupBy(KEY, "band").agg(
        F.sum("seconds").alias("n"),
        F.sum("w").alias("w"),
        F.count("island").alias("effort_count"),
        F.max(F.when(F.col("island").isNotNull(), F.col("seconds"))).alias("max_effort_s"),
        F.max("valid_seconds").alias("valid_seconds"),
        F.max("has").alias("has"),
    )
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("band"))
    shown = lambda x: F.when(F.col("has"), x)
    return per.select(
        KEY,
        of([z[0] for z in zones]).alias("range"),
        rnd(of([z[1] for z in zones]), 2).alias("lower_w"),
        rnd(of([z[2] for z in zones]).cast("double"), 2).alias("upper_w"),
        shown(F.col("n")).alias("seconds"),
        shown(rnd(F.col("n") / F.nullif("valid_seconds", F.lit(0)) * 100, 2)).alias("percent"),
        shown(rnd(F.col("w") / 1e6 / 1000, 3)).alias("work_kj"),
        shown(rnd((F.col("w") / 1e6 - F.col("n") * ftp) / 1000, 3)).alias("work_above_kj"),
        shown(F.col("effort_count")).alias("effort_count"),
        rnd(F.col("n") / F.nullif("effort_count", F.lit(0)), 2).alias("mean_effort_s"),
        "max_effort_s",
    )
