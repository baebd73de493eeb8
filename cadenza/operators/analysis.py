"""Analyses of whole activities: best efforts of a period, comparison, and all metrics side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import micro, rnd
from cadenza.operators import align, bands, climbs, decoupling, power, records

#: The metrics that a comparison shows, and the parameter that one needs besides its signal.
CELLS = (
    ("valid_seconds", None, None),
    ("avg_w", "watts", None),
    ("np_w", "watts", None),
    ("vi", "watts", None),
    ("intensity", "watts", "ftp_w"),
    ("tss", "watts", "ftp_w"),
    ("work_kj", "watts", None),
    ("avg_wkg", "watts", "weight_kg"),
    ("mean_hr", "heartrate", None),
    ("max_hr", "heartrate", None),
    ("mean_cadence", "cadence", None),
)


def skip_reason(signal: str = "watts") -> Column:
    """Why a listed activity can't take part, null if it can: only measured power counts, for other signals anything."""
    if signal != "watts":
        return F.lit(None).cast("string")
    return F.when(F.col("device_watts").isNull(), "power_source_unknown").when(~F.col("device_watts"), "power_estimated")


def best_efforts(
    samples: DataFrame, listed: DataFrame, durations: Sequence[int], signal: str = "watts"
) -> tuple[DataFrame, DataFrame]:
    """The best mean over each duration among the listed activities, the earliest listed of equals, and what became of each.

    listed has (activity_id, day, device_watts, pos), see records.listed(); its series alone are aligned. The second
    table is listed with `status`: used, why it was skipped, or no_data if it gives no window of any duration.
    """
    judged = listed.withColumn("reason", skip_reason(signal))
    usable = judged.where("reason is null")
    curves = power.curve(align.align(samples.join(usable.select(KEY), KEY, "left_semi"), (signal,)), durations, signal).where("best is not null")
    ranked = records.leaderboard(curves.join(usable.select(KEY, "day", "pos"), KEY), ["duration_s"], F.desc("best"), 1, "pos")
    some = curves.select(KEY).distinct().withColumn("some", F.lit(True))
    status = F.coalesce("reason", F.when(F.col("some"), "used"), F.lit("no_data"))
    return ranked.select("duration_s", KEY, "day", "best", "start_s", "end_s"), judged.join(some, KEY, "left").select(*listed.columns, status.alias("status"))


def compare(aligned: DataFrame) -> DataFrame:
    """(activity_id, metric, value, status): eleven cells for each activity, from one aggregation of its cells.

    aligned has the cells of the activities with `ftp_w` and `weight_kg` as of their days (null: none then). A cell that
    lacks its signal or parameter is null, with the status no_<signal> or no_<parameter>, else its status is ok.
    """
    signals = ("watts", "heartrate", "cadence")
    sums = power.power_sums(power.with_signal(aligned, "watts")) | _beats(aligned) | _turns(aligned)
    sums |= {c: F.max(c) for c in ("ftp_w", "weight_kg")} | {f"has_{s}": F.max(power.with_signal(aligned, s)) for s in signals}
    per = power.with_fourth(aligned).groupBy(KEY).agg(*[c.alias(n) for n, c in sums.items()])
    found = power.power_figures(F.col("ftp_w"), F.col("weight_kg")) | _beat_figures() | _turn_figures() | {"valid_seconds": F.col("valid_seconds")}

    def cell(metric: str, signal: str | None, parameter: str | None) -> Column:
        status = F.lit(None).cast("string")
        if parameter:
            status = F.when(F.col(parameter).isNull(), f"no_{parameter}")
        if signal:
            status = F.when(~F.col(f"has_{signal}"), f"no_{signal}").otherwise(status)
        return F.struct(F.lit(metric).alias("metric"), found[metric].cast("double").alias("value"), F.coalesce(status, F.lit("ok")).alias("status"))

    return per.select(KEY, F.inline(F.array(*[cell(*c) for c in CELLS])))


#: How many different activities a comparison takes.
LEAST_COMPARED, MOST_COMPARED = 2, 10


def comparisons(asked: DataFrame, activities: DataFrame) -> DataFrame:
    """(comparison, athlete_id, asked, usable, rejected, code, ids) of each comparison in asked (comparison, athlete_id, activity_id).

    Repeated ids count once. An activity is usable if it is there and belongs to the athlete who asks. A comparison of fewer
    than two or more than ten different activities has the code INVALID_REQUEST, one with fewer than two usable ones
    INSUFFICIENT_DURATION, both without ids; else code is null and ids are the usable ones, sorted. Null ids are left out.
    """
    own = activities.select(KEY, F.col("athlete_id").alias("__owner"))
    rows = asked.where(F.col(KEY).isNotNull()).select("comparison", "athlete_id", KEY).distinct().join(own, KEY, "left")
    usable = F.col("__owner").eqNullSafe(F.col("athlete_id")) & F.col("__owner").isNotNull()
    per = rows.groupBy("comparison", "athlete_id").agg(F.count("*").alias("asked"), F.count_if(usable).alias("usable"), F.array_sort(F.collect_set(F.when(usable, F.col(KEY)))).alias("ids"))
    code = F.when(~F.col("asked").between(LEAST_COMPARED, MOST_COMPARED), "INVALID_REQUEST").when(F.col("usable") < LEAST_COMPARED, "INSUFFICIENT_DURATION")
    ids = F.when(code.isNull(), F.col("ids")).otherwise(F.array().cast("array<string>"))
    return per.select("comparison", "athlete_id", "asked", "usable", (F.col("asked") - F.col("usable")).alias("rejected"), code.alias("code"), ids.alias("ids"))


def _beats(aligned: DataFrame) -> dict[str, Column]:
    beats = F.when(F.col("valid") & power.with_signal(aligned, "heartrate"), F.col("heartrate"))
    return {"hr_n": F.count(beats), "hr_s": F.sum(micro(beats)), "hr_max": F.max(beats), "hr_min": F.min(beats)}


def _beat_figures() -> dict[str, Column]:
    return {"mean_hr": rnd(F.col("hr_s") / 1e6 / F.nullif("hr_n", F.lit(0)), 2), "max_hr": rnd(F.col("hr_max"), 2), "min_hr": rnd(F.col("hr_min"), 2)}


def _turns(aligned: DataFrame) -> dict[str, Column]:
    turns = F.when(F.col("valid") & power.with_signal(aligned, "cadence") & (F.col("cadence") > 0), F.col("cadence"))
    return {"cd_n": F.count(turns), "cd_s": F.sum(micro(turns)), "cd_max": F.max(turns)}


def _turn_figures() -> dict[str, Column]:
    return {"mean_cadence": rnd(F.col("cd_s") / 1e6 / F.nullif("cd_n", F.lit(0)), 2), "max_cadence": rnd(F.col("cd_max"), 2)}


def rejected(asked: DataFrame, activities: DataFrame, athlete: Column) -> DataFrame:
    """(activity_id, reason) of asked ids that can't be compared: not_found, or other_athlete."""
    rows = asked.select(KEY).distinct().join(activities.select(KEY, "athlete_id"), KEY, "left")
    reason = F.when(F.col("athlete_id").isNull(), "not_found").when(F.col("athlete_id") != athlete, "other_athlete")
    return rows.select(KEY, reason.alias("reason")).where("reason is not null")


#: The codes of what a module or an analysis lacks.
CODES = ("MISSING_POWER", "MISSING_HR", "MISSING_FTP", "MISSING_WEIGHT", "INSUFFICIENT_DURATION", "LOW_COVERAGE", "INVALID_PROFILE", "MISSING_ELEVATION", "MISSING_HR_THRESHOLD")
#: The modules of a whole analysis.
MODULES = ("activity_details", "power_metrics", "heartrate_summary", "cadence_summary", "power_zones", "heartrate_zones", "decoupling", "climbs")


def whole(cells: DataFrame, min_seconds: int = decoupling.MIN_SECONDS) -> DataFrame:
    """(activity_id, modules..., modules_available, errors): a struct for each of MODULES with `available`, `code` and its figures.

    cells are those of align.align() with ftp_w, weight_kg, hr_max_bpm as of the activity's day and device_watts, the same in
    all cells of an activity (nulls: unknown). A module that lacks something has `available` false, null figures and one of
    CODES, what the activity lacks before what the profile lacks; cadence has no code of its own. Zones lie at shares of
    the threshold power and the highest heart rate, a profile without the latter is INVALID_PROFILE to the heart-rate zones.
    errors lists what the profile lacks, and LOW_COVERAGE below 80 percent of valid cells.

    Modules add columns to the cells and name aggregates: all are windows of the same activity, then a row for each climb and
    one for the rest, then one for each activity, so the cells are shuffled once and read once.
    """
    has = {s: power.with_signal(cells, s) for s in ("watts", "heartrate", "cadence", "altitude", "distance")}
    both = has["watts"] & has["heartrate"]
    rows = decoupling.halved(power.with_fourth(cells), F.col("valid") & (F.col("heartrate") > 0) & both)
    rows = climbs.with_sustained(climbs.marked(rows))
    share = lambda zones, to: [(n, F.lit(lo) * F.col(to), None if hi is None else F.lit(hi) * F.col(to)) for n, lo, hi in zones]
    zones = {
        "p": ("watts", share(bands.POWER_ZONES, "ftp_w")),
        "h": ("heartrate", share(bands.HR_ZONES, "hr_max_bpm")),
    }
    added = {"cells": F.count("*"), "total": F.sum(F.when(F.col("valid") & has["watts"], micro(F.col("watts")))), "f4": F.sum("__fourth"), "nw": F.count("__fourth"), "valid_seconds": F.count_if("valid")}
    added |= {k: v for k, v in (_beats(cells) | _turns(cells)).items() if k[3:] in ("n", "s")} | decoupling.half_sums()
    for mark, (signal, each) in zones.items():
        band = bands.band_of(F.col(signal), each)
        added |= {f"{mark}z{k}": F.count_if(F.col("valid") & has[signal] & (band == k)) for k in range(len(each))}
    topped = {c: F.max(c) for c in ("ftp_w", "weight_kg", "hr_max_bpm", "device_watts")} | {f"has_{s}": F.max(x) for s, x in has.items()}
    topped |= {k: v for k, v in (_beats(cells) | _turns(cells)).items() if k[3:] == "max"} | {"hr_min": _beats(cells)["hr_min"]}
    per_climb = rows.groupBy(KEY, "climb", "from_i", "to_i").agg(*[c.alias(n) for n, c in (added | topped | climbs.climb_sums(cells)).items()])

    figures = climbs.figures(F.col("weight_kg"), F.col("device_watts"))
    found = F.when(climbs.is_climb(), F.struct("from_i", "to_i", *[c.alias(n) for n, c in figures.items()]))
    merged = [F.sum(n).alias(n) for n in added] + [(F.min(n) if n == "hr_min" else F.max(n)).alias(n) for n in topped]
    per = per_climb.withColumn("found", found).groupBy(KEY).agg(*merged, F.array_sort(F.collect_list("found")).alias("found"))
    per = per.withColumns({"fourth": F.col("f4") / F.nullif("nw", F.lit(0)), "np_windows": F.col("nw"), "kept": F.col("n1") + F.col("n2")})

    lacks = lambda *pairs: reduce(lambda c, p: c.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    no_power, no_hr = (~F.col("has_watts"), "MISSING_POWER"), (F.col("hr_n") == 0, "MISSING_HR")
    tenths = F.aggregate("found", F.lit(0).cast("bigint"), lambda a, c: a + F.floor(c["gain_m"] * 10 + 0.5).cast("bigint"))
    coverage = rnd(F.col("valid_seconds") / F.col("cells") * 100, 1)
    power_figures = power.power_figures(F.col("ftp_w"), F.col("weight_kg"))
    lacking = F.array_compact(F.array(F.when(F.col("ftp_w").isNull(), "intensity"), F.when(F.col("ftp_w").isNull(), "tss"), F.when(F.col("weight_kg").isNull(), "avg_wkg")))

    def zone_figures(mark: str) -> dict[str, Column]:
        seconds = [F.col(f"{mark}z{k}") for k in range(len(zones[mark][1]))]
        all_ = reduce(lambda a, b: a + b, seconds)
        return {"seconds": F.array(*seconds), "percent": F.array(*[F.when(all_ > 0, rnd(x / F.nullif(all_, F.lit(0)) * 100, 2)).otherwise(0.0) for x in seconds]), "unclassified_seconds": F.col("valid_seconds") - all_}

    modules = {
        "activity_details": (F.lit(None).cast("string"), F.lit(True), {"cells": F.col("cells"), "valid_seconds": F.col("valid_seconds"), "coverage_pct": coverage, "power_source": align.power_source(F.col("has_watts"), F.col("device_watts"))}),
        "power_metrics": (lacks(no_power), None, power_figures | {"np_windows": F.col("np_windows"), "unavailable_metrics": lacking}),
        "heartrate_summary": (lacks(no_hr), None, {"seconds": F.col("hr_n")} | _beat_figures()),
        "cadence_summary": (F.lit(None).cast("string"), F.col("cd_n") > 0, {"seconds": F.col("cd_n")} | _turn_figures()),
        "power_zones": (lacks(no_power, (F.col("ftp_w").isNull(), "MISSING_FTP")), None, zone_figures("p")),
        "heartrate_zones": (lacks(no_hr, (F.col("hr_max_bpm").isNull(), "INVALID_PROFILE")), None, zone_figures("h")),
        "decoupling": (lacks(no_power, no_hr, (F.col("kept") < max(2, min_seconds), "INSUFFICIENT_DURATION")), None, {"valid_seconds": F.col("kept")} | decoupling.half_figures()),
        "climbs": (lacks((~(F.col("has_altitude") & F.col("has_distance")), "MISSING_ELEVATION")), None, {"climb_count": F.size("found").cast("bigint"), "total_gain_m": rnd(tenths / 10.0, 1), "climbs": F.col("found")}),
    }
    out, ready = [], []
    for name, (code, available, shown) in modules.items():
        available = code.isNull() if available is None else available
        ready.append(available.cast("int"))
        out.append(F.struct(available.alias("available"), code.alias("code"), *[F.when(available, c).alias(n) for n, c in shown.items()]).alias(name))
    errors = F.array_compact(F.array(F.when(F.col("ftp_w").isNull(), "MISSING_FTP"), F.when(F.col("weight_kg").isNull(), "MISSING_WEIGHT"), F.when(coverage < align.MIN_COVERAGE, "LOW_COVERAGE")))
    return per.select(KEY, *out, reduce(lambda a, b: a + b, ready).alias("modules_available"), errors.alias("errors"))


def analysis(aligned: DataFrame, ftp: float, weight: float, power_zones: Sequence[bands.Band], hr_zones: Sequence[bands.Band]) -> dict[str, DataFrame]:
    """All modules over the same cells, a frame each, with nulls where an activity lacks its signals: quality, power, curve, power
    and heart-rate zones, torque, work above threshold, decoupling and climbs. Pass cells that are stored, as each module reads
    them; whole() gives one row an activity in one pass."""
    return {
        "quality": align.quality(aligned),
        "power": power.power_metrics(aligned, F.lit(ftp), F.lit(weight)),
        "curve": power.curve(aligned),
        "power_zones": bands.time_in_zones(aligned, "watts", power_zones),
        "hr_zones": bands.time_in_zones(aligned, "heartrate", hr_zones, closed_top=True),
        "torque": bands.torque_by_cadence(aligned),
        "work": bands.work_above(aligned, ftp),
        "decoupling": decoupling.decoupling(aligned),
        "climbs": climbs.climbs(aligned, F.lit(weight)),
    }
