"""Power metrics, signal summaries and best-effort curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, prefixes, trailing_sum
from cadenza.functions.scalars import micro, rnd

NP_WINDOW = 30
#: The durations of a power curve, in seconds.
DURATIONS = (1, 5, 10, 15, 30, 60, 120, 180, 300, 480, 600, 720, 1200, 1800, 2400, 3600, 5400)


def normalized(mean_fourth: Column) -> Column:
    return F.pow(mean_fourth, F.lit(0.25))


def with_signal(aligned: DataFrame, signal: str) -> Column:
    """Whether the cell's series has the signal; True where alignment didn't say."""
    return F.col(f"has_{signal}") if f"has_{signal}" in aligned.columns else F.lit(True)


def with_fourth(aligned: DataFrame) -> DataFrame:
    """aligned with `__fourth`: the fourth power of the mean over the last NP_WINDOW cells, null without a whole window or power."""
    mean = trailing_sum(NP_WINDOW) / float(NP_WINDOW) / 1e6
    rows = prefixes(aligned, "watts").withColumn("__fourth", F.when(with_signal(aligned, "watts"), F.pow(mean, F.lit(4.0))))
    return rows.drop("s", "ok")


def power_sums(has: Column) -> dict[str, Column]:
    """What power_figures() needs of the cells of with_fourth()."""
    return {
        "valid_seconds": F.count_if("valid"),
        "total": F.sum(F.when(F.col("valid") & has, micro(F.col("watts")))),
        "fourth": F.avg("__fourth"),
        "np_windows": F.count("__fourth"),
    }


def power_figures(ftp: Column, kg: Column) -> dict[str, Column]:
    """The metrics from power_sums(); a null parameter leaves what depends on it null."""
    n, avg, np_ = F.col("valid_seconds"), F.col("total") / 1e6 / F.nullif("valid_seconds", F.lit(0)), normalized(F.col("fourth"))
    ratio = np_ / F.nullif(ftp, F.lit(0.0))
    return {
        "avg_w": rnd(avg, 2),
        "np_w": rnd(np_, 2),
        "vi": rnd(np_ / F.nullif(avg, F.lit(0.0)), 4),
        "intensity": rnd(ratio, 4),
        "tss": rnd(n * np_ * ratio / (F.nullif(ftp, F.lit(0.0)) * 3600) * 100, 2),
        "work_kj": rnd(F.col("total") / 1e6 / 1000, 2),
        "avg_wkg": rnd(avg / F.nullif(kg, F.lit(0.0)), 3),
    }


def power_metrics(aligned: DataFrame, ftp: Column, weight: Column, by: Sequence[str] = (KEY,)) -> DataFrame:
    """valid_seconds, avg_w, np_w, vi, if, tss, work_kj, avg_wkg, np_windows for each activity (or `by`).

    ftp and weight are literals or columns of aligned that are constant for each group; null leaves what
    depends on them null. The normalised power takes complete, wholly valid trailing windows only. Without
    power all but valid_seconds is null, and there are no windows.
    """
    rows = with_fourth(aligned.withColumns({"__ftp": ftp, "__kg": weight}))
    sums = power_sums(with_signal(aligned, "watts")) | {"__ftp": F.max("__ftp"), "__kg": F.max("__kg")}
    per = rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    return per.select(*by, "valid_seconds", *[c.alias(n) for n, c in power_figures(F.col("__ftp"), F.col("__kg")).items()], "np_windows")


def curve(aligned: DataFrame, durations: Sequence[int] = DURATIONS, signal: str = "watts", by: Sequence[str] = (KEY,)) -> DataFrame:
    """(by, duration_s, best, best_raw, start_s, end_s): the best mean over each duration, the earliest of equals.

    All durations come from one prefix sum and one aggregation; a duration without a wholly valid window
    has null values, and so has a series without the signal.
    """
    wanted = sorted({int(d) for d in durations})
    has = with_signal(aligned, signal)
    rows = prefixes(aligned, signal).withColumns({f"__{d}": F.when(has, trailing_sum(d)) for d in wanted})
    best = [F.max(F.when(F.col(f"__{d}").isNotNull(), F.struct(F.col(f"__{d}").alias("s"), (-F.col("i")).alias("minus")))).alias(f"__{d}") for d in wanted]
    per = rows.groupBy(*by).agg(F.max("offset").alias("offset"), *best)
    each = F.array(*[F.struct(F.lit(d).alias("duration_s"), F.col(f"__{d}").alias("b")) for d in wanted])
    per = per.select(*by, "offset", F.inline(each))
    end = -F.col("b.minus") + F.col("offset")
    mean = F.col("b.s") / F.col("duration_s") / 1e6
    return per.select(*by, "duration_s", rnd(mean, 2).alias("best"), mean.alias("best_raw"), (end - F.col("duration_s") + 1).alias("start_s"), end.alias("end_s"))


def signal_summary(aligned: DataFrame, signals: Sequence[tuple[str, bool]] = (("heartrate", True), ("cadence", False))) -> DataFrame:
    """(activity_id, signal, seconds, mean, max, min) over valid cells; False leaves values of 0 or less out. An absent
    signal has 0 seconds and nulls."""
    used = lambda s, zeros: F.col("valid") & with_signal(aligned, s) & (F.lit(zeros) | (F.col(s) > 0))
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.when(used(s, zeros), F.col(s)).alias("v")) for s, zeros in signals])
    rows = aligned.select(KEY, F.inline(cells))
    per = rows.groupBy(KEY, "signal").agg(F.count("v").alias("seconds"), F.sum(micro(F.col("v"))).alias("s"), F.max("v").alias("top"), F.min("v").alias("low"))
    return per.select(KEY, "signal", "seconds", rnd(F.col("s") / 1e6 / F.nullif("seconds", F.lit(0)), 2).alias("mean"), rnd(F.col("top"), 2).alias("max"), rnd(F.col("low"), 2).alias("min"))
