"""Aerobic decoupling: efficiency of the first and second half of a filtered series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, along, upto
from cadenza.functions.scalars import micro, rnd
from cadenza.operators.power import with_signal

MIN_SECONDS = 600


def decoupling(aligned: DataFrame, warmup_min: float = 0.0, low_w: float | None = None, high_w: float | None = None, moving_only: bool = False, min_seconds: int = MIN_SECONDS) -> DataFrame:
    """A row for each activity: valid_seconds, excluded_seconds, first_ef, second_ef, decoupling_pct, available.

    Filters come first; the halves are halves of what is left by count, not by time. A series without power or heart
    rate has nothing left.
    """
    keep = (F.col("i") >= int(warmup_min * 60 + 0.5)) & (F.col("heartrate") > 0) & with_signal(aligned, "watts") & with_signal(aligned, "heartrate")
    if low_w is not None:
        keep &= F.col("watts") >= low_w
    if high_w is not None:
        keep &= F.col("watts") <= high_w
    if moving_only and "moving" in aligned.columns:
        keep &= F.coalesce("moving", F.lit(True))
    rows = halved(aligned.where("valid"), keep)
    per = rows.groupBy(KEY).agg(F.count_if("keep").alias("n"), F.count_if(~F.col("keep")).alias("excluded"), *[c.alias(n) for n, c in half_sums().items()])
    per = per.withColumn("available", F.col("n") >= max(2, min_seconds))
    shown = lambda c: F.when(F.col("available"), c)
    return per.select(
        KEY, "available", F.when(F.col("n") >= 2, F.col("n")).otherwise(0).alias("valid_seconds"), F.when(F.col("n") >= 2, F.col("excluded")).otherwise(0).alias("excluded_seconds"),
        *[shown(c).alias(n) for n, c in half_figures().items()],
    )


def halved(rows: DataFrame, keep: Column) -> DataFrame:
    """rows with `keep`, and `half`: 1 or 2 for the first and second half, by count, of what each activity keeps."""
    rows = rows.withColumn("keep", F.coalesce(keep, F.lit(False)))
    kept = F.col("keep").cast("int")
    n, at = F.sum(kept).over(Window.partitionBy(KEY)), F.sum(kept).over(upto(along()))
    return rows.withColumn("half", F.when(F.col("keep"), F.when(at <= F.floor(n / 2), 1).otherwise(2)))


def half_sums() -> dict[str, Column]:
    """What half_figures() needs of the cells of halved()."""
    sums = {f"{c[0]}{k}": F.sum(F.when(F.col("half") == k, micro(F.col(c)))) for k in (1, 2) for c in ("watts", "heartrate")}
    return sums | {f"n{k}": F.count_if(F.col("half") == k) for k in (1, 2)}


def half_figures() -> dict[str, Column]:
    n1, n2 = (F.nullif(f"n{k}", F.lit(0)) for k in (1, 2))
    ef1 = (F.col("w1") / 1e6 / n1) / (F.col("h1") / 1e6 / n1)
    ef2 = (F.col("w2") / 1e6 / n2) / (F.col("h2") / 1e6 / n2)
    return {"first_ef": rnd(ef1, 6), "second_ef": rnd(ef2, 6), "decoupling_pct": rnd((ef1 - ef2) / F.nullif(ef1, F.lit(0.0)) * 100, 4)}
