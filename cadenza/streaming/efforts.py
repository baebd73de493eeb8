"""Efforts of a live stream of samples: the streaming twin of bands.efforts()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import micro, rnd
from cadenza.operators.bands import GAP_TOLERANCE, WORK_RANGES, Band, absolute


def effort_sessions(samples: DataFrame, ftp: float, ranges: Sequence[Band] = WORK_RANGES, tolerance: int = GAP_TOLERANCE, lateness: str = "10 seconds") -> DataFrame:
    """(activity_id, range, began, ended, seconds, mean_w) of each effort in a stream of (activity_id, at timestamp, watts).

    Samples of a range at most `tolerance` seconds apart make a session of it; one is final, and its state dropped, once the
    watermark passes its end. Samples later than `lateness` are left out. Repeated samples of a second count once each.
    """
    hit = lambda lo, hi: (F.col("watts") >= lo) if hi is None else (F.col("watts") >= lo) & (F.col("watts") < hi)
    names = F.array_compact(F.array(*[F.when(hit(lo, hi), F.lit(name)) for name, lo, hi in absolute(ranges, ftp)]))
    rows = samples.withWatermark("at", lateness).select(KEY, "at", micro(F.col("watts")).alias("w"), F.explode(names).alias("range"))
    per = rows.groupBy(F.session_window("at", f"{tolerance + 1} seconds").alias("span"), KEY, "range").agg(F.count("*").alias("seconds"), F.sum("w").alias("w"))
    ended = F.col("span.end") - F.make_interval(secs=F.lit(tolerance + 1))
    return per.select(KEY, "range", F.col("span.start").alias("began"), ended.alias("ended"), "seconds", rnd(F.col("w") / 1e6 / F.col("seconds"), 2).alias("mean_w"))
