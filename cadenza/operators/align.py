"""Alignment of irregular samples to a grid of whole steps, with validity, gaps and fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, along, upto
from cadenza.functions.scalars import finite, rnd

SIGNALS = ("watts", "heartrate", "cadence", "altitude", "distance")
#: Longest gap that is filled, and longest series that is aligned unless the caller says otherwise, in steps.
GAP_FILL, MOST_CELLS = 3, 86_400
MIN_COVERAGE = 80.0


def cleaned(samples: DataFrame, most: int | None = MOST_CELLS) -> DataFrame:
    """Samples (activity_id, sample_idx, t, ...) whose rounded time passes all before it, with `first` and `last`.

    Series that would take more than `most` cells are left out; availability() lists them with a status. None takes all.
    """
    t = F.floor(finite(F.col("t").cast("double")) + 0.5).cast("bigint")
    rows = samples.withColumn("t", t).where("t is not null")
    before = F.max("t").over(along("sample_idx").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before).where("__before is null or t > __before").drop("__before")
    whole = Window.partitionBy(KEY)
    rows = rows.withColumns({"first": F.min("t").over(whole), "last": F.max("t").over(whole)})
    return rows if most is None else rows.where(F.col("last") - F.col("first") < most)


def availability(samples: DataFrame, signals: Sequence[str] = SIGNALS, most: int = MOST_CELLS) -> DataFrame:
    """(activity_id, status, has_<signal>) of every series in samples: ok, too_long, or no_time if none of its samples has one."""
    t = F.floor(finite(F.col("t").cast("double")) + 0.5).cast("bigint")
    has = [F.coalesce(F.max(finite(F.col(s).cast("double")).isNotNull()), F.lit(False)).alias(f"has_{s}") for s in signals]
    per = samples.groupBy(KEY).agg((F.max(t) - F.min(t) + 1).alias("cells"), *has)
    status = F.when(F.col("cells").isNull(), "no_time").when(F.col("cells") > most, "too_long").otherwise("ok")
    return per.select(KEY, status.alias("status"), *[f"has_{s}" for s in signals])


def dropped(samples: DataFrame) -> DataFrame:
    """(activity_id, samples, dropped): samples without a usable time or whose time does not advance."""
    kept = cleaned(samples, 1 << 62).groupBy(KEY).agg(F.count("*").alias("kept"))
    all_ = samples.groupBy(KEY).agg(F.count("*").alias("samples"))
    return all_.join(kept, KEY, "left").select(KEY, "samples", (F.col("samples") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def gaps(clean: DataFrame, gap_fill: int = GAP_FILL) -> DataFrame:
    """(activity_id, from_s, to_s, duration_s, filled) of cleaned samples: the missing cells between neighbours."""
    nxt = F.lead("t").over(along("t"))
    rows = clean.withColumn("next", nxt).where("next - t > 1")
    size = F.col("next") - F.col("t") - 1
    return rows.select(
        KEY,
        (F.col("t") - F.col("first") + 1).alias("from_s"),
        (F.col("next") - F.col("first") - 1).alias("to_s"),
        size.alias("duration_s"),
        (size <= gap_fill).alias("filled"),
    )


def align(samples: DataFrame, signals: Sequence[str] = SIGNALS, gap_fill: int = GAP_FILL, moving: bool = False, most: int | None = MOST_CELLS) -> DataFrame:
    """(activity_id, i, offset, valid, gap, signals..., known_<signal>, has_<signal>, moving): one row for each grid cell.

    A cell between samples is valid if the gap it lies in is no longer than gap_fill, whatever the signals.
    A signal runs straight between two values at most gap_fill cells apart, else its last value is carried;
    ends are carried outwards, a signal without any value is 0. `known_` says that a cell has a value of its
    own, `has_` that the series has one anywhere: metrics of a signal that it lacks are null. `gap` is the count of
    cells missing after a sample. `moving` is carried forward, its leading cells take the first value. Series of more than
    `most` cells are left out, see cleaned().

    Neighbouring values are looked up among the samples, before cells are made of them: the only shuffle
    is by activity, and windows run over samples, not cells.
    """
    clean = cleaned(samples.select(KEY, "sample_idx", "t", *signals, *(["moving"] if moving else [])), most)
    up, down = along("t"), along(F.desc("t"))
    at_or_before, after = upto(up), down.rowsBetween(Window.unboundedPreceding, -1)
    found: dict[str, Column] = {}
    for s in signals:
        value = finite(F.col(s).cast("double"))
        anchor = F.when(value.isNotNull(), F.struct(F.col("t").alias("t"), value.alias("v")))
        found[f"p_{s}"] = F.last(anchor, ignorenulls=True).over(at_or_before)
        found[f"q_{s}"] = F.last(anchor, ignorenulls=True).over(after)
        found[f"has_{s}"] = F.max(value.isNotNull()).over(Window.partitionBy(KEY))
    if moving:
        found["p_moving"] = F.last("moving", ignorenulls=True).over(at_or_before)
        found["q_moving"] = F.last("moving", ignorenulls=True).over(after)
    rows = clean.withColumns(found | {"next": F.lead("t").over(up)})
    cells = rows.withColumn("c", F.explode(F.sequence("t", F.coalesce(F.col("next") - 1, F.col("t")))))
    out = [
        F.col(KEY),
        (F.col("c") - F.col("first")).alias("i"),
        F.col("first").alias("offset"),
        ((F.col("c") == F.col("t")) | (F.col("next") - F.col("t") - 1 <= gap_fill)).alias("valid"),
        F.when(F.col("c") == F.col("t"), F.col("next") - F.col("t") - 1).alias("gap"),
    ]
    for s in signals:
        p, q = F.col(f"p_{s}"), F.col(f"q_{s}")
        straight = p["v"] + (q["v"] - p["v"]) * (F.col("c") - p["t"]) / (q["t"] - p["t"])
        value = F.when(p.isNull(), q["v"]).when(q.isNull() | (F.col("c") == p["t"]) | (q["t"] - p["t"] - 1 > gap_fill), p["v"]).otherwise(straight)
        out += [F.coalesce(value, F.lit(0.0)).alias(s), F.coalesce(F.col("c") == p["t"], F.lit(False)).alias(f"known_{s}"), f"has_{s}"]
    if moving:
        out.append(F.coalesce("p_moving", "q_moving").alias("moving"))
    return cells.select(*out)


#: Cells of a bin of sliced().
BIN = 256


def sliced(aligned: DataFrame, spans: DataFrame, names: Sequence[str] = ("from_i", "to_i")) -> DataFrame:
    """Cells of aligned within the spans (activity_id, *names, ...) of their activity, ends included; `i` counts
    from each span's start, `offset` moves with it. Spans beyond an end are cut off there; null or empty ones have no cells.

    Spans and cells meet by activity and bin of 256 cells, not by activity alone: a span is copied to the bins it touches, so a
    cell meets the spans near it, however many its activity has, and a long series is spread over tasks.
    """
    lo, hi = names
    first, last = F.greatest(F.col(lo), F.lit(0)), F.least(F.col(hi), F.lit(MOST_CELLS - 1))
    bins = F.sequence(F.floor(first / BIN).cast("int"), F.floor(last / BIN).cast("int"))
    near = spans.where((F.col(lo) <= F.col(hi)) & (F.col(hi) >= 0) & (F.col(lo) < MOST_CELLS)).withColumn("__bin", F.explode(bins))
    cells = aligned.withColumn("__bin", F.floor(F.col("i") / BIN).cast("int"))
    rows = cells.join(near, [KEY, "__bin"]).where(F.col("i").between(F.col(lo), F.col(hi))).drop("__bin")
    start = F.greatest(F.col(lo), F.lit(0))
    return rows.withColumns({"offset": F.col("offset") + start, "i": F.col("i") - start})


def quality(aligned: DataFrame, signals: Sequence[str] = SIGNALS, gap_fill: int = GAP_FILL) -> DataFrame:
    """One row for each activity: cells, coverage, gaps with the list of unfilled ones, each signal's own cells, warnings."""
    pct = lambda n: rnd(F.when(F.col("cells") > 0, n / F.col("cells") * 100).otherwise(0.0), 1)
    open_ = F.struct((F.col("i") + 1).alias("from_s"), (F.col("i") + F.col("gap")).alias("to_s"))
    per = aligned.groupBy(KEY).agg(
        F.count("*").alias("cells"),
        F.count_if("valid").alias("valid_cells"),
        F.count_if(F.col("gap") > 0).alias("gap_count"),
        F.coalesce(F.sum(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0)).alias("gap_seconds"),
        F.coalesce(F.max(F.when(F.col("gap") > 0, F.col("gap"))), F.lit(0)).alias("longest_gap_s"),
        F.array_sort(F.collect_list(F.when(F.col("gap") > gap_fill, open_))).alias("unfilled"),
        *[F.count_if(f"known_{s}").alias(f"own_{s}") for s in signals],
    )
    coverage = pct(F.col("valid_cells"))
    return per.select(
        KEY,
        "cells",
        "valid_cells",
        coverage.alias("coverage_pct"),
        "gap_count",
        "gap_seconds",
        "longest_gap_s",
        F.size("unfilled").cast("bigint").alias("unfilled_gaps"),
        F.array_join(F.transform("unfilled", lambda g: F.concat_ws("-", g["from_s"], g["to_s"])), ",").alias("unfilled_list"),
        *[(F.col(f"own_{s}") > 0).alias(f"{s}_available") for s in signals],
        *[F.when(F.col(f"own_{s}") > 0, F.col("cells") - F.col(f"own_{s}")).otherwise(0).alias(f"{s}_filled") for s in signals],
        (coverage < MIN_COVERAGE).alias("low_coverage"),
    )


def power_source(has_power: Column, device_watts: Column) -> Column:
    """none, measured or estimated; unknown counts as estimated."""
    return F.when(~has_power, "none").when(device_watts.eqNullSafe(F.lit(True)), "measured").otherwise("estimated")
