"""Climbs: smoothing, grades, gain with a dead band, segmentation and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY, along, centred_mean, upto
from cadenza.functions.scalars import micro, rnd
from cadenza.operators.power import NP_WINDOW, with_fourth, with_signal

SMOOTHING, GRADE_METRES, NOISE = 15, 50, 1.0
#: The stretch of a sustained grade, in metres, and the least of it that counts.
SUSTAINED_METRES, SUSTAINED_LEAST = 200, 180
MIN_GAIN, MIN_GRADE, MIN_LENGTH, MAX_FLAT = 30.0, 3.0, 500.0, 200.0
#: The least score of each tier, and its name.
TIERS = ((700.0, "muy dura"), (300.0, "dura"), (100.0, "media"), (20.0, "suave"))


def smooth(aligned: DataFrame, window: int = SMOOTHING) -> DataFrame:
    return centred_mean(aligned, "altitude", window, "smooth")


def grades(smoothed: DataFrame, metres: int = GRADE_METRES) -> DataFrame:
    """smoothed with `grade`, in percent, to the nearest earlier cell at least `metres` back; 0 below one metre."""
    w = Window.partitionBy(KEY).orderBy(F.col("distance")).rangeBetween(Window.unboundedPreceding, -metres)
    back = F.coalesce(F.max(F.struct("i", "distance", "smooth")).over(w), F.min(F.struct("i", "distance", "smooth")).over(Window.partitionBy(KEY)))
    run = F.col("distance") - F.col("back.distance")
    return smoothed.withColumn("back", back).withColumn("grade", F.when(run < 1, 0.0).otherwise((F.col("smooth") - F.col("back.smooth")) / run * 100)).drop("back")


def deadband_gain(values: Column, noise: float = NOISE) -> Column:
    """Metres gained along an array: a rise counts once it passes the noise above the last low."""
    zero = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(0.0).alias("gain"))

    def step(s: Column, x: Column) -> Column:
        up = x - s["ref"]
        return F.when(s["ref"].isNull() | (x < s["ref"]), F.struct(x.alias("ref"), s["gain"].alias("gain"))).when(up > noise, F.struct(x.alias("ref"), (s["gain"] + up).alias("gain"))).otherwise(s)

    return F.aggregate(values, zero, step, lambda s: s["gain"])


def tier(score: Column) -> Column:
    out = F.lit("corta")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def marked(aligned: DataFrame) -> DataFrame:
    """aligned with smooth, grade, and of the cells inside a climb, trimmed, `climb`, `from_i` and `to_i`; in one pass by activity.

    Cells of series without altitude or distance are in no climb.
    """
    w = along()
    rows = grades(smooth(aligned))
    step = F.greatest(F.col("distance") - F.lag("distance").over(w), F.lit(0.0))
    rows = rows.withColumns(
        {
            "ok": F.coalesce(F.col("valid") & F.lag("valid").over(w), F.lit(False)),
            "step": F.coalesce(step, F.lit(0.0)),
            "up": F.coalesce(F.col("smooth") > F.lag("smooth").over(w), F.lit(False)),
        }
    )
    has = with_signal(aligned, "altitude") & with_signal(aligned, "distance")
    rows = rows.withColumn("rising", F.col("ok") & (F.col("grade") >= MIN_GRADE) & has)
    flat = F.when(F.col("rising"), 0.0).otherwise(F.col("step"))
    rows = rows.withColumns({"bad": F.sum((~F.col("ok")).cast("int")).over(upto(w)), "flat": F.sum(flat).over(upto(w))})
    last = F.last(F.when(F.col("rising"), F.struct("bad", "flat")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = last.isNull() | (last["bad"] != F.col("bad")) | (F.col("flat") - last["flat"] > MAX_FLAT)
    rows = rows.withColumn("new", F.when(F.col("rising") & new, 1).otherwise(0)).withColumn("number", F.sum("new").over(upto(w)))
    down = along(F.desc("i"))
    after = F.last(F.when(F.col("rising"), F.col("number")), ignorenulls=True).over(upto(down))
    # a climb begins one cell before its first rising one
    starts = F.lead("new").over(w) == 1
    rows = rows.withColumn("climb", F.when(F.col("rising") | (after == F.col("number")), F.col("number")).when(starts, F.col("number") + 1))
    by = Window.partitionBy(KEY, "climb")
    rows = rows.withColumn("begin", F.min("i").over(by))
    rise = F.col("up") & (F.col("i") > F.col("begin"))
    rows = rows.withColumns({"from_i": F.min(F.when(rise, F.col("i") - 1)).over(by), "to_i": F.max(F.when(rise, F.col("i"))).over(by)})
    inside = (F.col("climb") > 0) & F.col("i").between(F.col("from_i"), F.col("to_i"))
    rows = rows.withColumns({c: F.when(inside, F.col(c)) for c in ("climb", "from_i", "to_i")})
    return rows.drop("ok", "step", "up", "rising", "bad", "flat", "new", "number", "begin")


def with_sustained(rows: DataFrame) -> DataFrame:
    """Cells of marked() with `__grade`: the grade over the last SUSTAINED_METRES of their climb, null over too short a stretch."""
    back = Window.partitionBy(KEY, "climb").orderBy("distance").rangeBetween(-SUSTAINED_METRES, 0)
    start = F.min(F.struct("i", "distance", "smooth")).over(back)
    run = F.col("distance") - start["distance"]
    return rows.withColumn("__grade", F.when(run >= SUSTAINED_LEAST, (F.col("smooth") - start["smooth"]) / run * 100))


def climb_sums(aligned: DataFrame) -> dict[str, Column]:
    """What figures() needs of a climb's cells, which with_fourth(), marked() and with_sustained() made of aligned."""
    has_w, has_h = with_signal(aligned, "watts"), with_signal(aligned, "heartrate") if "heartrate" in aligned.columns else F.lit(False)
    heart = micro(F.col("heartrate")) if "heartrate" in aligned.columns else F.lit(None).cast("bigint")
    inside = F.col("climb").isNotNull()
    within = lambda x: F.when(inside, x)
    track = F.transform(F.array_sort(F.collect_list(within(F.struct("i", "smooth")))), lambda x: x["smooth"])
    beats = F.when(inside & F.col("valid") & has_h, heart)
    return {
        "c_d": F.max(within(F.col("distance"))) - F.min(within(F.col("distance"))),
        "c_g": deadband_gain(track),
        "c_w": F.sum(F.when(inside & F.col("valid") & has_w, micro(F.col("watts")))),
        "c_n": F.count_if(inside & F.col("valid") & has_w),
        "c_fourth": F.avg(F.when(F.col("i") - F.col("from_i") >= NP_WINDOW - 1, F.col("__fourth"))),
        "c_sustained": F.max(within(F.col("__grade"))),
        "c_h": F.sum(beats),
        "c_hn": F.count(beats),
    }


def is_climb() -> Column:
    """Whether the cells of climb_sums() make a climb: long, high and steep enough."""
    return F.col("climb").isNotNull() & (F.col("c_d") >= MIN_LENGTH) & (F.col("c_g") >= MIN_GAIN) & (F.col("c_g") / F.col("c_d") * 100 >= MIN_GRADE)


def figures(kg: Column, measured: Column) -> dict[str, Column]:
    """A climb's metrics from climb_sums()."""
    d, g = F.col("c_d"), F.col("c_g")
    grade = g / d * 100
    raw = grade * grade * d / 1000
    vam = g / ((F.col("to_i") - F.col("from_i")) / 3600.0)
    watts = F.col("c_w") / 1e6 / F.nullif("c_n", F.lit(0))
    wkg = watts / F.nullif(kg, F.lit(0.0))
    return {
        "distance_m": rnd(d, 1),
        "gain_m": rnd(g, 1),
        "grade_pct": rnd(grade, 2),
        "sustained_pct": rnd(F.col("c_sustained"), 2),
        "vam": rnd(vam, 1),
        "score": rnd(raw, 1),
        "tier": tier(raw),
        "avg_w": rnd(watts, 2),
        "np_w": rnd(F.pow("c_fourth", F.lit(0.25)), 2),
        "avg_wkg": rnd(wkg, 3),
        "efficiency_index": F.when(measured & (wkg > 0), rnd(vam / wkg, 2)),
        "avg_hr": rnd(F.col("c_h") / 1e6 / F.nullif("c_hn", F.lit(0)), 2),
    }


def climbs(aligned: DataFrame, weight: Column | None = None, measured: Column | None = None) -> DataFrame:
    """A row for each climb: (activity_id, climb, from_i, to_i, distance_m, gain_m, grade_pct, sustained_pct, vam, score, tier,
    avg_w, np_w, avg_wkg, efficiency_index, avg_hr).

    A cell rises if it and the one before are valid and its grade reaches MIN_GRADE. Rising cells belong
    together unless an invalid cell or more than MAX_FLAT metres of others lie between. The span begins one
    cell before, is trimmed to where altitude rises, and must reach the length, gain and grade limits. Series without
    altitude or distance have no climbs; align.availability() tells them apart from flat ones. weight and measured are
    literals or columns of aligned; the efficiency index needs measured power.
    """
    none = F.lit(None)
    aligned = aligned.withColumns({"__kg": (weight if weight is not None else none).cast("double"), "__measured": (measured if measured is not None else none).cast("boolean")})
    aligned = aligned.where(with_signal(aligned, "altitude") & with_signal(aligned, "distance"))
    inside = with_sustained(marked(with_fourth(aligned)).where("climb is not null"))
    sums = climb_sums(aligned) | {"__kg": F.max("__kg"), "__measured": F.max("__measured")}
    per = inside.groupBy(KEY, "climb", "from_i", "to_i").agg(*[c.alias(n) for n, c in sums.items()]).where(is_climb())
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("from_i"))
    return per.select(KEY, place.alias("climb"), "from_i", "to_i", *[c.alias(n) for n, c in figures(F.col("__kg"), F.col("__measured")).items()])


def total_gain(found: DataFrame) -> DataFrame:
    """(activity_id, climbs, gain_m): the climbs of an activity and the sum of their rounded gains."""
    tenths = F.sum(F.floor(F.col("gain_m") * 10 + 0.5).cast("bigint"))
    return found.groupBy(KEY).agg(F.count("*").alias("climbs"), rnd(tenths / 10.0, 1).alias("gain_m"))


def trend(rows: DataFrame, x: str, y: str, by: str = KEY) -> DataFrame:
    """(by, slope, intercept, r2, n): a straight line by least squares, with three points or more."""
    per = rows.where(F.col(y).isNotNull()).groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    return per.where("n >= 3 and slope is not null").select(by, rnd(F.col("slope"), 4).alias("slope"), rnd(F.col("intercept"), 4).alias("intercept"), rnd(F.coalesce("r2", F.lit(1.0)), 4).alias("r2"), "n")
