"""Zones as data: each athlete's own sets as of the day, looked up by binary search in arrays of bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.ordered import KEY
from cadenza.functions.scalars import rnd
from cadenza.operators import profile
from cadenza.operators.align import SIGNALS
from cadenza.operators.bands import Band
from cadenza.operators.power import with_signal

#: Shares of the threshold heart rate at which zones 2 to 4 begin and zone 4 ends.
LTHR_CUTS = (0.69, 0.84, 0.95, 1.05)
#: A binary search of this many steps finds a zone, so a set has one zone less than 2 to their power at most.
STEPS = 10
ZONE = "struct<name:string,lower:double,upper:double>"


def zone_array(names: Sequence[str], lowers: Sequence[Column], top: Column | None = None) -> Column:
    """Zones that begin at the given bounds, each up to the next one's, the last up to `top` or open."""
    none = F.lit(None).cast("double")
    uppers = [*lowers[1:], none if top is None else top]
    return F.array(*[F.struct(F.lit(n).alias("name"), lo.cast("double").alias("lower"), hi.cast("double").alias("upper")) for n, lo, hi in zip(names, lowers, uppers, strict=True)])


def lthr_zones(lthr: Column, hr_max: Column) -> Column:
    """Five zones at whole beats from the threshold heart rate; the top one closes above the highest heart rate, if that is
    known and isn't below it. Null unless the threshold is positive."""
    whole = lambda x: F.floor(x + 0.5).cast("double")
    one, two, three, four = (whole(F.lit(c) * lthr) for c in LTHR_CUTS)
    top = F.when(hr_max >= four + 1, whole(hr_max) + 1)
    return F.when(lthr > 0, zone_array([f"Z{k}" for k in range(1, 6)], [F.lit(0.0), one, two, three, four + 1], top))


def relative_zones(zones: Sequence[Band], reference: Column) -> Column:
    """Zones at shares of a reference; null unless it is positive."""
    zones = sorted(zones, key=lambda z: z[1])
    top = None if zones[-1][2] is None else F.lit(zones[-1][2]) * reference
    return F.when(reference > 0, zone_array([z[0] for z in zones], [F.lit(z[1]) * reference for z in zones], top))


def by_bound(zones: Column) -> Column:
    """Zones in ascending order, their bound first: array<struct<lower, upper, name>>."""
    return F.array_sort(F.transform(zones, lambda z: F.struct(z["lower"].alias("lower"), z["upper"].alias("upper"), z["name"].alias("name"))))


def problem(zones: Column, closed_top: Column) -> Column:
    """The first rule that an array of zones breaks, null for none: empty, too_many, bound (a null or NaN lower one), start
    (above 0), open_inside, not_contiguous, closed_top (a top that wasn't asked for)."""
    each = by_bound(zones)
    n = F.size(zones)
    last = F.get(each, n - 1)
    inner = F.slice(each, 1, F.greatest(n - 1, F.lit(0)))
    apart = F.exists(F.transform(inner, lambda z, k: F.struct(z["upper"].alias("upper"), F.get(each, k + 1)["lower"].alias("next"))), lambda x: x["upper"] != x["next"])
    return (
        F.when(zones.isNull() | (n == 0), "empty")
        .when(n >= 1 << STEPS, "too_many")
        .when(F.exists(zones, lambda z: z.isNull() | z["lower"].isNull() | F.isnan(z["lower"])), "bound")
        .when(F.get(each, F.lit(0))["lower"] > 0, "start")
        .when(F.exists(inner, lambda z: z["upper"].isNull()), "open_inside")
        .when(apart, "not_contiguous")
        .when(last["upper"].isNotNull() & ~closed_top, "closed_top")
    )


def zone_of(value: Column, zones: Column) -> Column:
    """The number of the zone, from 1, that holds value; null for none. zones is what by_bound() gives of a set without a problem."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(STEPS))])
    fits = lambda at: (at <= F.size(zones)) & (F.get(zones, at - 1)["lower"] <= value)
    at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))
    return F.transform(F.array(at), lambda k: F.when((k > 0) & (F.get(zones, k - 1)["upper"].isNull() | (value < F.get(zones, k - 1)["upper"])), k))[0]


def assigned(activities: DataFrame, sets: DataFrame) -> DataFrame:
    """(activity_id, set, signal, zones) of each activity (activity_id, athlete_id, day): its athlete's sets as of the day.

    sets has (athlete_id, set, signal, zones, effective_from, effective_to), without problems and without overlaps among those of
    one name. Several sets of an athlete hold side by side; a day that no entry of a set covers has none of it.
    """
    names = sets.groupBy("athlete_id").agg(F.collect_set("set").alias("sets"))
    asked = activities.select(KEY, "athlete_id", "day").join(names, "athlete_id").select(KEY, "athlete_id", "day", F.explode("sets").alias("set"))
    entries = sets.select("athlete_id", "set", "effective_from", "effective_to", F.struct("signal", "zones").alias("value"))
    found = profile.as_of(asked, entries, ["athlete_id", "set"], "day").where("value is not null")
    return found.select(KEY, "set", "value.signal", "value.zones")


def time_in_sets(aligned: DataFrame, sets: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """(activity_id, set, zone, name, lower, upper, seconds, percent, unclassified_seconds): every zone of each of an activity's
    sets (activity_id, set, signal, zones), empty ones too.

    Percentages are of classified seconds. An activity's sets come to its cells in one row, by the shuffle that aligned them,
    and a cell looks its zones up there, so cells aren't joined with zones. Without the signal, or for one that isn't among
    `signals`, the figures are null. Activities without a set have no rows.
    """
    held = sets.select(KEY, "set", "signal", by_bound(F.col("zones")).alias("zones"))
    packed = held.groupBy(KEY).agg(F.collect_list(F.struct("set", "signal", "zones")).alias("held"))
    rows = aligned.where("valid").join(packed, KEY)

    def of(signal: Column, what: dict[str, Column]) -> Column:
        out = F.lit(None)
        for s, x in what.items():
            out = F.when(signal == s, x).otherwise(out)
        return out

    values = {s: F.when(with_signal(aligned, s), F.col(s)) for s in signals}
    hits = F.transform("held", lambda h: F.struct(h["set"].alias("set"), zone_of(of(h["signal"], values), h["zones"]).alias("zone"), of(h["signal"], values).isNotNull().alias("has")))
    per = rows.select(KEY, F.inline(hits)).groupBy(KEY, "set", "zone").agg(F.count("*").alias("n"), F.max("has").alias("has"))
    n = F.map_from_entries(F.collect_list(F.when(F.col("zone").isNotNull(), F.struct("zone", "n"))))
    per = per.groupBy(KEY, "set").agg(n.alias("seconds"), F.sum(F.when(F.col("zone").isNotNull(), F.col("n")).otherwise(0)).alias("classified"), F.sum(F.when(F.col("zone").isNull(), F.col("n")).otherwise(0)).alias("rest"), F.max("has").alias("has"))
    each = held.join(per, [KEY, "set"]).select("*", F.posexplode("zones").alias("at", "z"))
    seconds = F.coalesce(F.try_element_at("seconds", F.col("at") + 1), F.lit(0))
    shown = lambda x: F.when(F.col("has"), x)
    return each.select(
        KEY,
        "set",
        (F.col("at") + 1).alias("zone"),
        "z.name",
        rnd(F.col("z.lower"), 4).alias("lower"),
        rnd(F.col("z.upper"), 4).alias("upper"),
        shown(seconds).alias("seconds"),
        shown(F.coalesce(rnd(seconds / F.nullif("classified", F.lit(0)) * 100, 2), F.lit(0.0))).alias("percent"),
        shown(F.col("rest")).alias("unclassified_seconds"),
    )
