"""Zones as data: look-up, rules, sets as of the day."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cadenza.operators import align, bands, zonesets

ZONES = f"array<{zonesets.ZONE}>"


def zones_of(*lowers, top=None):
    return [(f"z{k}", float(lo), None if hi is None else float(hi)) for k, (lo, hi) in enumerate(zip(lowers, [*lowers[1:], top], strict=True))]


def test_lookup(spark):
    draw = random.Random(1)
    sets = [zones_of(0, 5, 9), zones_of(-3, 0, 4, top=10), zones_of(0), zones_of(*sorted(draw.sample(range(-50, 0), 1)) , *sorted(draw.sample(range(1, 3000), 800))), zones_of(0, top=1)]
    rows = [(k, v, s[::-1]) for k, s in enumerate(sets) for v in (-60.0, -3.0, -0.5, 0.0, 0.5, 4.0, 4.999, 5.0, 9.0, 10.0, 700.0, 5000.0, None)]
    df = spark.createDataFrame(rows, f"k int, v double, zones {ZONES}").select("k", "v", zonesets.zone_of(F.col("v"), zonesets.by_bound(F.col("zones"))).alias("zone"))
    for r in df.collect():
        want = [i + 1 for i, (_, lo, hi) in enumerate(sets[r.k]) if r.v is not None and lo <= r.v and (hi is None or r.v < hi)]
        assert [r.zone] == (want or [None]), r


def test_rules(spark):
    cases = {
        None: zones_of(0, 5, 9), "empty": [], "start": zones_of(1, 5), "closed_top": zones_of(0, 5, top=9), "not_contiguous": [("a", 0.0, 5.0), ("b", 6.0, None)],
        "open_inside": [("a", 0.0, None), ("b", 6.0, None)], "bound": [("a", None, 5.0)], "too_many": zones_of(*range(1 << zonesets.STEPS)),
    }
    df = spark.createDataFrame([(k or "fine", z) for k, z in cases.items()] + [("empty", None)], f"want string, zones {ZONES}")
    assert all(r.want == (r.p or "fine") for r in df.select("want", zonesets.problem(F.col("zones"), F.lit(False)).alias("p")).collect())
    allowed = df.where("want = 'closed_top'").select(zonesets.problem(F.col("zones"), F.lit(True))).first()
    assert allowed[0] is None


@pytest.mark.parametrize(("lthr", "top"), [(165.0, 190.0), (110.0, 178.0), (165.0, 160.0), (142.5, None)])
def test_same_as_literal_zones(spark, lthr, top):
    row = spark.createDataFrame([(lthr, top)], "l double, m double").select(zonesets.lthr_zones(F.col("l"), F.col("m")).alias("z"), zonesets.relative_zones(bands.POWER_ZONES, F.col("l")).alias("p")).first()
    assert [tuple(z) for z in row.z] == bands.lthr_zones(lthr, top)
    assert [tuple(z) for z in row.p] == bands.absolute(bands.POWER_ZONES, lthr)


def test_nothing_to_anchor_to(spark):
    row = spark.createDataFrame([(None, 0.0)], "l double, m double").select(zonesets.lthr_zones(F.col("l"), F.lit(1.0)), zonesets.lthr_zones(F.col("m"), F.lit(1.0)), zonesets.relative_zones(bands.HR_ZONES, F.col("m"))).first()
    assert tuple(row) == (None, None, None)


def test_sets_as_of_the_day(spark):
    """Two athletes, sets side by side, one of them replaced, one that has ended; an activity without any."""
    sets = [
        (1, "own", "watts", zones_of(0, 100), date(2024, 1, 1), date(2024, 1, 31)), (1, "own", "watts", zones_of(0, 50, 200), date(2024, 2, 1), None),
        (1, "hr", "heartrate", zones_of(0, 130, top=140), date(2024, 1, 1), None), (2, "own", "watts", zones_of(0, 10), date(2023, 1, 1), date(2023, 12, 31)), (2, "old", "altitude", zones_of(0), date(2023, 1, 1), None),
    ]
    sets = spark.createDataFrame(sets, f"athlete_id int, set string, signal string, zones {ZONES}, effective_from date, effective_to date")
    acts = spark.createDataFrame([("jan", 1, date(2024, 1, 31)), ("feb", 1, date(2024, 2, 1)), ("other", 2, date(2024, 1, 1)), ("none", 3, date(2024, 1, 1))], "activity_id string, athlete_id int, day date")
    held = zonesets.assigned(acts, sets)
    assert sorted((r.activity_id, r.set, len(r.zones)) for r in held.collect()) == [("feb", "hr", 2), ("feb", "own", 3), ("jan", "hr", 2), ("jan", "own", 2), ("other", "old", 1)]
    samples = [(a, t, float(t), 60.0 + 100 * (t % 2), 125.0 + t) for a in ("jan", "feb", "none") for t in range(20)] + [("other", t, float(t), 5.0, None) for t in range(4)]
    cells = align.align(spark.createDataFrame(samples, "activity_id string, sample_idx int, t double, watts double, heartrate double"), ("watts", "heartrate"))
    got = {(r.activity_id, r.set, r.name): (r.seconds, r.percent, r.unclassified_seconds) for r in zonesets.time_in_sets(cells, held, ("watts", "heartrate")).collect()}
    assert got == {
        ("jan", "own", "z0"): (10, 50.0, 0), ("jan", "own", "z1"): (10, 50.0, 0), ("feb", "own", "z0"): (0, 0.0, 0), ("feb", "own", "z1"): (20, 100.0, 0), ("feb", "own", "z2"): (0, 0.0, 0),
        ("jan", "hr", "z0"): (5, 33.33, 5), ("jan", "hr", "z1"): (10, 66.67, 5), ("feb", "hr", "z0"): (5, 33.33, 5), ("feb", "hr", "z1"): (10, 66.67, 5), ("other", "old", "z0"): (None, None, None),
    }
    assert zonesets.time_in_sets(cells, held.limit(0), ("watts", "heartrate")).count() == 0
