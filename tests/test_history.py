"""Best efforts of a history against plain loops."""

import random
from datetime import date

from pyspark.sql import functions as F

from cadenza.operators import align, history


def cells_of(spark, series):
    """Samples a second of {activity: watts, None where a sample lacks}."""
    rows = [(a, t, float(t), float(w)) for a, watts in series.items() for t, w in enumerate(watts) if w is not None]
    return align.align(spark.createDataFrame(rows, "activity_id string, sample_idx int, t double, watts double"), ("watts",))


def best_mean(watts, d):
    """The best mean over d seconds that holds no gap of more than 3 samples; gaps are filled straight."""
    known = [t for t, w in enumerate(watts) if w is not None]
    last, full = known[-1], {}
    for a, b in zip(known, [*known[1:], last + 1], strict=True):
        for t in range(a, b):
            full[t - known[0]] = watts[a] if t == a else watts[a] + (watts[b] - watts[a]) * (t - a) / (b - a) if b - a <= 4 else None
    n = len(full)
    sums = [sum(full[t] for t in range(k, k + d)) for k in range(n - d + 1) if all(full[t] is not None for t in range(k, k + d))]
    return int(max(sums) / d * 100 + 0.5) / 100 if sums else None


def test_best_over(spark):
    draw = random.Random(3)
    series = {f"a{k}": [None if 0 < t < 79 and draw.random() < 0.15 else draw.randrange(400) for t in range(80)] for k in range(6)}
    series["gap"] = [*[100] * 20, *[None] * 9, *[300] * 10]
    durations = [1, 2, 7, 15, 30, 79, 80, 81, 500]
    wanted = spark.createDataFrame([(a, durations) for a in series], "activity_id string, durations array<bigint>")
    got = {(r.activity_id, r.duration_s): r.best for r in history.best_over(history.running_sums(cells_of(spark, series)), wanted).collect()}
    want = {(a, d): best_mean(w, d) for a, w in series.items() for d in durations if best_mean(w, d) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.011 for k in got)


ACTS = "activity_id string, athlete_id int, day date, device_watts boolean"


def climb(activity, from_i, to_i, watts):
    return (activity, 1, from_i, to_i, watts)


def test_a_record_passes_100(spark):
    """Three rides: the record's own ride doesn't count, the unmeasured one neither, and other athletes are apart."""
    series = {"record": [300] * 60, "older": [200] * 60, "guess": [900] * 60, "other": [500] * 60, "lonely": [100] * 60}
    acts = [("record", 1, date(2024, 3, 1), True), ("older", 1, date(2024, 2, 20), True), ("guess", 1, date(2024, 2, 21), False), ("old", 1, date(2023, 1, 1), True), ("other", 2, date(2024, 3, 1), True), ("lonely", 3, date(2024, 3, 1), None)]
    activities = spark.createDataFrame(acts, ACTS)
    climbs = [climb("record", 0, 40, 300.0), climb("older", 0, 40, 200.0), climb("older", 5, 500, 150.0), climb("guess", 0, 40, 900.0), climb("old", 3, 43, 250.0), climb("other", 0, 40, 500.0), climb("lonely", 0, 4, 1.0), climb("old", 0, 20, None)]
    found = spark.createDataFrame(climbs, "activity_id string, climb int, from_i bigint, to_i bigint, avg_w double")
    listed = history.recent(activities, "2024-03-02")
    got = history.climbs_against_history(found, cells_of(spark, series), listed, activities)
    rows = {(r.activity_id, r.duration_s): (r.status, r.best_w, r.best_activity_id, r.percent_of_best) for r in got.collect()}
    assert rows == {
        ("record", 40): ("compared", 200.0, "older", 150.0),
        ("older", 40): ("compared", 300.0, "record", 66.7),
        ("older", 495): ("no_history", None, None, None),
        ("guess", 40): ("not_measured", None, None, None),
        ("old", 40): ("compared", 300.0, "record", 83.3),
        ("old", 20): ("no_power", None, None, None),
        ("other", 40): ("no_history", None, None, None),
        ("lonely", 4): ("not_measured", None, None, None),
    }


def test_listing(spark):
    acts = spark.createDataFrame([(f"a{k}", k % 2, date(2024, 1, 1 + k // 4), k % 3 > 0) for k in range(40)], ACTS)
    got = history.recent(acts, "2024-01-09", days=7, most=5)
    assert sorted((r.athlete_id, r.pos, r.activity_id) for r in got.where("athlete_id = 0").collect()) == [(0, 1, "a32"), (0, 2, "a34"), (0, 3, "a28"), (0, 4, "a30"), (0, 5, "a24")]
    assert history.recent(acts, "2030-01-01").count() == 0
    assert history.recent(acts, "2024-01-09", days=7, most=100).agg(F.min("day")).first()[0] == date(2024, 1, 2)
