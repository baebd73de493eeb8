"""Whole analyses in one pass against the operators by themselves; comparisons and their rules."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions.ordered import centred_mean
from cadenza.operators import align, analysis, bands, climbs, decoupling, power

SCHEMA = "activity_id string, sample_idx int, t double, watts double, heartrate double, cadence double, altitude double, distance double"


@pytest.fixture(scope="module")
def cells(spark):
    def series(name, n, watts=True, hr=True, high=True, cadence=80.0, gap=False):
        return [
            (
                name, t, float(t + (40 if gap and t > n // 2 else 0)), 150.0 + t % 70 if watts else None, 120.0 + t % 30 + t / 100 if hr else None, cadence,
                100.0 + (min(t % 400, 200) * 0.5) if high else None, t * 7.0,
            )
            for t in range(n)
        ]

    rows = series("full", 1500, gap=True) + series("nopower", 800, watts=False) + series("nohr", 800, hr=False) + series("flat", 700, high=False, cadence=0.0) + series("short", 90) + series("bare", 50, False, False, False)
    parameters = [("full", 200.0, 70.0, 180.0, True), ("nopower", None, 70.0, None, None), ("nohr", None, None, None, False), ("flat", 210.0, None, 175.0, True), ("short", 200.0, 70.0, 180.0, None), ("bare", None, None, None, None)]
    params = spark.createDataFrame(parameters, "activity_id string, ftp_w double, weight_kg double, hr_max_bpm double, device_watts boolean")
    sparse = spark.createDataFrame([("sparse", 0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("sparse", 1, 100.0, 1.0, 1.0, 1.0, 1.0, 2.0)], SCHEMA)
    return align.align(spark.createDataFrame(rows, SCHEMA).union(sparse)).join(params, "activity_id", "left")


def test_codes(spark, cells):
    got = {r.activity_id: r for r in analysis.whole(cells).collect()}
    codes = {a: {m: (r[m].available, r[m].code) for m in analysis.MODULES} for a, r in got.items()}
    ok = (True, None)
    assert codes["full"] == dict.fromkeys(analysis.MODULES, ok)
    assert {m: c for m, c in codes["nopower"].items() if c != ok} == {"power_metrics": (False, "MISSING_POWER"), "power_zones": (False, "MISSING_POWER"), "heartrate_zones": (False, "INVALID_PROFILE"), "decoupling": (False, "MISSING_POWER")}
    assert {m: c for m, c in codes["nohr"].items() if c != ok} == {"heartrate_summary": (False, "MISSING_HR"), "power_zones": (False, "MISSING_FTP"), "heartrate_zones": (False, "MISSING_HR"), "decoupling": (False, "MISSING_HR")}
    assert {m: c for m, c in codes["flat"].items() if c != ok} == {"cadence_summary": (False, None), "climbs": (False, "MISSING_ELEVATION")}
    assert codes["short"]["decoupling"] == (False, "INSUFFICIENT_DURATION")
    assert (codes["bare"]["decoupling"], got["bare"].modules_available, got["bare"].errors) == ((False, "MISSING_POWER"), 2, ["MISSING_FTP", "MISSING_WEIGHT"])
    assert got["sparse"].errors == ["MISSING_FTP", "MISSING_WEIGHT", "LOW_COVERAGE"] and got["full"].errors == []
    assert set(analysis.CODES) >= {c for r in codes.values() for _, c in r.values() if c} | {e for r in got.values() for e in r.errors}
    assert got["nohr"].power_metrics.unavailable_metrics == ["intensity", "tss", "avg_wkg"] and got["nohr"].power_metrics.tss is None
    assert got["nopower"].power_metrics.avg_w is None and got["nopower"].activity_details.power_source == "none"


def test_same_as_the_modules(spark, cells):
    got = {r.activity_id: r for r in analysis.whole(cells).collect()}
    for r in power.power_metrics(cells, F.col("ftp_w"), F.col("weight_kg")).collect():
        if got[r.activity_id].power_metrics.available:
            assert [got[r.activity_id].power_metrics[c] for c in ("avg_w", "np_w", "vi", "intensity", "tss", "work_kj", "avg_wkg", "np_windows")] == [r[c] for c in ("avg_w", "np_w", "vi", "intensity", "tss", "work_kj", "avg_wkg", "np_windows")]
    for r in decoupling.decoupling(cells).where("available").collect():
        assert [got[r.activity_id].decoupling[c] for c in ("first_ef", "second_ef", "decoupling_pct")] == [r.first_ef, r.second_ef, r.decoupling_pct]
    full = cells.where("activity_id = 'full'")
    zones = bands.time_in_zones(full, "watts", bands.absolute(bands.POWER_ZONES, 200.0)).orderBy("lower").collect()
    assert (got["full"].power_zones.seconds, got["full"].power_zones.percent) == ([r.seconds for r in zones], [r.percent for r in zones])
    found = climbs.climbs(cells, F.col("weight_kg"), F.col("device_watts")).orderBy("activity_id", "from_i").collect()
    assert len(found) >= 4
    assert [(a, c.from_i, c.to_i, c.vam, c.avg_w, c.efficiency_index, c.avg_hr) for a in sorted(got) for c in got[a].climbs.climbs or []] == [
        (r.activity_id, r.from_i, r.to_i, r.vam, r.avg_w, r.efficiency_index, r.avg_hr) for r in found
    ]


def test_one_exchange(spark, cells):
    """Alignment's shuffle by activity serves all modules; the parameters' side of the join is the other one."""
    samples = spark.createDataFrame([("a", 0, 0.0, *[1.0] * 5)], SCHEMA)
    rows = align.align(samples).withColumns({c: F.lit(1.0) for c in ("ftp_w", "weight_kg", "hr_max_bpm")} | {"device_watts": F.lit(True)})
    for df in (analysis.whole(rows), analysis.compare(rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1
    assert analysis.whole(rows.limit(0)).count() == 0


def test_comparisons(spark):
    acts = spark.createDataFrame([(f"a{k}", 1) for k in range(12)] + [("b0", 2), ("x", None)], "activity_id string, athlete_id int")
    asked = [(1, 1, "a1"), (1, 1, "a2"), (1, 1, "a1"), (2, 1, "a1"), (3, 1, "a1"), (3, 1, "b0"), (3, 1, "zz"), (3, 1, "x"), (3, 1, None), *[(4, 1, f"a{k}") for k in range(11)], *[(5, 1, f"a{k}") for k in range(10)], (6, None, "x"), (6, None, "a1")]
    got = {r.comparison: (r.asked, r.usable, r.rejected, r.code, r.ids) for r in analysis.comparisons(spark.createDataFrame(asked, "comparison int, athlete_id int, activity_id string"), acts).collect()}
    assert got[1] == (2, 2, 0, None, ["a1", "a2"])
    assert got[2] == (1, 1, 0, "INVALID_REQUEST", [])
    assert got[3] == (4, 1, 3, "INSUFFICIENT_DURATION", [])
    assert got[4][3] == "INVALID_REQUEST" and got[5][:2] == (10, 10) and len(got[5][4]) == 10
    assert got[6] == (2, 0, 2, "INSUFFICIENT_DURATION", [])


@pytest.mark.parametrize("window", [1, 2, 5, 15])
@pytest.mark.parametrize("n", [1, 2, 6, 16, 40])
def test_centred_mean(spark, window, n):
    rows = [("a", i, (i * 7 % 11) / 2, i % 5 > 0 or n < 3) for i in range(n)]
    df = centred_mean(spark.createDataFrame(rows, "activity_id string, i bigint, x double, valid boolean"), "x", window, "m")
    for r in df.collect():
        reach = min(window // 2, r.i, n - 1 - r.i)
        near = [x for _, i, x, ok in rows if abs(i - r.i) <= reach and ok]
        assert r.m == pytest.approx(sum(near) / len(near) if near else rows[r.i][2], abs=1e-6)
