"""Registered queries against their SQL, and golden series."""

import json

import pytest
from pyspark.sql import functions as F

from cadenza.operators import align, analysis, bands, climbs, decoupling, estimate, exports, power, profile, records, retrieval, workout
from cadenza.plans.registry import ORACLES, QUERIES
from cadenza.streaming.efforts import effort_sessions
from cadenza.sources.series import read_listed_series, read_series
from tests.oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_one_scan(spark):
    """Queries over one grid read the table once."""
    for name in ("work_above_ftp", "torque_cadence", "efforts", "downsample", "power_curve", "quality"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= (2 if name == "quality" else 1), name


def series(spark, blocks, hr=None, drop=()):
    """Blocks (seconds, watts) at one sample a second; `drop` holds ranges of dropped seconds."""
    watts = [w for n, w in blocks for _ in range(n)]
    rows = [("a", t, float(t), float(w), float(hr(t, w) if hr else min(178, round(95 + 0.19 * w)))) for t, w in enumerate(watts) if not any(a <= t < b for a, b in drop)]
    return spark.createDataFrame(rows, "activity_id string, sample_idx int, t double, watts double, heartrate double")


# Series and the figures they must give.
GOLDEN = {
    "steady": ([(3600, 180)], (), (3600, 180.0, 180.0, 1.0, 0.72, 51.84, 648.0)),
    "blocks": ([(600, 150), (720, 225), (300, 120), (720, 225), (300, 120), (720, 225), (600, 140)], (), (3960, 184.85, 198.71, 1.075, 0.7948, 69.49, 732.0)),
    "gaps": ([(5400, 190)], ((1800, 1845), (3600, 4200)), (4755, 190.0, 190.0, 1.0, 0.76, 76.29, 903.45)),
    "rest": ([(1200, 215), (600, 0), (1200, 200)], (), (3000, 166.0, 196.13, 1.1815, 0.7845, 51.29, 498.0)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_power_golden(spark, name):
    blocks, drop, want = GOLDEN[name]
    rows = align.align(series(spark, blocks, drop=drop), ("watts", "heartrate"))
    r = power.power_metrics(rows, F.lit(250.0), F.lit(72.0)).first()
    assert (r.valid_seconds, r.avg_w, r.np_w, r.vi, r.intensity, r.tss, r.work_kj) == pytest.approx(want, abs=0.011)


def test_curve_golden(spark):
    rows = align.align(series(spark, [(900, 165), *[x for _ in range(4) for x in ((180, 340), (180, 120))], (180, 340), (600, 140)]), ("watts",))
    got = {r.duration_s: (r.best, r.start_s) for r in power.curve(rows, (60, 300, 1200)).collect()}
    assert got == {60: (340.0, 900), 300: (270.0, 780), 1200: (241.0, 900)}


def test_decoupling_golden(spark):
    rows = align.align(series(spark, [(3600, 200)], hr=lambda t, w: 135 + 10 * t / 3599), ("watts", "heartrate"))
    r = decoupling.decoupling(rows).first()
    assert (r.first_ef, r.second_ef, r.decoupling_pct, r.valid_seconds) == pytest.approx((1.454553, 1.403502, 3.5097, 3600), abs=2e-4)


def test_climb_golden(spark):
    rows, altitude = [], 100.0
    for t in range(1401):
        grade = 0.06 if 200 <= t < 1200 else 0.0
        rows.append(("a", t, float(t), 150 + 2500 * grade, round(altitude, 3), 5.0 * t))
        altitude += 5 * grade
    found = climbs.climbs(align.align(spark.createDataFrame(rows, "activity_id string, sample_idx int, t double, watts double, altitude double, distance double"), ("watts", "altitude", "distance")), F.lit(72.0), F.lit(True)).collect()
    assert [(r.from_i, r.to_i, r.distance_m, r.tier) for r in found] == [(204, 1205, 5005.0, "media")]
    r = found[0]
    assert (r.gain_m, r.grade_pct, r.vam, r.score, r.avg_w) == pytest.approx((298.4, 5.96, 1073.1, 177.9, 299.1), abs=0.11)
    # fixed values
    assert (r.np_w, r.sustained_pct, r.efficiency_index) == pytest.approx((299.9, 6.0, 258.33), abs=0.06)


def test_zones():
    assert [z[1:] for z in bands.lthr_zones(165, 190)] == [(0, 114), (114, 139), (139, 157), (157, 174), (174, 191)]
    with pytest.raises(ValueError):
        bands.contiguous([("a", 0, 10), ("b", 11, None)])
    with pytest.raises(ValueError):
        bands.lthr_zones(0)


def test_alignment_cases(spark):
    rows = [("a", 0, 5.0, 10.0), ("a", 1, 5.2, 99.0), ("a", 2, 8.0, None), ("a", 3, 9.0, 50.0), ("a", 4, 20.0, float("nan")), ("a", 5, None, 1.0), ("b", 0, 0.0, None)]
    df = spark.createDataFrame(rows, "activity_id string, sample_idx int, t double, watts double")
    got = {(r.activity_id, r.i): (r.valid, r.watts) for r in align.align(df, ("watts",)).collect()}
    assert [got["a", i] for i in range(6)] == [(True, 10.0), (True, 20.0), (True, 30.0), (True, 40.0), (True, 50.0), (False, 50.0)]
    assert got["a", 15] == (True, 50.0) and got["b", 0] == (True, 0.0)
    assert align.align(df.limit(0), ("watts",)).count() == 0


def test_profile(spark):
    entries = spark.sql("select 'x' as athlete_id, 1.0 as value, date'2024-01-01' as effective_from, cast(null as date) as effective_to")
    new = spark.sql("select 'x' as athlete_id, 2.0 as value, date'2024-02-01' as effective_from, cast(null as date) as effective_to")
    both = profile.upserted(entries, new, ["athlete_id"])
    assert sorted((float(r.value), str(r.effective_to)) for r in both.collect()) == [(1.0, "2024-01-31"), (2.0, "None")]
    assert profile.overlaps(both, ["athlete_id"]).count() == 0
    e = spark.range(1).select(estimate.vo2max(F.lit(320.0), F.lit(72.0)).alias("v"), estimate.ftp(F.lit(265.0)).alias("f"), estimate.lthr(F.lit(170.0)).alias("l")).first()
    assert (e.v, e.f, e.l) == (56.02, 251.75, 167.0)


def test_workout(spark, tmp_path):
    text = """Plan:
- Warm-up: 10 min at very easy
- Main: 90 sec at 105% FTP [Cadence: 95, Notes: a < b & "c"]
 - indented: 5 min at hard
- no duration at all
- Cool: 5 MIN at whatever [Cadence: 0]"""
    plans = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "id string, text string")
    found = workout.segments(plans, "id", "text")
    assert [(r.kind, r.seconds, r.power, r.cadence) for r in found.orderBy("place").collect()] == [("Warm-up", 600, 0.5, None), ("Main", 90, 1.05, 95), ("Cool", 300, 0.75, None)]
    workout.save(workout.as_xml(found, "id"), "id", str(tmp_path / "out"))
    (row,) = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert row.id == "a" and '<SteadyState Duration="90" Power="1.05" Cadence="95" ShowsPower="1" textEvent="a &lt; b &amp; &quot;c&quot;"/>' in row.value
    assert row.value.count("SteadyState") == 3


def test_series_files(spark, tmp_path):
    wide = {"activity_id": "7", "device_watts": True, "streams": {"time": {"data": [0, 1, 2]}, "watts": {"data": [100, None]}, "moving": {"data": [True, False, True]}, "grade": {"data": [1.5, 2, 3]}}}
    (tmp_path / "7.streams.json").write_text(json.dumps(wide, indent=1))
    rows = read_series(spark, str(tmp_path / "7.streams.json")).orderBy("sample_idx").collect()
    assert [(r.activity_id, r.t, r.watts, r.heartrate, r.grade, r.moving) for r in rows] == [("7", 0.0, 100.0, None, 1.5, True), ("7", 1.0, None, None, 2.0, False), ("7", 2.0, None, None, 3.0, True)]
    (tmp_path / "8.json").write_text(json.dumps([{"type": "time", "data": [0, 2]}, {"type": "latlng", "data": [[1.0, 2.0], [1.0, 2.1]]}, {"type": "watts", "data": [5, 6]}]))
    rows = read_listed_series(spark, str(tmp_path / "8.json")).orderBy("sample_idx").collect()
    assert [(r.activity_id, r.t, r.watts, r.moving) for r in rows] == [("8", 0.0, 5.0, None), ("8", 2.0, 6.0, None)]


def test_absent_signals(spark):
    """A ride without power, heart rate or altitude has nulls, not zeros."""
    rows = [("a", t, float(t), None, None, 0.0, None, 5.0 * t) for t in range(700)] + [("b", t, float(t), 0.0, 0.0, 0.0, 10.0, 0.0) for t in range(700)] + [("c", 0, 0.0, 5.0, 5.0, 5.0, 5.0, 5.0)]
    cells = align.align(spark.createDataFrame(rows, "activity_id string, sample_idx int, t double, watts double, heartrate double, cadence double, altitude double, distance double"))
    m = {r.activity_id: r for r in power.power_metrics(cells, F.lit(250.0), F.lit(70.0)).collect()}
    assert (m["a"].valid_seconds, m["a"].avg_w, m["a"].np_w, m["a"].tss, m["a"].work_kj, m["a"].np_windows) == (700, None, None, None, None, 0)
    assert (m["b"].avg_w, m["b"].np_w, m["b"].vi, m["b"].np_windows) == (0.0, 0.0, None, 671) and m["c"].np_w is None
    assert all(r.best is None for r in power.curve(cells, (1, 5)).where("activity_id = 'a'").collect())
    assert [(r.seconds, r.mean) for r in power.signal_summary(cells).where("activity_id = 'a' and signal = 'heartrate'").collect()] == [(0, None)]
    assert {r.seconds for r in bands.time_in_zones(cells, "watts", bands.absolute(bands.POWER_ZONES, 250.0)).where("activity_id = 'a'").collect()} == {None}
    assert {r.seconds for r in bands.work_above(cells, 250.0).where("activity_id = 'a'").collect()} == {None}
    assert {r.seconds for r in bands.torque_by_cadence(cells).where("activity_id = 'b'").collect()} == {0}
    assert [r.available for r in decoupling.decoupling(cells).collect()] == [False] * 3
    assert climbs.climbs(cells).count() == 0
    for df in analysis.analysis(cells, 250.0, 70.0, bands.absolute(bands.POWER_ZONES, 250.0), bands.lthr_zones(160.0, 190.0)).values():
        for row in df.collect():
            assert not any(isinstance(x, float) and x != x for x in row)


def test_too_long(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 86_400.0, 1.0), ("b", 0, 0.0, 1.0), ("b", 1, 86_399.0, None), ("c", 0, None, 1.0)], "activity_id string, sample_idx int, t double, watts double")
    assert {r.activity_id: r.status for r in align.availability(df, ("watts",)).collect()} == {"a": "too_long", "b": "ok", "c": "no_time"}
    assert align.align(df, ("watts",)).groupBy("activity_id").count().collect()[0].asDict() == {"activity_id": "b", "count": 86_400}


def test_slices(spark):
    cells = align.align(series(spark, [(100, 200)]), ("watts", "heartrate"))
    spans = spark.createDataFrame([("a", -5, 10, 1), ("a", 90, 120, 2)], "activity_id string, from_i int, to_i int, n int")
    got = align.sliced(cells, spans).groupBy("n").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.min("offset").alias("o")).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, 11, 0, 0), (2, 10, 0, 90)]
    assert align.dropped(series(spark, [(5, 1)])).first().dropped == 0


def test_profile_rules(spark, tmp_path):
    rows = [("ftp_w", 250.0, "W", "2024-01-01", "2024-02-01", None), ("ftp_w", 40.0, "W", "2024-03-01", None, None), ("hr_max_bpm", 190.0, "W", "2024-01-01", None, "manual"), ("speed", 1.0, "W", "2024-01-01", None, None), ("map_w", 300.0, "W", "2024-02-01", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "metric string, value double, unit string, effective_from string, effective_to string, source string").withColumns({c: F.to_date(c) for c in ("effective_from", "effective_to")})
    assert sorted((r.metric, r.value, r.problem) for r in profile.violations(df).collect()) == [("ftp_w", 40.0, "range"), ("hr_max_bpm", 190.0, "unit"), ("map_w", 300.0, "dates"), ("speed", 1.0, "unknown_metric")]
    good = profile.with_defaults(df.where("value = 250"))
    profile.save(good, str(tmp_path / "p"))
    back = profile.load(spark, str(tmp_path / "p"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in good.select(*back.columns).collect()]
    with pytest.raises(ValueError):
        profile.save(df, str(tmp_path / "q"))
    assert profile.taken(df, df.where("value = 250"), ["metric"]).count() == 1
    one = spark.range(1).select(*[c.alias(n) for c, n in zip(profile.resolved(F.lit(None).cast("double"), F.lit(3.0)), ("v", "s"), strict=True)], profile.estimated(F.lit("estimated_20min")).alias("e")).first()
    assert tuple(one) == (3.0, "profile", True)


def test_uniform_and_peaks(spark):
    cells = align.align(series(spark, [(500, 100), (1, 900), (499, 100)]), ("watts", "heartrate"))
    assert [r.i for r in records.sampled(cells, 11).orderBy("i").collect()] == [int(j * 999 / 10 + 0.5) for j in range(11)]
    assert records.downsampled(cells, "watts", 11).where("i = 500").first().watts == 900.0
    assert records.sampled(cells, 1).count() == 1 and records.sampled(cells, 5000).count() == 1000


def test_routes(spark, tmp_path):
    points = spark.createDataFrame([("7", 1, 2.0, 3.5, 10.0), ("7", 0, 1.0, 3.5, None), ("7", 2, None, 3.5, None), ("8", 0, 1.0, 1.0, 1.0)], "id string, place int, lat double, lng double, altitude double")
    found = {r.id: r for r in exports.gpx(points, "id", F.concat(F.lit("a&b"), "id")).collect()}
    assert '<name>a&amp;b7</name>' in found["7"].text and found["7"].file == "route-7.gpx"
    assert '<trkpt lat="1.000000" lon="3.500000"/><trkpt lat="2.000000" lon="3.500000"><ele>10.0</ele></trkpt>' in found["7"].text
    exports.save(exports.tcx(points, "id", F.col("id")), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).count() == 2


def test_stream_efforts(spark, tmp_path):
    """Sessions of a stream are the efforts of its samples, once the watermark has passed them."""
    watts = [300] * 20 + [100] * 2 + [300] * 10 + [100] * 5 + [300] * 4 + [100] * 60
    rows = [("a", t, float(w)) for t, w in enumerate(watts)]
    df = spark.createDataFrame(rows, "activity_id string, s long, watts double").select("activity_id", F.timestamp_seconds("s").alias("at"), "watts")
    df.repartitionByRange(4, "at").write.parquet(str(tmp_path / "in"))
    df.select("activity_id", (F.timestamp_seconds(F.lit(10_000))).alias("at"), F.lit(1.0).alias("watts")).limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    done = effort_sessions(stream, 250.0, (("high", 1.0, None),), lateness="200 seconds").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    got = sorted((r.range, r.began.timestamp(), r.seconds, r.mean_w) for r in spark.table("sessions").collect())
    assert [(r[0], r[2], r[3]) for r in got] == [("high", 30, 300.0), ("high", 4, 300.0)]


def test_scans_of_whole_analyses(spark):
    """Cells are made once: samples are read once, and the table once more for what is known of each activity."""
    for name, most in (("compare_activities", 3), ("activity_analysis", 3), ("stream_page", 1)):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most, name


def test_route_pages(spark):
    rows = spark.createDataFrame([(k, k % 2, 12_345.0 * k, 99.5, k % 4 or None, [1, 2] if k % 3 else None) for k in range(9)], "route_id int, athlete_id int, metres double, climbed double, type int, segments array<int>")
    got = {r.route_id: (r.place, r.pages, r.km, r.gain_m, r.kind, r.segment_count) for r in retrieval.routes(rows, "athlete_id", 2, 2, "route_id").collect()}
    assert got == {4: (3, 3, 49.4, 100.0, None, 2), 6: (4, 3, 74.1, 100.0, "Run", None), 5: (3, 2, 61.7, 100.0, "Ride", 2), 7: (4, 2, 86.4, 100.0, "Other", 2)}
    assert retrieval.routes(rows, "athlete_id", 9, 2, "route_id").count() == 0
    for page, size in ((0, 5), (1, 51), (1, 0)):
        with pytest.raises(ValueError, match="pages are counted"):
            retrieval.routes(rows, "athlete_id", page, size, "route_id")


def test_parameter_sources(spark):
    entries = spark.createDataFrame([("f", 200.0, "estimated_20min", "2024-01-01", "2024-01-31"), ("f", 210.0, "estimated_hr20min", "2024-02-01", None)], "metric string, value double, source string, effective_from string, effective_to string")
    entries = entries.withColumns({c: F.col(c).cast("date") for c in ("effective_from", "effective_to")})
    rows = spark.createDataFrame([(1, "f", "2024-01-31", None), (2, "f", "2024-02-01", None), (3, "f", "2023-12-31", None), (4, "f", "2023-12-31", 250.0), (5, "g", "2024-02-01", None), (6, "f", None, None)], "k int, metric string, day string, asked double")
    got = {r.k: (r.value, r.source, r.estimated, r.status) for r in profile.resolved_as_of(rows.withColumn("day", F.col("day").cast("date")), entries, ["metric"], "day", "asked").collect()}
    missing = (None, None, False, "missing_parameter")
    assert got == {1: (200.0, "estimated_20min", True, "profile"), 2: (210.0, "estimated_hr20min", False, "profile"), 3: missing, 4: (250.0, "override", False, "override"), 5: missing, 6: missing}
