"""The stream tool, and the data source of recorded series."""

import json
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadenza.operators import streams
from cadenza.sources import recorded


@pytest.fixture
def folder(tmp_path):
    def put(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))

    put("7.json", {"device_watts": True, "streams": {"time": {"data": [0, 1, "2"]}, "watts": {"data": [100, None, "x"]}, "moving": {"data": ["true", False]}, "grade": {"data": [1]}}})
    put("8.streams.json", [{"type": "time", "data": [0, 2]}, {"type": "watts", "data": [5, 6, 7]}, {"type": "grade_smooth", "data": [0.5, -0.5]}])
    put("9.json", {"streams": {}})
    put("10.json", {})
    put("notes.txt", "not a series")
    put("_part.json", "{")
    return tmp_path


def reader(spark, folder, **options):
    recorded.register(spark)
    return spark.read.format("cadenza_series").options(**options).load(f"file://{folder}")


def test_rows(spark, folder):
    df = reader(spark, folder, signals="watts, moving,grade")
    assert df.columns == ["activity_id", "device_watts", "sample_idx", "t", "watts", "moving", "grade"]
    assert sorted(map(tuple, df.collect()), key=str) == [
        ("7", True, 0, 0.0, 100.0, True, 1.0), ("7", True, 1, 1.0, None, False, None), ("7", True, 2, 2.0, None, None, None), ("8", None, 0, 0.0, 5.0, None, 0.5), ("8", None, 1, 2.0, 6.0, None, -0.5),
    ]
    assert set(reader(spark, folder).columns) >= {"heartrate", "temp", "moving"}
    with pytest.raises(PySparkException, match="no such signals"):
        reader(spark, folder, signals="watts,what")


def test_files_are_chosen_before_they_are_opened(spark, folder):
    """A filter on the id leaves the other files shut: one of them is broken."""
    (folder / "11.json").write_text("{")
    with pytest.raises(PySparkException):
        reader(spark, folder, signals="watts").count()
    some = reader(spark, folder, signals="watts").where("activity_id in ('7', '9') and sample_idx > 0")
    assert [r.sample_idx for r in some.orderBy("sample_idx").collect()] == [1, 2]
    one = reader(spark, folder, signals="watts").where("activity_id = '8'")
    assert one.count() == 2 and one.rdd.getNumPartitions() == 1


def test_opened_files(folder, monkeypatch):
    opened, own = [], recorded.json.loads
    monkeypatch.setattr(recorded.json, "loads", lambda x: opened.append(x) or own(x))
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    r = recorded.SeriesReader(f"file://{folder}", ["watts"], 1)
    other = GreaterThan(("t",), 5)
    assert list(r.pushFilters([EqualTo(("activity_id",), "7"), In(("activity_id",), ("7", "8")), other])) == [other]
    parts = r.partitions()
    assert [[Path(p).name for _, p in part.paths] for part in parts] == [["7.json"]]
    assert sum(b.num_rows for part in parts for b in r.read(part)) == 3 and len(opened) == 1
    small = recorded.SeriesReader(f"file://{folder}", ["watts"], 1).partitions()
    assert len(small) == 4 and len(recorded.SeriesReader(f"file://{folder}", ["watts"], 1 << 20).partitions()) == 1


def plain_pick(values, most):
    """The cells of one signal, by loops."""
    n = len(values)
    if n <= most:
        return list(range(n))
    kept = set()
    for j in range(most):
        at = int(j * (n - 1) / (most - 1) + 0.5)
        kept.add(at)
        if 0 < at < n - 1:
            near = range(max(1, at - 3), min(n - 2, at + 3) + 1)
            for best in (min(near, key=lambda k: (-values[k], k)), min(near, key=lambda k: (values[k], k))):
                if abs(values[best] - values[at]) > 0.1 * abs(values[at]):
                    kept.add(best)
    return sorted(kept)[:most]


def test_points(spark):
    series = {"a": [float(k * 37 % 101) for k in range(950)], "b": [3.0] * 40, "c": [float(k % 2 * 50) for k in range(101)]}
    rows = spark.createDataFrame([(a, k, v, -v, k % 3 == 0) for a, vs in series.items() for k, v in enumerate(vs)], "activity_id string, i bigint, x double, y double, m boolean")
    got = {}
    for r in streams.points(rows, ["x", "y"], ["m"]).orderBy("place").collect():
        got.setdefault((r.activity_id, r.signal), []).append((r.i, r.value))
    for a, vs in series.items():
        assert [i for i, _ in got[a, "x"]] == plain_pick(vs, 100) and all(v == vs[i] for i, v in got[a, "x"])
        assert [i for i, _ in got[a, "y"]] == plain_pick([-v for v in vs], 100)
        assert len(got[a, "m"]) == min(100, len(vs)) and all(v == (i % 3 == 0) for i, v in got[a, "m"])
    with pytest.raises(KeyError):
        streams.points(rows, ["x"], resolution="all")
    assert streams.points(rows, ["x"], resolution="medium").count() == 950 + 40 + 101
    assert streams.points(rows.limit(0), ["x"]).count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(a, k, float(k)) for a, n in (("a", 25), ("b", 10)) for k in range(n)], "activity_id string, i bigint, x double")
    found = streams.points(rows, ["x"])
    got = {(r.activity_id, p): (r.pages, r.points, r.status, r.data[:1]) for p in (0, 1, 2, 3, 4) for r in streams.page(found, p, 10, "x").collect()}
    assert got["a", 3] == (3, 5, "ok", [20.0]) and got["a", 4] == (3, 0, "invalid_page", []) and got["a", 0] == (3, 0, "invalid_page", [])
    assert got["b", 1] == (1, 10, "ok", [0.0]) and got["b", 2][2] == "invalid_page"


def test_spoken(spark):
    row = spark.createDataFrame([("a", 0, 3725.0, 12345.678, 8.456, 41.123456789, -3.987654321, 4.26, 200.0)], "activity_id string, sample_idx int, t double, distance double, velocity_smooth double, lat double, lng double, grade double, watts double")
    r = streams.spoken(row).first()
    assert (r.clock, r.kilometres, r.kmh, r.latitude, r.longitude, r.grade, r.watts) == ("01:02:05", 12.35, 30.4, 41.123457, -3.987654, 4.3, 200.0)
    assert streams.spoken(row.select("activity_id", "sample_idx", "t")).columns == ["activity_id", "sample_idx", "seconds_from_start", "clock"]
    assert row.select(F.lit(1)).count() == 1
