"""The store of aligned cells: incremental fills, plans without an exchange, removal; and running cut-offs."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cadenza.operators import align, power, records
from cadenza.sources.store import CellStore, types_key

SIGNALS = ("watts", "heartrate")
SCHEMA = "activity_id string, sample_idx int, t double, watts double, heartrate double, moving boolean, extra int"


def samples(spark, activities, seconds=50, watts=100.0):
    return spark.createDataFrame([(a, t, float(t + (t > 20) * 2), watts + t, None if t % 3 else 120.0, t % 5 > 0, 1) for a in activities for t in range(seconds)], SCHEMA)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_fills(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=4)
    assert store.cells().count() == 0
    first = samples(spark, ["a", "b", "c"])
    assert sorted(r.activity_id for r in store.fill(first).collect()) == ["a", "b", "c"]
    assert store.fill(first.orderBy(F.desc("sample_idx"))).count() == 0  # whatever the order of rows
    second = samples(spark, ["b", "c"]).union(samples(spark, ["d"], 70)).union(samples(spark, ["a"], watts=7.0))
    assert sorted((r.activity_id, r.cells) for r in store.fill(second).collect()) == [("a", 52), ("d", 72)]
    assert rows_of(store.cells()) == rows_of(align.align(second, SIGNALS, moving=True).select(*store.kept.names))
    # only the new cells were written: b and c are still those of the first fill
    assert store.index().select("fill").distinct().count() == 2
    other = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=4)
    assert other.cells().count() == store.cells().count()
    assert CellStore(spark, f"file://{tmp_path}", ("watts",), buckets=4).cells().count() == 0  # other signals, another entry
    other.forget(spark.createDataFrame([("a",), ("zz",)], "activity_id string"))
    assert {r.activity_id for r in store.cells().select("activity_id").distinct().collect()} == {"b", "c", "d"}
    assert [r.activity_id for r in store.fill(second).collect()] == ["a"]


def test_a_broken_fill_leaves_nothing(spark, tmp_path, monkeypatch):
    store = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=4)
    store.fill(samples(spark, ["a"]))
    append, calls = CellStore._append, []

    def broken(self, df, kind, order):
        calls.append(kind)
        if kind == "index":
            raise OSError("lost")
        append(self, df, kind, order)

    monkeypatch.setattr(CellStore, "_append", broken)
    with pytest.raises(OSError, match="lost"):
        store.fill(samples(spark, ["a", "b"], 60))
    monkeypatch.undo()
    assert calls == ["cells", "index"] and store.cells().count() == 52
    store.fill(samples(spark, ["a", "b"], 60))
    assert store.cells().count() == 2 * 62


def test_plan(spark, tmp_path):
    """Cells are read without a shuffle, also by what groups or windows them by activity."""
    store = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=4)
    store.fill(samples(spark, ["a", "b"]))
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.cells(), power.power_metrics(store.cells(), F.lit(100.0), F.lit(70.0))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)


def test_trim(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=4)
    for a in "abc":
        store.fill(samples(spark, [a]))
    store.trim(most=10, most_bytes=2 * 52 * 16)
    assert {r.activity_id for r in store.index().collect()} == {"b", "c"}
    store.trim(most=1)
    assert {r.activity_id for r in store.index().collect()} == {"c"}


def test_too_long_is_noted(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}", SIGNALS, buckets=2)
    long = spark.createDataFrame([("x", 0, 0.0, 1.0, None, True, 1), ("x", 1, 90_000.0, 1.0, None, True, 1)], SCHEMA)
    assert [(r.activity_id, r.cells) for r in store.fill(long).collect()] == [("x", 0)]
    assert store.fill(long).count() == 0 and store.cells().count() == 0


def test_types_key(spark):
    from cadenza.functions.scalars import types_key as column

    assert spark.range(1).select(column(F.array(*map(F.lit, SIGNALS)))).first()[0] == types_key(SIGNALS)


def plainly(rows, most, limit):
    out, total = [], 0
    for at, (day, size, name) in enumerate(sorted(rows, key=lambda r: (r[0] is None, -(r[0].toordinal()) if r[0] else 0, r[2]))):
        total += size or 0
        if (most is None or at < most) and total <= limit:
            out.append(name)
    return sorted(out)


@pytest.mark.parametrize("most", [None, 7, 1000])
@pytest.mark.parametrize("limit", [0, 50, 2500, 10**9])
def test_kept_newest(spark, most, limit):
    draw = random.Random(limit + (most or 0))
    rows = [(draw.choice([date(2024, 1, 1), date(2024, 1, 1 + draw.randrange(20)), None]), draw.choice([None, 0, draw.randrange(40)]), f"n{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "day date, size int, name string").repartition(5)
    got = records.kept_newest(df, F.col("day"), F.col("size"), "name", most, limit)
    assert got.columns == ["day", "size", "name"] and sorted(r.name for r in got.collect()) == plainly(rows, most, limit)


def test_kept_newest_plan(spark):
    df = spark.range(1000).select(F.col("id").alias("name"), F.lit(1).alias("size"))
    plan = records.kept_newest(df, F.col("name"), F.col("size"), "name", None, 100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and records.kept_newest(df.limit(0), F.col("name"), F.col("size"), "name", None, 100).count() == 0
