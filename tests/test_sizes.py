"""What a task takes doesn't grow with the tables: series are dealt by their samples, windows stay in their rows, fills digest once."""

import pytest

from cadenza.functions import ordered
from cadenza.operators import align, climbs, history
from cadenza.plans.registry import QUERIES
from cadenza.sources.events import samples
from cadenza.sources.store import CellStore
from tests.oracle import spark_rows

SMALL = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["climb_segments", "stream_page"])
def test_series_are_dealt_by_samples(spark, monkeypatch, name):
    want = spark_rows(QUERIES[name](spark, SMALL))
    assert "REPARTITION_BY_NUM" not in plan(samples(spark, SMALL, "rides"))  # an even share is small enough
    monkeypatch.setattr(ordered, "TASK_SAMPLES", 400)
    rows = samples(spark, SMALL, "rides")
    assert rows.rdd.getNumPartitions() == 25  # 10,000 samples
    cells = climbs.marked(align.align(rows))
    assert plan(cells).count("Exchange hashpartitioning") == 1 and cells.rdd.getNumPartitions() == 25
    assert spark_rows(QUERIES[name](spark, SMALL)) == want


def test_tasks(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ordered, "TASK_SAMPLES", 10)
    assert [ordered.tasks_for(spark, n) for n in (0, 10 * cores)] == [0, 0]
    assert ordered.tasks_for(spark, 10 * cores + 1) == max(cores + 1, 8) and ordered.tasks_for(spark, 100_001) == 10_001


def test_windows_stay_in_their_row(spark):
    """A row for each window would carry the series' arrays through a sort."""
    sums = spark.createDataFrame([("a", list(range(0, 50_000_000, 1_000_000)), list(range(50)))], "activity_id string, sums array<bigint>, valid array<bigint>")
    wanted = spark.createDataFrame([("a", [7, 7, 49, 50, 0, None])], "activity_id string, durations array<bigint>")
    best = history.best_over(sums, wanted)
    assert plan(best).count("Generate ") == 1 and "Aggregate" not in plan(best)
    assert sorted(tuple(r) for r in best.collect()) == [("a", 7, 1.0, 0, 6), ("a", 49, 1.0, 0, 48)]


def test_a_fill_digests_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "activity_id string, sample_idx int, t double, watts double, moving boolean"
    rows = spark.createDataFrame([(a, t, float(t), 1.0, True) for a in "ab" for t in range(50)], schema).mapInArrow(counted, schema)
    store = CellStore(spark, f"file://{tmp_path}", ("watts",), buckets=4)
    assert sorted((r.activity_id, r.cells) for r in store.fill(rows).collect()) == [("a", 50), ("b", 50)]
    assert read.value == 200  # the digest and the alignment
