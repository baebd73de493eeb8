"""Live series give the cells that align() gives, whatever the order in which their samples arrive."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from cadenza.operators import align
from cadenza.streaming.alignment import Series, aligned_stream

SIGNALS = ("watts", "heartrate")
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def recorded(seed, n=120):
    """Samples with gaps, times that don't advance, absent values, and a signal that begins late."""
    draw, rows = random.Random(seed), []
    for a in ("a", "b", "late"):
        t = draw.randrange(5)
        for k in range(n):
            t += draw.choice([1, 1, 1, 2, 4, 5, 9, 0, -1])
            hr = None if draw.random() < 0.4 or (a == "late" and k < n // 2) else 100.0 + draw.randrange(50)
            rows.append({"activity_id": a, "sample_idx": k, "t": t + draw.choice([0.0, 0.25, -0.25]), "watts": None if draw.random() < 0.2 else float(draw.randrange(300)), "heartrate": hr})
    return rows


def at(row):
    return START + timedelta(seconds=row["sample_idx"])


COLUMNS = ["activity_id", "i", "offset", "valid", "gap", *SIGNALS, *[f"known_{s}" for s in SIGNALS]]


def whole(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in ("activity_id", "sample_idx", "t", *SIGNALS)) for r in rows], "activity_id string, sample_idx int, t double, watts double, heartrate double")
    return sorted(map(tuple, align.align(df, SIGNALS).select(*COLUMNS).collect()))


@pytest.mark.parametrize("seed", range(30))
def test_settled_cells_never_change(seed):
    """Samples taken in one by one, or in any lots, give the same cells as all at once, each cell once."""
    rows = [r for r in recorded(seed) if r["activity_id"] != "b"]
    for a in ("a", "late"):
        mine = [r for r in rows if r["activity_id"] == a]

        def run(lots, mine=mine):
            series, out = Series(SIGNALS, 3), []
            for lot in lots:
                for r in lot:
                    series.add(float(r["sample_idx"]), r["sample_idx"], r["t"], [r[s] for s in SIGNALS])
                series.settle(float(max(x["sample_idx"] for x in lot)))
                out += series.cells(False)
                series = Series(SIGNALS, 3, series.saved())
            series.settle(None)
            return out + series.cells(True), out

        once, _ = run([mine])
        single, early = run([[r] for r in mine])
        assert single == once and [c[0] for c in once] == list(range(len(once)))
        assert len(early) > 0.8 * len(once) if a == "a" else len(early) > 0


@pytest.mark.parametrize("order", ["in order", "shuffled", "in lots"])
def test_same_cells(spark, tmp_path, order):
    rows = recorded(7, 60)
    rows.sort(key=lambda r: r["sample_idx"])
    lots = [rows] if order == "in order" else [rows[k : k + 24] for k in range(0, len(rows), 24)]
    if order == "shuffled":  # within the allowed lateness
        draw = random.Random(1)
        shuffled = sorted(rows, key=lambda r: r["sample_idx"] + draw.uniform(0, 9))
        lots = [shuffled[k : k + 24] for k in range(0, len(rows), 24)]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("activity_id string, at timestamp, sample_idx int, t double, watts double, heartrate double").json(str(source))
    name = "cells_" + order.replace(" ", "_")
    run = aligned_stream(stream, SIGNALS, "10 seconds", quiet=30).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        # samples of other series move the watermark on
        end = [{"activity_id": f"end{k}", "sample_idx": 500 + 100 * k, "t": 0.0, "watts": 1.0, "heartrate": 1.0} for k in range(3)]
        for k, lot in enumerate([*lots, *[[e] for e in end]]):
            (source / f"{k:03d}.json").write_text("\n".join(json.dumps({**r, "at": at(r).isoformat()}) for r in lot))
            run.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table(name).select(*COLUMNS).where("activity_id not like 'end%'").collect())
        assert got == whole(spark, rows)
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # only the last ones are still open
    finally:
        run.stop()
