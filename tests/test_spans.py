"""Slices by bins, the sweep over windows and recursive clean-up, against plain loops."""

import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cadenza.functions.scalars import sanitized
from cadenza.operators import align, profile


def test_slices(spark, monkeypatch):
    draw = random.Random(5)
    lengths = {"a": 700, "b": 1, "c": 257, "d": 256}
    samples = [(a, t, float(t), float(t % 9)) for a, n in lengths.items() for t in range(n)]
    cells = align.align(spark.createDataFrame(samples, "activity_id string, sample_idx int, t double, watts double"), ("watts",))
    spans = [(k, draw.choice([*lengths, "zz"]), lo, lo + draw.randrange(-3, 400)) for k, lo in enumerate(draw.randrange(-40, 760) for _ in range(300))]
    spans += [(900, "a", None, 5), (901, "a", 5, None), (902, "a", -(10**12), 10**12), (903, "a", 10**9, 10**12), (904, "a", 255, 256)]
    df = spark.createDataFrame(spans, "k int, activity_id string, from_i bigint, to_i bigint")
    got = {}
    for r in align.sliced(cells, df).select("k", "i", "offset", "watts").collect():
        got.setdefault(r.k, []).append((r.i, r.offset, r.watts))
    want = {}
    for k, a, lo, hi in spans:
        if lo is not None and hi is not None:
            inside = range(max(lo, 0), min(hi, lengths.get(a, 0) - 1) + 1)
            if inside:
                want[k] = [(i - inside[0], inside[0], float(i % 9)) for i in inside]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_slices_meet_by_bin(spark):
    """Spans of a few cells don't meet every cell of their activity."""
    cells = align.align(spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 60_000.0, 1.0)], "activity_id string, sample_idx int, t double, watts double"), ("watts",))
    spans = spark.range(2000).select(F.lit("a").alias("activity_id"), (F.col("id") * 30).alias("from_i"), (F.col("id") * 30 + 3).alias("to_i"))
    df = align.sliced(cells, spans)
    assert df.count() == 8000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "__bin" in next(line for line in plan.splitlines() if "Join" in line)


def plain_pairs(rows, order):
    out = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and None not in (a[0], a[2], b[2], a[3], b[3]) and a[1] in order and b[1] in order and order.index(a[1]) < order.index(b[1]):
                if a[3] <= (b[4] or date.max) and b[3] <= (a[4] or date.max) and a[2] >= b[2]:
                    out.append((a[0], *a[1:], *b[1:]))
    return sorted(map(str, out))


SCHEMA = "athlete_id int, metric string, value double, effective_from date, effective_to date"


@pytest.mark.parametrize("seed", range(4))
def test_sweep(spark, seed):
    draw, day = random.Random(seed), date(2024, 1, 1)
    rows = []
    for _ in range(250):
        start = day + timedelta(draw.randrange(60))
        end = draw.choice([None, start + timedelta(draw.randrange(-3, 25))])
        rows.append((draw.choice([1, 2, 3, None]), draw.choice([*profile.HEART_ORDER, "ftp_w"]), draw.choice([None, float(draw.randrange(80, 90))]), draw.choice([start] * 9 + [None]), end))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", source string").repartition(3)
    got = profile.order_violations(df, ["athlete_id"], profile.HEART_ORDER)
    assert got.columns == ["athlete_id", *[f"{c}_{s}" for s in "ab" for c in ("metric", "value", "effective_from", "effective_to")]]
    fine = [r for r in rows if r[4] is None or r[3] is None or r[4] >= r[3]]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_pairs(fine, profile.HEART_ORDER)
    assert profile.order_violations(df.limit(0), ["athlete_id"], profile.HEART_ORDER).count() == 0


def test_sweep_of_one_athlete_grows_with_entries(spark):
    """60,000 entries of one athlete, all in order: no pairs, and no squares."""
    k = F.col("id")
    start = F.date_add(F.lit("1900-01-01").cast("date"), k.cast("int"))
    metric = F.get(F.array(*map(F.lit, profile.HEART_ORDER)), (k % 3).cast("int"))
    rows = spark.range(60_000).select(F.lit(1).alias("athlete_id"), metric.alias("metric"), (k % 3 * 100 + k % 50).cast("double").alias("value"), start.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    began = time.time()
    assert profile.order_violations(rows, ["athlete_id"], profile.HEART_ORDER).count() == 0
    assert time.time() - began < 30


def walk(x, path, out):
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        out.append(f"{path}: {'NaN' if x != x else 'Infinity' if x > 0 else '-Infinity'}")
        return None
    if isinstance(x, dict):
        return {k: walk(v, f"{path}.{k}", out) for k, v in x.items()}
    if isinstance(x, list):
        return [walk(v, f"{path}[{k}]", out) for k, v in enumerate(x)]
    return x


def test_sanitized(spark):
    nan, inf = float("nan"), float("inf")
    schema = "a double, b float, n int, s string, x struct<d: double, l: array<struct<p: double, q: string>>, m: map<string, array<double>>>, plain array<int>, `odd.name` array<array<double>>"
    rows = [
        {"a": nan, "b": -inf, "n": 1, "s": "NaN", "x": {"d": inf, "l": [{"p": nan, "q": "u"}, {"p": 0.0, "q": None}], "m": {"k": [1.0, nan], "j": []}}, "plain": [1], "odd.name": [[nan], [], [2.0, -inf]]},
        {"a": 0.0, "b": None, "n": None, "s": None, "x": None, "plain": None, "odd.name": None},
        {"a": -0.5, "b": 2.0, "n": 2, "s": "", "x": {"d": None, "l": None, "m": None}, "plain": [], "odd.name": [None, [None]]},
        {"a": 1.0, "b": 1.0, "n": 3, "s": "x", "x": {"d": 1.0, "l": [None], "m": {}}, "plain": [None], "odd.name": []},
    ]
    df = spark.createDataFrame(rows, schema)
    got = sanitized(df).collect()
    for row, r in zip(rows, got, strict=True):
        paths = []
        want = {k: walk(v, k, paths) for k, v in row.items()}
        seen = r.asDict(recursive=True)
        assert sorted(seen.pop("changed")) == sorted(paths) and seen == want
    assert sanitized(df).drop("changed").schema.simpleString() == df.schema.simpleString()
    assert sanitized(spark.createDataFrame([(1,)], "n int")).first().changed == []
    assert sanitized(df.limit(0)).count() == 0
