"""License scans: merged diagonals, verified spans and odd rows."""

import pytest

from cadenza.llm import licenses

BSD = next(t for label, t in licenses.TEMPLATES if label == "bsd")


def scanned(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df, **options).collect()}


def test_neighbouring_diagonals(spark):
    words = BSD.split()
    more = " ".join([*words[:8], "of", "any", "kind", *words[8:]])  # three words more: two diagonals
    less = " ".join([*words[:8], *words[10:]])
    far = " ".join([*words[:10], *["filler"] * 9, *words[10:]])
    half = " ".join(words[:10])
    got = scanned(spark, list(enumerate((f"See. {BSD.upper()}!", more, less, far, half, "x " + BSD + " y " + BSD))))
    assert [[(m.label, m.start, m.end) for m in got[i].matches] for i in range(6)] == [
        [("bsd", 1, len(words))],
        [("bsd", 0, len(words) + 2)],
        [("bsd", 0, len(words) - 3)],
        [],
        [],
        [("bsd", 1, len(words)), ("bsd", len(words) + 2, 2 * len(words) + 1)],
    ]
    assert got[0].score == 1.0 and 0 < got[4].score < 0.8
    assert 0.8 <= got[1].matches[0].coverage <= 1.0


def test_phrases(spark):
    got = scanned(spark, [(1, "Under the MIT-License; under the mit license"), (2, "under the mit. license"), (3, "under mit the license"), (4, "CC BY-NCé cc by nc cc by nc")])
    spans = {k: [(m.start, m.end, m.label) for m in r.matches if m.exact] for k, r in got.items()}
    assert spans == {1: [(0, 3, "mit"), (4, 7, "mit")], 2: [(0, 3, "mit")], 3: [], 4: [(3, 5, "cc-by-nc"), (6, 8, "cc-by-nc")]}


def test_odd_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, "cc by nc"), (1, "cc by nc"), (2, "cc by"), (None, "cc by nc"), (3, "é" * 50_000 + " cc by nc " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, template int, words string, n int")
    got = licenses.scan(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, len(r.matches)) for r in got) == sorted(
        [("None", 0, 0), ("None", 0, 0), ("1", 0, 0), ("1", 3, 1), ("1", 3, 1), ("2", 2, 0), ("None", 3, 1), ("3", 60_001, 20_000)]
    )
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="needs 3 words"):
        licenses.scan(docs, phrases=(("a", "two words"),))


def test_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Python" not in plan
