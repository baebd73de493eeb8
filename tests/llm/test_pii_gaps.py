"""Candidates between base spans, in time that follows the text's length."""

import random
import time

from cadenza.llm import pii


def candidates(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.found(df).collect()}


def test_after_a_base_span(spark):
    texts = {
        "mail a@b.cd 5551234 now": ["5551234"],
        "ip 10.0.0.1 77 888 999 and 10.0.0.2 x": ["77 888 999"],
        "+44 20 7946 0958 id: 98765": ["98765"],
        "é a@b.cd;55512345 end": ["55512345"],
        "user@10.0.0.1 x1234 y": ["x1234"],
        "4111 1111 1111 1111 a12345": ["a12345"],
        "no spans 12345 or 1234 5678": ["12345", "1234 5678"],
        "a@b.cd": [],
        "": [],
    }
    got = candidates(spark, texts)
    for i, (text, want) in enumerate(texts.items()):
        assert [x.m for x in got[i].other] == want
        assert all(text[x.s : x.e] == x.m for x in got[i].other)


def test_no_candidate_meets_a_base_span(spark):
    draw = random.Random(2)
    parts = ["a@b.cd", "10.0.0.1", "4111 1111 1111 1111", "+1 (20) 555-0199 22", "12", "9 8 7", "x1", "=", ":", " ", " ", ",", "é", "300.1.2.3", "\n", "key=4444", ""]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 40))) for _ in range(150)]
    for i, r in candidates(spark, texts).items():
        base = [(x.s, x.e) for k in pii.BASE for x in r[k]]
        assert all(texts[i][x.s : x.e] == x.m for x in r.other)
        assert not any(s < x.e and x.s < e for x in r.other for s, e in base)


def test_words_about_a_masked_span_make_no_pattern(spark):
    got = candidates(spark, ["pay a@b.cd code: 5551234 now", "one two 5551234 now"])
    df = spark.createDataFrame([(k, got[k].other[0].c, got[k].other[0].r) for k in (0, 1)], "k int, c string, r string")
    found = {r.k: sorted(r.p) for r in df.select("k", pii.patterns(df.c, df.r).alias("p")).collect()}
    assert found == {0: ["1 code:", "b code: now"], 1: ["2 one two", "b two now"]}


def test_long_contact_lists(spark):
    """Twice the pairs take about twice the time, not four times."""
    took = []
    for n in (100, 8000, 16_000):
        text = " ".join(f"n{i} a{i}@b.cd x{i}y" for i in range(n))
        began = time.time()
        assert len(candidates(spark, [text])[0].other) >= 1.9 * n - 300
        took.append(time.time() - began)
    assert took[2] < 15
