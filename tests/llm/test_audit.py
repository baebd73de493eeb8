"""Filter audits against a plain reckoning, and odd rows."""

from itertools import permutations

from cadenza.llm import audit


def plainly(docs, labels):
    """All rows by brute force; docs are (doc_id, text, source), labels (doc_id, quality, toxic)."""
    docs = [(d, t or "", s or "") for d, t, s in docs]
    words = lambda t: t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    smaller = lambda a, b: a is not None and (b is None or a < b)

    def fails(d, t):
        w = [x for x in words(t) if x]
        bad = {k for k, x in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)), ("D", any(c in "#$%&*|" for c in t))) if x}
        return bad | ({"E"} if any(u == t and smaller(e, d) for e, u, _ in docs) else set())

    bad = [(d, s, fails(d, t)) for d, t, s in docs]
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    rows, shapley = {}, {}
    for part in {s for _, s, _ in bad}:
        mine = [(d, b) for d, s, b in bad if s == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                earlier, gone = set(order[:step]), lambda x: any(k in x for k in order[:step])  # noqa: B023
                out = [d for d, b in mine if f in b and not b & earlier]
                rows[part, order, step + 1] = (
                    sum(not b & (earlier | {f}) for _, b in mine), len(out), sum(f in b and gone(b) for _, b in mine),
                    sum(b == {f} for _, b in mine), sum(d in good for d in out), sum(d in toxic for d in out),
                )
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def audited(spark, docs, labels):
    docs = spark.createDataFrame([(*r, 9, 9) for r in docs], "doc_id long, text string, source string, part int, mask int").repartition(3)
    return audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, LONG, "a"), (1, LONG, "a"), (1, LONG, "b"), (2, LONG, "a"), (None, LONG, None), (None, LONG, ""), (3, "x " * 70, "a"), (4, "X# " * 70, "a"), (4, "X# " * 70, None),
    (None, "lost", "c"), (None, "lost", "c"), (5, None, "c"), (6, "", "c"), (7, "é\x1c" * 30 + LONG.upper(), "c"), (8, LONG + " $", "c"), (9, "\x0b".join(f"v{i}" for i in range(50)), "c"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (6, 1, 0), (None, 1, 1), (8, 0, 1), (77, 1, 1), (3, None, None)]


def test_against_plain(spark):
    got = audited(spark, ROWS, MARKS).collect()
    assert len(got) == len(set(got)) == 600 * len({s or "" for _, _, s in ROWS})
    assert set(map(tuple, got)) == plainly(ROWS, MARKS)


def test_empty(spark):
    assert audited(spark, [], MARKS).count() == 0
    assert {tuple(r)[7:9] for r in audited(spark, ROWS, []).collect()} == {(0, 0)}


def test_chains_of_one_fingerprint():
    """Different texts under one fingerprint stay apart; the least id is found whatever the order."""
    for ids in permutations([3, None, 1]):
        chains = audit.Chains()
        for i in ids:
            chains.add(5, b"one", i, 0, {"p": 1})
            chains.add(5, b"two", 7, 0, {"p": 1})
        assert sorted((e[0], e[1], sum(e[3].values())) for _, e in chains.entries()) == [(b"one", 1, 1), (b"two", 7, 3)]
        assert chains.copies == {(3, "p", audit.COPY): 1, (None, "p", audit.COPY): 1}


def test_copies_are_counted_before_the_shuffle(monkeypatch):
    rows = [(i, "same text", "p") for i in range(5000)]
    assert sum(v[0] is not None for _, v in audit.route(iter(rows))) == 1
    monkeypatch.setattr(audit, "CHAIN_BYTES", 20)
    routed = list(audit.route(iter([(i, f"text {i // 2}", "p") for i in range(1000)])))
    found = list(audit.judged(iter(routed)))
    assert sum(n for *_, n in found) == 1000 and sorted(d for d, _, m, _ in found if m & audit.COPY) == list(range(1, 1000, 2))
