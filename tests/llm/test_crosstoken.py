"""Alignment of two tokenizers against whole texts and plain counting."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import crosstoken

VOCABULARY = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
MODEL = open(P.path("piece_bpe_32k.model"), "rb").read()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plainly(rows, kind="ends"):
    """Each row of the result by whole texts and loops."""
    a, b = Tokenizer.from_str(VOCABULARY), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    a.encode_special_tokens = True
    signs = crosstoken.byte_signs()
    found = []
    for doc_id, text in rows:
        text, links, groups = text or "", [], []
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        spelt_x = [bytes(signs[c] for c in a.id_to_token(i)) for i in x]
        spelt_y = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(spelt_x) != (" " + text).encode() or b"".join(spelt_y) != (" " + text).encode():
            x, y = [], []
        spans = []
        for ids, spelt in ((x, spelt_x), (y, spelt_y)):
            ends = list(itertools.accumulate(map(len, spelt[: len(ids)])))
            spans.append(list(zip(ids, [0, *ends], ends, strict=False)))
        both = {e for *_, e in spans[0]} & {e for *_, e in spans[1]}
        for lo, hi in itertools.pairwise([0, *sorted(both)]):
            inside = [[i for i, _, e in s if lo < e <= hi] for s in spans]
            groups.append("|".join(",".join(map(str, ids)) for ids in inside))
            if kind == "products":
                links += itertools.product(*inside)
        for i, s, e in spans[0]:
            links += [(i, j) for j, t, f in spans[1] if kind == "ends" and e == f or kind == "overlaps" and max(s, t) < min(e, f)]
        found.append((doc_id, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    counts = Counter(p for *_, links, _ in found for p in links)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return sorted(map(str, [(d, n_a, n_b, g, len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), h) for d, n_a, n_b, g, ls, h in found]))


def aligned(spark, rows, kind="ends"):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lot int, pair int").repartition(3)
    return sorted(str(tuple(r)) for r in crosstoken.align(docs, VOCABULARY, MODEL, kind).select(*COLUMNS).collect())


ODD = [
    "", None, "a", " ", "  ", "a ", " a", "  two  spaces ", "\n", "\n\n\t x\r\n", "a\nb", "a \n b", "tab\tand\x0bVT\x0cFF", "x\x1cy \x1c z", "nul\0 \0a", "　wide　space", "\xa0hard\xa0space",
    "thin space  line", "日本語 ünï \U0001f600\U0001f600", "mark ▁ here", "▁", "<s> hi </s> <unk> <|endoftext|> <0x0A>", "don't can't  we'll", "z" * 3000, "1234567 89,0.5", "é é", "ab" * 500 + " ab", "x " * 500,
]


@pytest.mark.parametrize("kind", crosstoken.LINKS)
def test_odd_texts(spark, kind):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, "a b"), (3, "a b"), (3, "  ")]
    if kind == "overlaps":  # loops over pairs of tokens
        rows = [r for r in rows if len(r[1] or "") < 600]
    assert aligned(spark, rows, kind) == plainly(rows, kind)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 6000]
    assert aligned(spark, rows) == plainly(rows)


def test_small_lots(spark, monkeypatch):
    """Lots and forgotten units don't change results."""
    own = crosstoken.Aligner(VOCABULARY, MODEL, "ends")
    rows = [(i, f"text {i % 7} of {i}") for i in range(300)]

    def lots(most):
        monkeypatch.setattr(crosstoken, "aligner", lambda *_: own)
        monkeypatch.setattr(crosstoken, "LOT_BYTES", most)
        monkeypatch.setattr(crosstoken, "KNOWN_UNITS", most)
        monkeypatch.setattr(crosstoken.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
        own.clear()
        batch = crosstoken.pa.record_batch([[r[0] for r in rows], [r[1] for r in rows]], names=["doc_id", "text"])
        out = [b.to_pylist()[0] for b in crosstoken.lots(iter([batch]), VOCABULARY, MODEL, "ends")]
        total = Counter()
        for lot in out:
            total.update(dict(zip(lot["pair"], lot["times"], strict=True)))
        docs = [x for lot in out for x in zip(*(lot[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "hash")), strict=True)]
        return len({lot["lot"] for lot in out}), total, docs

    few, many = lots(1 << 20), lots(200)
    assert (few[0], many[0]) == (1, 6) and few[1:] == many[1:]


def test_intervals():
    a, b, closes = crosstoken.intervals(np.array([2, 5, 6]), np.array([1, 5, 6]))
    assert (a.tolist(), b.tolist(), closes.tolist()) == ([0, 0, 1, 2], [0, 1, 1, 2], [False, False, True, True])
    assert [list(zip(*map(list, crosstoken.linked(a, b, closes, k)), strict=True)) for k in ("ends", "products")] == [[(1, 1), (2, 2)], [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]]
    with pytest.raises(ValueError, match="links are"):
        crosstoken.linked(a, b, closes, "none")


def test_groups_and_empty(spark):
    docs = spark.createDataFrame([(1, "hello wörld"), (2, None)], "doc_id long, text string")
    one, none = sorted(crosstoken.groups(docs, VOCABULARY, MODEL).collect())
    assert (sum(g.a for g in one.groups), sum(g.b for g in one.groups), one.groups[-1].end) == (len(one.a_ids), len(one.b_ids), len(" hello wörld".encode()))
    assert (none.a_ids, none.groups) == ([], [])
    assert crosstoken.align(docs.limit(0), VOCABULARY, MODEL).count() == 0
    bare = spark.createDataFrame([(1, ""), (2, None), (None, "▁")], "doc_id long, text string")  # a lot without links
    assert {tuple(r)[1:] for r in crosstoken.align(bare, VOCABULARY, MODEL).collect()} == {(0, 0, 0, 0, 0, 0, "")}
