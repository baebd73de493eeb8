"""Corpus operators against SQL, brute force and edge cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import bpe, jaccard, lines, mix, pii, quality
from cadenza.llm.queries import ORACLES, QUERIES
from tests.oracle import check

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    check(spark, QUERIES[name], ORACLES[name], SMALL)


def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark):
    library, got = encoding(), {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, SMALL).collect()}
    for doc_id, text in texts(spark):
        ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert (got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_cases(spark):
    odd = ["", "a", "  two  spaces ", "\n\n\t x\r\n", "z" * 5000, "日本語 ünï \U0001f600", "\0a b\0", "x " * 3000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(odd)] + [(0, None, 1), (None, "a", 2)], "doc_id long, text string, n_tokens int")
    ranks, library = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), encoding()
    rows = bpe.decode(bpe.encode(docs, ranks, P.PATTERN), ranks).collect()
    assert sorted(map(str, rows)) == sorted(map(str, bpe.encode(docs, ranks, P.PATTERN, with_decoded=True).collect()))
    assert sorted(r.decoded for r in rows) == sorted([t.encode() for t in odd] + [b"", b"a"])
    assert all(np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.decoded.decode()) for r in rows)


def test_token_files(spark):
    library, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, SMALL).collect()}
    for doc_id, text in texts(spark):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(got[doc_id])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_fingerprints(spark):
    rows = texts(spark)[::-1]
    got = {r.doc_id: r for r in QUERIES["op5_scaled_sketch"](spark, SMALL).collect()}
    for (doc_id, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[doc_id].n_chars, got[doc_id].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_jaccard(spark):
    rows, got = texts(spark), {r.doc_id: r for r in QUERIES["op1_jaccard_join"](spark, SMALL).collect()}
    sets = [(d, shingle_set(t)) for d, t in rows]
    near = {d: [e for e, b in sets if e != d and (a == b or len(a & b) >= 0.8 * len(a | b))] for d, a in sets}
    assert {d: r.n_links for d, r in got.items()} == {d: len(x) for d, x in near.items()}
    least = {d: d for d in near}
    for _ in near:
        least = {d: min([least[d], *(least[e] for e in near[d])]) for d in near}
    assert {d: r.class_id for d, r in got.items()} == least


def forms(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 9 <= len(d) <= 15 if kind == "phone" else True

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, text) if fits(k, m[0]))


def test_pii(spark):
    odd = ["a@b.c_d@e.f x@y..z", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (269) 555-3296 +12 +1 ( 2 3) 4567 89", "é\U0001f600 me@ex.org", "", "a" * 20000 + "@" + ".b" * 3000]
    more = [f"please contact me at user{i}@mail.example.com today" for i in range(6)] + ["please contact me at user(at)host99887 today", "version 12.5.77 at 1234567 units"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd + more)] + [(3, None, "x"), (None, odd[0], "x")], "doc_id long, text string, spans string")
    out = pii.personal_data(docs).select("doc_id", pii.as_text(F.col("base")).alias("base"), pii.as_text(F.col("spans")).alias("spans")).collect()
    got = {r.doc_id: r for r in out if r.doc_id != 3 or r.base}
    assert len(out) == len(odd + more) + 2
    assert [got[i].base for i in range(len(odd + more))] == [forms(t) for t in odd + more]
    found = len(odd) + 6
    assert got[found].spans == "email:21:38" and got[found + 1].spans == ""


def test_lines(spark):
    rows = [(i, f"own{'x' * i} words of this document\nThis page was printed on day {i} by {i * 7}\nshort") for i in range(4)]
    rows += [(10, "A share of words"), (11, ""), (12, None), (None, "own"), (10, "A share of words")]
    out = lines.drop_lines(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, pos int")).collect()
    got = sorted((r.doc_id, r.text) for r in out if r.doc_id is not None and r.text is not None)
    assert [t for d, t in got if d == 0] == [rows[0][1]]
    assert [t for d, t in got if d == 3] == ["ownxxx words of this document"]
    assert [t for d, t in got if d == 10] == ["A share of words"] * 2 and len(out) == len(rows)
    assert lines.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_passages(spark):
    verse = "\n".join(f"{w} words of the verse that is found twice" for w in "one two three four five six seven".split())
    lone = "a single line of the two"
    rows = [(i, f"own{'x' * i} line of this document\nLes.\nAnd ornd.\n{100 + i}") for i in range(3)]
    rows += [(7, f"heading seven here\n{verse}\nend of seven"), (8, f"a start of eight\n{verse.replace(chr(10), chr(10) * 2)}\n\nand then\n{lone}"), (9, f"some text\n{lone}")]
    out = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    got = {r.doc_id: r.text for r in out}
    assert got[0] == rows[0][1] and got[7] == rows[3][1] and got[9] == rows[5][1]
    assert got[1] == "ownx line of this document\n101" and got[2] == "ownxx line of this document\n102"
    assert [t for t in got[8].split("\n") if t] == ["a start of eight", "and then", lone]


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (2, "x " * 50000, 0.0)], "doc_id long, text string, score double")
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, model).collect())
    rows = quality.scored(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows]) >= 0.85
    assert quality.scored(docs.limit(0), model).count() == 0


def test_pipeline(spark):
    """Each stage keeps the columns of documents, and its rows are among its predecessor's."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_one_of_each(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (3, words + " more"), (9, "other text"), (9, "other text"), (None, None), (None, "")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [3, 9]


def test_one_of_each_without_ids(spark):
    """Copies without an id go if their group has one, else one stays; a repeated id doesn't keep another group's text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (None, a + " more"), (None, b), (None, b + " more"), (None, b), (1, b + " less"), (2, c), (2, c + " more"), (None, "alone"), (None, "alone")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted((r.doc_id or 0, r.text[:1], r.text) for r in out)
    assert [t[:2] for t in texts] == [(0, "a"), (1, "a"), (1, "b"), (2, "c")] and texts[0][2] == "alone"
    ids = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ids) == sorted([(1, 1, 1), (0, 1, 1), *[(0, 1, 3)] * 3, (1, 1, 3), (2, 2, 1), (2, 2, 1), (0, 0, 1), (0, 0, 1)])


def test_mix_cuts_one(spark):
    """Rows that share a doc_id, or have none, are drawn whole but for one of a source."""
    words = lambda n, x: " ".join(f"{x}{i}" for i in range(n))
    rows = [(None, words(7 + i % 5, f"t{i % 30}x"), "a") for i in range(90)] + [(3, words(9, f"u{i}x"), "b") for i in range(40)] + [(i, words(50, "v"), "c") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix.mix(docs).collect()
    whole = {(r[2], r[1]) for r in rows}
    cut = [r.source for r in out if (r.source, r.text) not in whole]
    assert cut and len(cut) == len(set(cut))
    goal = {r.src[1:]: int(r.target) for r in mix.targets(mix.sized(docs)).collect()}
    assert {s: sum(len(r.text.split()) for r in out if r.source == s) for s in goal} == goal
