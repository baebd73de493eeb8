"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every corpus operator and stage."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import binary, bpe, common, components, fingerprint, jaccard, lines, mix, pii, quality, topk, urls

SMALL = "/root/testdata/sf0.001"
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"word{i % 977} stands here" for i in range(40_000))
DOCS = "doc_id long, text string, source string, class string, key string, score double, pos int, taken long"


def rows_of(*texts):
    """Texts with ids from 0, then a null text, a text without an id, a repeated row and one id with two texts."""
    base = [(i, t) for i, t in enumerate(texts)]
    more = [(900, None), (None, texts[0]), (None, None), base[0], (1, "another text of the same id")]
    return [(d, t, "s", "c", "k", 0.5, 1, 2) for d, t in base + more]


@pytest.fixture(scope="module")
def docs(spark):
    odd = ["plain words of a text", "", " \n\t\r\n ", "é\U0001f600 日本語", "a\0b", LONG, "x" * 30_000, "same words here now and then", "same words here now and then"]
    return spark.createDataFrame(rows_of(*odd), DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages(spark, docs, empty, stage):
    """Stages keep the columns, whatever their names, make nothing up, and take empty tables."""
    name, f = stage
    out = f(spark, docs, SMALL).collect()
    none = f(spark, empty, SMALL)
    assert none.count() == 0
    if name == "encode":
        assert len(out) == docs.count()
        return
    assert none.columns == docs.columns
    given = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in out} <= given and all(r.key == "k" and r["class"] == "c" and r.taken == 2 for r in out)


def test_jaccard_cases(spark, docs, empty):
    out = jaccard.jaccard_join(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.class_id, r.copy_of, r.n_links))
    assert len(out) == docs.count() and jaccard.jaccard_join(empty).count() == 0
    # empty, blank and null texts are copies of each other: two empty ones, two null ones
    assert by[1][0][:2] == (1, 1) and by[2] == by[900] == [(1, 1, 3)]
    assert by[7] == by[8] == [(7, 7, 1)] and by[0] == [(0, 0, 2)] * 2


def test_jaccard_brute_force(spark):
    """One group of near copies that fills several blocks, chains of lesser likeness, and texts of one shingle."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(700):
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            words[at] = f"n{rng.integers(0, 5)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:n]) for n in range(1, 120, 3)] + ["one two three"] * 3 + ["one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_join(df).collect()}
    sets = []
    for t in texts:
        w = t.split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    kinds = Counter(sets)
    links = {a: sum(n for b, n in kinds.items() if 5 * len(a & b) >= 4 * len(a | b)) - 1 for a in kinds}
    assert got == {i: links[s] for i, s in enumerate(sets)}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(0, i) for i in range(1, 400)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (250, 2))] + [(5, 5), (None, 3), (7, None)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    group = {n: n for e in edges for n in e if n is not None}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            group[b] = a
    linked = {n for a, b in edges if a is not None and b is not None and a != b for n in (a, b)}
    assert out == {n: root(n) for n in linked}


def test_bpe_pieces():
    """Cutting where no token reaches across changes no ids; a long run goes by the heap."""
    ranks = bpe.read_ranks(VOCABULARY)
    rank = {w: i for i, w in enumerate(ranks)}
    cut = bpe.Cutter(ranks)
    words = [b"a", b"internationalisation", b"zqxjkv" * 9, "日本語の文章".encode(), b"=" * 50, bytes(range(256))]
    flat, ends, n = cut(words)
    pieces = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    assert flat == b"".join(words) and len(n) == len(words) and n.sum() == len(pieces)
    at = 0
    for w, k in zip(words, n, strict=True):
        assert bpe.merge(w, rank) == [i for p in pieces[at : at + k] for i in bpe.merge(p, rank)]
        at += k
    assert cut([])[2].tolist() == []


def test_bpe_rows_of_words():
    """Rows of words have no null lists, which Spark would walk again for every row of a batch."""
    docs = pa.record_batch([pa.array([1, None], pa.int64()), pa.array(["some words " * 3, "z" * 2000])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(bpe.chunks(iter([docs]), P.PATTERN, bpe.read_ranks(VOCABULARY)))
    assert rows.num_rows > 2 and [rows[c].null_count for c in ("doc_id", "n")] == [0, 0]
    assert [x for x in rows["doc_id"].to_pylist() if x] == [[1, None]]


def test_bpe_forgets(monkeypatch):
    """Forgotten units are split again, but their pieces aren't folded again; forgotten pieces are."""
    ranks = bpe.read_ranks(VOCABULARY)
    rank = {w: i for i, w in enumerate(ranks)}
    texts = [f"internationalisation of {chr(97 + i % 20) * 7}zqx\nstatistische {i % 3}" for i in range(60)] + ["", "  odd  one "]
    docs = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(bpe, "LOT_CHARS", 100)
    monkeypatch.setattr(bpe, "KNOWN_UNITS", 6)
    for most, turns in ((1000, 1), (20, 2)):
        monkeypatch.setattr(bpe, "KNOWN_PIECES", most)
        rows = pa.Table.from_batches(bpe.chunks(iter([docs]), P.PATTERN, ranks)).combine_chunks().to_batches()[0]
        words = [(t, w) for t, w in zip(rows["turn"].to_pylist(), rows["word"].to_pylist(), strict=True) if w]
        assert len(set(rows["unit_turn"].to_pylist())) > 5 and len(words) == len(set(words))
        assert (len(set(rows["turn"].to_pylist())) >= turns) and (turns > 1 or len({w for _, w in words}) == len(words))
        ids = pa.array([bpe.merge(w, rank) if w else None for w in rows["word"].to_pylist()], pa.list_(pa.int32()))
        parts = rows.append_column("ids", ids)
        for step in (1, 7, rows.num_rows):
            out = pa.Table.from_batches(bpe.spell(parts.slice(i, step) for i in range(0, rows.num_rows, step)))
            assert out["doc_id"].to_pylist() == docs["doc_id"].to_pylist()
            assert [b"".join(ranks[i] for i in np.frombuffer(x, "<u4")).decode() for x in out["ids"].to_pylist()] == texts


def test_bpe_empty(spark, docs, empty):
    ranks = bpe.read_ranks(VOCABULARY)
    assert bpe.encode(empty, ranks, P.PATTERN, with_decoded=True).count() == 0
    out = bpe.encode(docs, ranks, P.PATTERN, with_decoded=True).collect()
    assert Counter(r.decoded for r in out) == Counter((r.text or "").encode() for r in docs.collect())


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.scored(docs, model).collect()
    same = defaultdict(set)
    for r in out:
        same[r.text or ""].add(r.score)
    assert len(out) == docs.count() and all(len(s) == 1 for s in same.values()) and 0 < model.temperature
    plain = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, plain).collect()} == {0.5}
    assert quality.scored(empty, quality.train(empty, labels)).count() == 0
    assert quality.good(docs, labels).columns == docs.columns


def test_quality_temperature():
    """The temperature lowers the loss on the rows that it is fitted to."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2 * quality.DIM + 3))
    y = (x[:, 0] + rng.normal(size=2000) > 0).astype("f8")
    check = np.arange(2000) % 5 == 0
    model = quality.fit(np.zeros((1, quality.DIM), "f4"), x, y, check)
    z = model.logits(x[check])
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[check] * z / t)
    assert loss(model.temperature) <= loss(1.0) + 1e-9 and np.mean((z > 0) == y[check]) > 0.6


def test_url_links(spark):
    page = lambda i, url, html=None: (i, url, html, "r", "v")
    canonical, refresh = '<link href="{}" rel="canonical">', "<meta http-equiv=refresh content='0; url={}'>"
    rows = [
        page(1, "https://a.com/en/1", canonical.format("https://b.org/x")),
        page(2, "https://b.org/x", refresh.format("/y?q=1")),
        page(3, "http://B.org/y?q=1#top", "<p>no link</p>"),
        page(4, "https://example.com/en/7", canonical.format("https://b.org/x")),
        page(5, "https://c.org/z"),
        page(6, None, canonical.format("https://b.org/x")),
        page(7, "no scheme", "<link rel=canonical>"),
        page(8, "https://c.org/z"),
        page(9, "https://d.org/es/1", canonical.format("https://d.org/es/1")),
        page(10, "https://e.org/a/b", canonical.format("c")),
        page(11, "https://e.org/a/c"),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, rule string, verdict string")
    out = {r.page_id: (r.verdict, r.rule, r.host) for r in urls.url_verdicts(pages, urls.links(pages)).collect()}
    assert [out[i][0] for i in range(1, 12)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow"]
    assert out[1][1] == "com/en/" and out[2][1] is None and out[4][1] == "example.com/en/7" and out[6][2] == "" and out[7] == ("allow", None, "")
    none = pages.limit(0)
    assert urls.url_verdicts(none, urls.links(none)).count() == 0


def brute_sketch(text):
    """The kept shingle hashes of a text, each shingle hashed by itself."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    size = min(5, len(words))
    runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    out = set()
    for run in runs:
        (h,) = fingerprint.shingles(list(run)).tolist()
        out.add(h)
    low = {h for h in out if h < 1 << 62}
    return {h >> 22 for h in (low or ({min(out)} if out else set()))}


def test_fingerprint_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    for (doc_id, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, nxt = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        r = got[doc_id]
        assert set(fingerprint.hashes(r.fingerprint).tolist()) == own and set(fingerprint.hashes(r.edited_fingerprint).tolist()) == new
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (r.near_edited, r.near_next) == pytest.approx((like(own, new), like(own, nxt)))
        assert r.contained_edited == pytest.approx(len(own & new) / len(own) if own else 1.0)


def test_fingerprint_cases(spark, docs, empty):
    low = spark.createDataFrame([(-(2**63), "least of all ids"), (2**63 - 1, "greatest"), (None, "x"), (None, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint.edited_fingerprints(low).collect()}
    assert len(out) == 3 and out[2**63 - 1].edited_sha256 == hashlib.sha256(b"grealeas").hexdigest()
    rows = fingerprint.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count() and fingerprint.edited_fingerprints(empty).count() == 0
    same = defaultdict(set)
    for r in rows:
        same[r.doc_id if r.doc_id in (7, 8) else None].add(r.fingerprint)
    assert same[7] == same[8]
    for i in range(200):
        kept = fingerprint.sketch(f"word{i}")
        assert np.array_equal(fingerprint.hashes(fingerprint.fingerprint(kept)), kept)
    parts = ["one", "one two three four five six seven", " ".join(f"w{i}" for i in range(60))]
    for a in parts:
        for b in parts:
            whole = np.union1d(fingerprint.shingles(a.split()), fingerprint.shingles(b.split()))
            low_ = whole[whole < np.uint64(1 << 62)]
            want = np.unique((low_ if len(low_) else whole[:1]) >> np.uint64(22))
            assert np.array_equal(fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b)), want)


def test_ranges(spark):
    """Ranges are in order, and a value that a third of the rows have takes several."""
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("x"), F.xxhash64("id").alias("tie"))
        place, n = common.ranges(rows, "x", "tie")
        per = rows.withColumn("p", place).groupBy("p").agg(F.min(F.struct("x", "tie")).alias("lo"), F.max(F.struct("x", "tie")).alias("hi"), F.count("*").alias("c")).orderBy("p").collect()
        assert all(0 <= r.p < n for r in per) and max(r.c for r in per) < 5000
        key = lambda s: (s.x is not None, s.x or 0, s.tie)
        assert all(key(a.hi) < key(b.lo) for a, b in zip(per, per[1:], strict=False))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_token_file_cases(spark, docs, empty, tmp_path):
    vocabulary = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(vocabulary)
    folder = str(tmp_path / "ids")
    manifest, raw = binary.write_ids(docs, folder, vocabulary)
    out = binary.read_ids(manifest, folder, raw).collect()
    want = Counter((r.doc_id, np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == want
    assert [r.start for r in sorted(out, key=lambda r: r.start)] == np.cumsum([0, *[r.n_tokens for r in sorted(out, key=lambda r: r.start)]])[:-1].tolist()
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    # a file names its dictionary, and one document is read without the others
    path = manifest.first().path
    data = open(path, "rb").read()
    assert data[:8] == binary.MAGIC and data[8:40] == hashlib.sha256(raw).digest() and struct.unpack("<Q", data[-8:])[0] == manifest.first().docs
    with pytest.raises(ValueError):
        binary.Reader(folder, path, raw + b"x")
    none, raw = binary.write_ids(empty, str(tmp_path / "none"), vocabulary)
    assert binary.read_ids(none, str(tmp_path / "none"), raw).count() == 0


def test_pii_scores(spark):
    """Pattern and instance scores of the graph against a plain reckoning."""
    texts = [f"write to desk at user{i}@mail.example.com today" for i in range(5)]
    texts += ["write to desk at user(at)host99887 today", "write to desk at noon1 today", "call line two +1 (269) 555-3296 now", 'token = "' + "0a1b2c3d" * 5 + '"']
    texts += [f'set token = "{i}f' + "9e8d7c6b" * 4 + '" here' for i in range(3)] + ['set token = "short7" here', "numbers 1234567 and 7654321 alone"]
    texts += [f"the of {i}{i}@x.org" for i in range(1, 5)] + ["the of a b c the of d e the of f the of g the of h"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = common.written(pii.found(df), "found")
    edge = common.written(pii.edges(rows), "edges")
    sure = {r.pattern: (r.kind, r.score) for r in pii.sure_patterns(edge, df).collect()}
    graph, seeds, ids = defaultdict(set), {}, Counter()
    for r in edge.collect():
        graph[r.pattern].add(r.instance)
        ids[r.pattern] += 1
        if r.seed:
            seeds[r.instance] = r.seed
    places = Counter()
    for t in texts:
        w = re.sub("[0-9]", "0", t.lower()).split()
        for i in range(len(w)):
            left, before, right = (w[j] if 0 <= j < len(w) else None for j in (i - 1, i - 2, i + 1))
            if left and before:
                places[f"2 {before} {left}"] += 1
            if left and re.search("[^:=][:=]$", left):
                places[f"1 {left}"] += 1
            if left and right:
                places[f"b {left} {right}"] += 1
    known, want = {i: (k, 1.0) for i, k in seeds.items()}, {}
    while True:
        good = {}
        for p, members in graph.items():
            by, n = Counter(), Counter()
            for i in members & known.keys():
                by[known[i][0]] += known[i][1]
                n[known[i][0]] += 1
            if len(members) < 3 or not by:
                continue
            score, count, kind = max((by[k], n[k], k) for k in by)
            share = ids[p] / max(ids[p], places[p])
            if count >= 3 and score / sum(by.values()) >= 0.8 and share >= 0.5:
                good[p] = (kind, score / sum(by.values()) * share)
        if len(good) <= len(want):
            want = good
            break
        want = good
        known = {i: (k, 1.0) for i, k in seeds.items()}
        for i in {i for p in good for i in graph[p]} - seeds.keys():
            err = defaultdict(lambda: 1.0)
            for p, (k, s) in good.items():
                if i in graph[p]:
                    err[k] *= max(1 - s, 1e-9)
            k = max(err, key=lambda k: (1 - err[k], k))
            known[i] = (k, 1 - err[k])
    assert {p: k for p, (k, _) in sure.items()} == {p: k for p, (k, _) in want.items()}
    assert all(sure[p][1] == pytest.approx(want[p][1]) for p in want)
    assert "2 the of" not in sure and sure["2 desk at"][0] == "email" and sure["2 token ="][0] == "secret"
    out = {r.doc_id: r.s for r in pii.personal_data(df).select("doc_id", pii.as_text(F.col("spans")).alias("s")).collect()}
    assert out[5] == "email:17:34" and out[8].startswith("secret:9:") and out[12] == "secret:13:19" and out[13] == ""


def test_pii_cases(spark, docs, empty):
    assert pii.personal_data(empty).count() == 0
    assert pii.personal_data(docs).count() == docs.count()
    many = " ".join(f"{i} a{i}@b.c" for i in range(3000))
    row = pii.personal_data(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert row.n_email == 3000 and [(s.s, s.e) for s in row.base] == [m.span() for m in re.finditer(r"a[0-9]+@b\.c", many)]


def test_line_templates(spark):
    """Leaves with several templates, a hot one among them, and unrelated endings."""
    rows = [f"alpha beta gamma user name{chr(97 + i % 26)}{chr(97 + i // 26)} logged in from here" for i in range(60)]
    rows += [f"alpha beta gamma disk part{chr(97 + i)} is full now again" for i in range(5)]
    rows += ["one two three " + x for x in ("apple", "pear", "plum", "fig")] + ["Les.", "Les.", "Les.", "Once.", "Twice.", "Twice."]
    df = spark.createDataFrame([(i, f"own{'x' * i}\n{t}") for i, t in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r.text.split("\n")[1:] for r in lines.drop_lines(df).collect()}
    kept = [i for i in range(len(rows)) if out[i]]
    assert kept == [0, 60, 65, 66, 67, 68, 69, 72, 73, 74]


def test_line_cases(spark, docs, empty):
    out = lines.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and lines.drop_lines(empty).count() == 0


def test_mix_tree(spark):
    """Every block goes to one shard; shard sizes are exact; a node's split has the hypergeometric mean and spread."""
    quotas = spark.createDataFrame([([500, 300, 0, 1],)], "q array<bigint>")
    for shards in (1, 7, 16):
        rows = mix.split_tree(quotas, shards, 7).collect()
        per = Counter()
        for r in rows:
            per[r.shard] += r.n
        assert [sum(r.n for r in rows if r.i == i) for i in range(4)] == [500, 300, 0, 1]
        assert len(per) == shards and max(per.values()) - min(per.values()) <= shards.bit_length() and min(r.n for r in rows) >= 0
    left = np.array([mix.split_tree(quotas, 2, seed).where("shard = 0 and i = 0").first().n for seed in range(40)])
    mean, var = 400 * 500 / 801, 400 * (500 / 801) * (301 / 801) * (401 / 800)
    assert abs(left.mean() - mean) < 5 * (var / 40) ** 0.5 and 0.4 * var < left.var() < 2 * var


def test_mix_cases(spark, docs, empty):
    assert mix.mix(empty).count() == 0
    rows = [(i, "w " * (i % 7), f"s{i % 3}" if i % 4 else None, 1) for i in range(400)] + [(1, "w " * 5, "s1", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    drawn = mix.draws(mix.sized(df.drop("shard"))).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("place").alias("p")).collect()
    assert sum(r.n for r in drawn) == mix.mix(df).count() and {r.shard for r in mix.mix(df).collect()} == {1}
    assert mix.mix(df).rdd.getNumPartitions() == 8
    took = Counter()
    for r in mix.mix(df).collect():
        took[r.source] += len(r.text.split())
    goal = {r.src[1:] or None: int(r.target) for r in mix.targets(mix.sized(df)).collect()}
    assert all(abs(took[s] - n) <= 1 for s, n in goal.items())


def brute_top(vectors, queries, k):
    out = []
    for place, (q, terms) in enumerate(queries):
        scored = sorted((-sum(a * b for a, b in zip(terms, other, strict=False)), v) for v, other in vectors if v != q)
        out += [(q, rank, v, -s) for rank, (s, v) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("share", [0.05, 0.4, 1.0])
@pytest.mark.parametrize("sign", [0, -20])
def test_top_k(spark, share, sign):
    """Sparse and dense vectors, positive and mixed terms, short vectors, ties and repeated ids."""
    rng = np.random.default_rng(int(share * 10) - sign)
    rows = [(i, (rng.integers(sign, 21, 12 - i % 3) * (rng.random(12 - i % 3) < share)).tolist()) for i in range(150)]
    rows += [(3, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame([*rows, (None, [1]), (500, None)], "id long, terms array<long>")
    before, topk.SHARD_ROWS = topk.SHARD_ROWS, 40
    try:
        got = sorted(tuple(r) for r in topk.top_k(df, df.where("id % 10 = 0"), 6).collect())
    finally:
        topk.SHARD_ROWS = before
    assert got == brute_top(rows, [r for r in rows if r[0] % 10 == 0], 6)


def test_top_k_cases(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [0.5, None]), (2, [float("nan")]), (3, None), (4, [1.0, float("inf")]), (5, [0.999, -0.01]), (6, []), (None, [1.0]), (20, [1.0, 2.0])]
    terms = spark.createDataFrame(rows, schema).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("terms"))
    assert [(r.id, r.terms) for r in terms.where("terms is not null").collect()] == [(5, [63, -1]), (6, []), (None, [64]), (20, [64, 128])]
    out = topk.top_k(terms, terms.where("id % 20 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(20, 1, 5, 63 * 64 - 128), (20, 2, 6, 0)]
    assert topk.top_k(terms.limit(0), terms).count() == 0 and topk.top_k(terms, terms.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [2**62, 1]), (2, [2, 3]), (3, [-(2**62), 5])], "id long, terms array<long>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(big, big).collect()}
    assert got[1, 2] == 2**63 - 1 and got[2, 3] == -(2**63) + 15 and got[1, 3] == -(2**63)


def test_shared_dir_is_asked_for(monkeypatch):
    """Without a shared folder a cluster's job ends with an error; only one machine gets a folder of its own."""

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_repeats_of_a_row_go_once(spark):
    """Thousands of equal rows with an id are one text class, and one row of shingles."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(8, text + " more")], "doc_id long, text string"))
    seen, own = [], jaccard.written
    try:
        jaccard.written = lambda df, name: seen.append((name, own(df, name))) or seen[-1][1]
        got = jaccard.jaccard_join(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_links"), F.max("n_links"), F.max("class_id")).collect()
    finally:
        jaccard.written = own
    assert sorted(map(tuple, got)) == [(7, 3000, 3000, 3000, 7), (8, 1, 3000, 3000, 7)]
    assert dict(seen)["shingles"].count() == 2


def test_rows_without_ids_are_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    blocks = mix.sized(docs, shards=8).groupBy("block").count()
    assert blocks.count() > 60 and blocks.agg(F.max("count")).first()[0] < 400


def test_equal_vectors_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 500)
    one = F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))
    vectors = spark.range(3000).select(F.lit(5).cast("long").alias("id"), one.alias("terms")).unionByName(spark.createDataFrame([(6, [1, 1])], "id long, terms array<long>"))
    assert [r.vec_id for r in topk.top_k(vectors, vectors.where("id = 6"), 3).collect()] == [5, 5, 5]
    sizes = [r["count"] for r in topk.dealt(vectors, 7).groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 600


def test_top_k_sends_no_table_by_the_driver(spark, monkeypatch):
    """Blocks of queries, one for each shard, were joined to the shards: broadcast while the planner took them for small, and a
    shard went through Arrow again for each block."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-200, 200, 5).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, terms array<long>")
    found = topk.top_k(df, df.where("id % 10 = 0"), 4)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, [r for r in rows if r[0] % 10 == 0], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_top_k_more_shards_than_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 1)
    rows = [(i, [i, 1 - i, 7]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, terms array<long>")
    assert sorted(map(tuple, topk.top_k(df, df, 3).collect())) == brute_top(rows, rows, 3)


def test_slim_numbers():
    for values in ([], [0], [-128, 127], [128], [-(2**15)], [2**15], [-(2**63), 2**63 - 1]):
        blob = topk.slim(np.array(values, "<i8"))
        assert topk.wide(blob).tolist() == values
    assert [len(topk.slim(np.array([v]))) for v in (127, 128, 2**15, 2**31)] == [2, 3, 5, 9]


def test_search_holds_a_tasks_shards():
    """Blocks come once and meet all shards before them, more blocks than go together."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 10, 4)) for i in range(90)]
    frame = lambda part, n: pd.DataFrame({"shard": n, "id": [i for i, _ in part], "terms": [t for _, t in part]})
    shards = pd.concat([topk.invert(frame(rows[n::3], n)) for n in range(3)])
    blocks = pd.concat([topk.pack(frame(rows[2 * n : 2 * n + 2], n)) for n in range(topk.LOTS + 3)])
    found = pd.concat(topk.search(iter([shards, blocks[:5], blocks[5:]]), 4))
    best = found.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id").head(4)
    asked = rows[: 2 * topk.LOTS + 6]
    assert sorted(zip(best["query_id"], best["vec_id"], best["score"], strict=True)) == sorted((q, v, s) for q, _, v, s in brute_top(rows, asked, 4))


def test_a_term_that_no_row_of_a_shard_has():
    p = topk.invert(pd.DataFrame({"shard": 0, "id": [1, 2], "terms": [[0, 3], [0, 4]]})).iloc[0]
    shard = topk.Shard(p.ids, p.ends, p.rows, p["values"])
    assert [shard.at(t, np.array([1, 0])).tolist() for t in (0, 1)] == [[0, 0], [4, 3]]
