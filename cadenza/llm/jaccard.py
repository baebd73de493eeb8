"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table, written
from cadenza.llm.components import components
from cadenza.llm.shingles import WORDS, forget, shingles

SIZE, THRESHOLD = 5, 0.8
#: 21 bands of 3 values: two texts at the threshold share none with probability (1 - 0.8**3)**21 = 3e-7.
BANDS, ROWS = 21, 3
#: A pair goes once the posterior probability that it reaches the threshold is below this.
TOLERANCE = 1e-7
#: MinHash values compared at a time, members of a block of texts, and of a part of a band's bucket.
STEP, BLOCK, PART = 9, 256, 1024
COLUMNS = 16_384
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype="u8")


def minhash(h: np.ndarray) -> np.ndarray:
    """The least values of the shingle hashes under BANDS * ROWS orders, 32 bits each."""
    out = np.full(len(_A), np.iinfo("u8").max, "u8")
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            part = h[at : at + 4096] * _A[:, None] + _B[:, None]
            np.minimum(out, part.min(1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def least_matches(threshold: float, tolerance: float, most: int) -> list[int]:
    """For each count n of compared values, the fewest equal ones at which a pair stays.

    Values agree with the pair's likeness as probability; under a uniform prior the posterior after m of n
    is Beta(m + 1, n - m + 1), whose upper tail at the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(most + 1):
        mass = [math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 1)]
        tails = list(itertools.accumulate(mass))
        out.append(next((m for m in range(n + 1) if tails[m] >= tolerance), n))
    return out


def signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text class, MinHash values) of (doc_id, text, h). Texts of the same words in a row are of one class."""
    seen: dict[bytes, bytes] = {}
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            classes, values = [], []
            for text in part.column(1).to_pylist():
                words = WORDS(text or "")
                name = xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass"))
                if name not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    seen[name] = minhash(shingles(words, size)).tobytes()
                classes.append(name.hex())
                values.append(seen[name])
            yield pa.record_batch([part.column(0), part.column(2), pa.array(classes), pa.array(values, pa.binary())], names=["doc_id", "h", "class", "sig"])
    forget()


def members(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The shingles of candidates (node, copies, block, class, sig, text); rows of another text with the same hash go."""
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            words = [WORDS(t or "") for t in part.column("text").to_pylist()]
            names = [xxhash.xxh3_128_hexdigest("\n".join(w).encode("utf-8", "surrogatepass")) for w in words]
            keep = [i for i, (a, b) in enumerate(zip(names, part.column("class").to_pylist(), strict=True)) if a == b]
            rest = part.select(["node", "copies", "block", "sig"]).take(pa.array(keep, pa.int64()))
            blobs = pa.array([shingles(words[i], size).tobytes() for i in keep], pa.binary())
            yield pa.record_batch([*rest.columns, blobs], names=[*rest.schema.names, "shingles"])
    forget()


def likely(a: np.ndarray, b: np.ndarray, upper: bool, fewest: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature matrices that outlive the comparison, value group by value group."""
    i, j = None, None
    for at in range(0, a.shape[1], STEP):
        end = min(at + STEP, a.shape[1])
        if i is None:
            match = np.zeros((len(a), len(b)), "i2")
            for k in range(at, end):
                match += a[:, k, None] == b[None, :, k]
            i, j = np.nonzero(np.triu(match >= fewest[end], 1) if upper else match >= fewest[end])
            match = match[i, j]
        else:
            match = match + (a[i, at:end] == b[j, at:end]).sum(1)
            keep = match >= fewest[end]
            i, j, match = i[keep], j[keep], match[keep]
        if not len(i):
            break
    return i, j


def verified(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by exact counts of shared shingles."""
    t = Fraction(str(threshold))
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i) < 4 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], "i8")
    else:  # many: products of 0/1 matrices over the shingles that both sides hold
        flat_a, flat_b = np.concatenate(a), np.concatenate(b)
        names = np.intersect1d(flat_a, flat_b)
        counts = np.zeros((len(a), len(b)), "f4")
        rows_a, rows_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        for at in range(0, len(names), COLUMNS):
            some = names[at : at + COLUMNS]
            grids = []
            for n, rows, flat in ((len(a), rows_a, flat_a), (len(b), rows_b, flat_b)):
                place = np.minimum(np.searchsorted(some, flat), len(some) - 1)
                hit = some[place] == flat
                grid = np.zeros((n, len(some)), "f4")
                grid[rows[hit], place[hit]] = 1
                grids.append(grid)
            counts += grids[0] @ grids[1].T
        both = counts[i, j].astype("i8")
    return both * (t.numerator + t.denominator) >= t.numerator * (na[i] + nb[j])


def stars(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among n rows, as (root, row)."""
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    out, new = [], linked.any(1)
    while new.any():
        root = int(np.argmax(new))
        new[root] = False
        front = np.array([root])
        while len(front):
            found = np.flatnonzero(linked[front].any(0) & new)
            new[found] = False
            out += [(root, int(x)) for x in found]
            front = found
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first columns, of sorted batches."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    return (list(g) for _, g in itertools.groupby(rows(), key=lambda r: r[:keys]))


def meeting_blocks(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(lo, hi): blocks of texts that hold a pair which outlives the comparison, from sorted pairs of a bucket's parts."""
    fewest = least_matches(threshold, tolerance, BANDS * ROWS)
    out: set[tuple[int, int]] = set()
    for group in _groups(batches, ["bucket", "lo", "hi", "part", "block", "sig"], 3):
        lo, hi = group[0][1:3]
        left = [r for r in group if r[3] == lo]
        right = left if lo == hi else [r for r in group if r[3] == hi]
        if not left or not right:
            continue
        i, j = likely(*(np.frombuffer(b"".join(r[5] for r in side), "<u4").reshape(len(side), -1) for side in (left, right)), lo == hi, fewest)
        a, b = (np.array([r[4] for r in side]) for side in (left, right))
        found = np.unique(np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])]), axis=1)
        out.update(zip(*found.tolist(), strict=True))
        if len(out) > 20_000:
            yield _pairs(out)
            out = set()
    yield _pairs(out)


def _pairs(rows: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["lo", "hi"])


def block_links(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """(node, links, other): link counts (other null) and forest edges of sorted block pairs."""
    fewest = least_matches(threshold, tolerance, BANDS * ROWS)
    names = ["lo", "hi", "block", "node", "copies", "sig", "shingles"]

    def work(group: list[tuple]) -> list[tuple]:
        group = list({r[3]: r for r in group}.values())
        lo, hi = group[0][:2]
        left = [r for r in group if r[2] == lo]
        right = left if lo == hi else [r for r in group if r[2] == hi]
        if not left or not right:
            return []
        a, b = ([np.frombuffer(r[6], "u8") for r in side] for side in (left, right))
        sig_a, sig_b = (np.stack([np.frombuffer(r[5], "<u4") for r in side]) for side in (left, right))
        i, j = likely(sig_a, sig_b, lo == hi, fewest)
        ok = verified(a, b, i, j, threshold)
        i, j = i[ok], j[ok]
        copies_a, copies_b = np.array([r[4] for r in left]), np.array([r[4] for r in right])
        links = [np.bincount(i, copies_b[j], len(left)), np.bincount(j, copies_a[i], len(right))]
        nodes = [r[3] for r in left] + ([] if lo == hi else [r[3] for r in right])
        links = links[0] + links[1] if lo == hi else np.concatenate(links)
        out = [(n, int(c), None) for n, c in zip(nodes, links, strict=True) if c]
        return out + [(nodes[x], 0, nodes[y]) for x, y in stars(len(nodes), i, j if lo == hi else j + len(left))]

    out: list[tuple] = []
    for group in _groups(batches, names, 2):
        out += work(group)
        if len(out) > 20_000:
            yield _links(out)
            out = []
    yield _links(out)
    out.clear()
    forget()


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["node", "links", "other"])


def jaccard_join(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of every row: its group, its text class, and its partners.

    n_links counts the other rows whose sets of `size`-word shingles have a Jaccard likeness of the
    threshold or more, copies of the same words among them. class_id is the least doc_id of all rows that
    such links connect, copy_of the least of those with the same words. A text of fewer words is one
    shingle; null and empty texts are copies of each other. Null doc_ids come after all others, an id's
    repeated rows count as rows. Columns besides doc_id and text aren't read.

    Copies are collapsed first. Candidates are texts that share a bucket of a band of MinHash values; of
    buckets with the same texts one is kept. Each text has a home, the largest of its buckets, and there a block of
    about BLOCK texts. Within a bucket, in pairs of parts, equal values are counted a few at a time and pairs
    whose posterior falls below the tolerance go; what is passed on is which blocks hold a pair that is left.
    Such blocks meet, each two in a task of their own: pairs are pruned alike, the rest are verified exactly.
    Of the links only counts and a spanning forest leave the task. So texts meet if they, or others of their
    blocks, are likely pairs, not if a chain of lesser likenesses connects them, and no pairs are shuffled.
    """
    rows, texts_of = _classes(docs, size, threshold, tolerance)
    texts_of = texts_of.select("class", "class_id", F.col("first_id").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.select("doc_id", "class").join(texts_of, "class").select("doc_id", "class_id", "copy_of", "n_links")


def _classes(docs: DataFrame, size: int, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, class) of every row, h hashing its text, and each text class with its group (see jaccard_join).

    A class's or group's first row is that of the least doc_id, nulls last, then text hash.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    rows = written(docs.mapInArrow(lambda it: signatures(it, size), "doc_id bigint, h bigint, class string, sig binary"), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")
    classes = rows.groupBy("class").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(row).alias("first"), F.min("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    band = lambda b: F.xxhash64(b, F.substring("sig", b * 4 * ROWS + 1, F.lit(4 * ROWS)))
    bands = classes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    same = [F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all")]
    buckets = bands.groupBy("bucket").agg(*same).where("n > 1").groupBy("n", "least", "most", "all").agg(F.min("bucket").alias("bucket"))
    # written, so that the join has plain shuffles on both sides and a hot bucket can be split
    buckets = written(buckets.select("bucket", "n"), "buckets")
    found = written(bands.join(buckets, "bucket"), "members")
    home = written(found.groupBy("node").agg(F.max(F.struct("n", "bucket")).alias("home")).select("node", "home.bucket"), "homes")
    sizes = written(home.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "home-sizes")
    wanted = home.join(sizes, "bucket").select("node", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), "blocks")).alias("block")).join(classes, "node")
    wanted = wanted.select("node", "block", "copies", "sig", "class", F.col("first.null").alias("null"), F.coalesce("first_id", F.lit(0)).alias("id"), F.col("first.h").alias("h"))
    wanted = written(wanted, "candidates")
    parts = found.join(wanted.select("node", "block", "sig"), "node").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), "parts").cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = parts.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "block", "sig")
    parts = parts.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    pairs = parts.mapInArrow(lambda it: meeting_blocks(it, threshold, tolerance), "lo bigint, hi bigint").distinct()
    pairs = written(pairs, "pairs")
    # a class is given the text of its first row; rows of one id and text go once, whatever their number
    named = docs.select(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "text").dropDuplicates(["null", "id", "h"])
    texts = named.join(wanted, ["null", "id", "h"])
    texts = texts.select("node", "copies", "block", "class", "sig", "text")
    known = texts.mapInArrow(lambda it: members(it, size), "node bigint, copies bigint, block bigint, sig binary, shingles binary")
    known = written(known, "shingles")
    sides = pairs.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    meet = known.join(sides, "block").select("lo", "hi", "block", "node", "copies", "sig", "shingles")
    meet = meet.repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    links = written(meet.mapInArrow(lambda it: block_links(it, threshold, tolerance), "node bigint, links bigint, other bigint"), "links")
    counts = links.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    group = components(links.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    texts_of = classes.select("class", "node", "copies", "first_id", "first").join(counts, "node", "left").join(group, "node", "left")
    texts_of = texts_of.withColumn("component", F.coalesce("component", "node"))
    least = texts_of.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min("first").alias("group_first"))
    return rows.drop("sig"), texts_of.join(least, "component")


def one_of_each(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each group: that of the least doc_id, nulls last, and of its texts the one of the least hash."""
    _, texts_of = _classes(docs, size, threshold, TOLERANCE)
    first = texts_of.where(F.col("first") == F.col("group_first")).select("first.null", F.coalesce("first_id", F.lit(0)).alias("id"), "first.h")
    first = written(first, "firsts")
    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(doc_id.isNull().alias("null"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(first, ["null", "id", "h"], "left_semi").dropDuplicates(["null", "id", "h"])
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
