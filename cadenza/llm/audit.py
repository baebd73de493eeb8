"""Filter interaction audit: duplicates by fingerprint-routed chains, masks of failed filters, every order of filters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import partitions, table

#: The filters' letters, each with its bit in a mask, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: A map task hands its chains on once they hold this many bytes of text; a partition gets about as many.
CHAIN_BYTES = 64 << 20
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(text: str) -> tuple[bytes, int]:
    """The text's bytes, and the mask of the filters A to D that it fails."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()  # at space, tab, LF, VT, FF and CR
    capitals = len(b) - len(b.translate(None, CAPITALS))
    checks = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * len(text),
        len(b) != len(b.translate(None, SIGNS)),
    )
    return b, sum(1 << k for k, bad in enumerate(checks) if bad)


def before(a: int | None, b: int | None) -> bool:
    """Whether doc_id a is smaller than b, a null one being the largest."""
    return a is not None and (b is None or a < b)


class Chains:
    """By fingerprint, a chain of entries: whole text, least doc_id, mask, and how many rows with that id each part has.

    Rows that turn out to have a smaller id with the same text are counted in `copies` by (doc_id, part, mask).
    """

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.copies: Counter = Counter()
        self.bytes = 0

    def add(self, key: int, text: bytes, doc_id: int | None, mask: int, parts: dict[str, int]) -> None:
        chain = self.chains.setdefault(key, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, doc_id, mask, dict(parts)])
            self.bytes += len(text)
        elif entry[1] == doc_id:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
        else:
            lost, kept = ((entry[1], entry[3]), (doc_id, dict(parts))) if before(doc_id, entry[1]) else ((doc_id, parts), (entry[1], entry[3]))
            entry[1], entry[3] = kept
            for part, n in lost[1].items():
                self.copies[lost[0], part, mask | COPY] += n

    def entries(self) -> Iterator[tuple[int, list]]:
        return ((key, e) for key, chain in self.chains.items() for e in chain)


def route(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (text, doc_id, mask, parts)) of the least row of each text of a map task, and its copies, dealt evenly."""
    own = Chains()

    def give() -> Iterator[tuple[int, tuple]]:
        for key, entry in own.entries():
            yield key, tuple(entry)
        for (doc_id, part, mask), n in own.copies.items():
            yield xxhash.xxh3_64_intdigest(f"{doc_id}:{part}".encode("utf-8", "surrogatepass")), (None, doc_id, mask, {part: n})

    for doc_id, text, part in rows:
        b, mask = failed(text)
        own.add(xxhash.xxh3_64_intdigest(b), b, doc_id, mask, {part: 1})
        if own.bytes > CHAIN_BYTES:
            yield from give()
            own = Chains()
    yield from give()


def judged(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of all rows that were routed here; rows without an id are counted together."""
    own = Chains()
    for key, (text, doc_id, mask, parts) in rows:
        if text is None:
            for part, n in parts.items():
                own.copies[doc_id, part, mask] += n
        else:
            own.add(key, text, doc_id, mask, parts)
        if len(own.copies) > 100_000:
            yield from ((*k, n) for k, n in own.copies.items())
            own.copies = Counter()
    for _, (_, doc_id, mask, parts) in own.entries():
        if doc_id is None:
            for part, n in parts.items():
                own.copies[None, part, mask] += n
        else:
            yield from ((doc_id, part, mask, n) for part, n in parts.items())
    yield from ((*k, n) for k, n in own.copies.items())


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of docs (doc_id, text, source) fail which filters.

    A null text is an empty one, a null source the part ''. A row is a copy (E) if a row with the same text has a smaller
    doc_id; a null id is larger than any other, rows of one id and text are no copies of each other, so a text whose
    rows all lack an id has none. Texts go by xxhash to partitions, once for each map task (or 64 MB of text) at most,
    however many copies there are; there chains compare whole texts. The texts' bytes are added up first: there are so many
    partitions that one holds about 64 MB of different texts. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(partitions(spark), -(-size // CHAIN_BYTES))
    out = rows.rdd.mapPartitions(route).partitionBy(count, lambda key: key).mapPartitions(judged)
    return spark.createDataFrame(out, "doc_id bigint, part string, mask int, n bigint", verifySchema=False)


def _steps() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of all orders, and for each count which masks it takes, a row a step."""
    masks, names = np.arange(1 << len(FILTERS)), []
    take: dict[str, list] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in permutations(range(len(FILTERS))):
        earlier = np.zeros(len(masks), bool)
        for step, k in enumerate(order):
            fails = masks >> k & 1 > 0
            names.append(("".join(FILTERS[i] for i in order), step + 1))
            take["removed"].append(fails & ~earlier)
            take["redundant"].append(fails & earlier)
            take["unique_fails"].append(masks == 1 << k)
            earlier = earlier | fails
            take["kept"].append(~earlier)
    return names, {k: np.array(v, "i8") for k, v in take.items()}


def orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """A row for each order and step of a part's counts by mask: of all, good and toxic documents."""
    names, take = _steps()
    every, good, toxic = np.array(vector, "i8").reshape(3, -1)
    found = {k: v @ every for k, v in take.items()}
    found["good_lost"], found["toxic_lost"] = take["removed"] @ good, take["removed"] @ toxic
    total = Counter()
    for (order, step), n in zip(names, found["removed"].tolist(), strict=True):
        total[order[step - 1]] += n
    for i, (order, step) in enumerate(names):
        yield (part, order, step, *(int(found[c][i]) for c in COUNTS[:-1]), total[order[step - 1]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Rows of docs are judged by verdicts(); labels (doc_id, quality, toxic) names good and toxic ids, an id with several
    rows is good (toxic) if one of them says so. Counts by mask are merged in a vector for each part, before the shuffle
    too; every order of the filters is worked out from that vector alone.
    """
    spark, masks = docs.sparkSession, 1 << len(FILTERS)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = verdicts(docs).join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def merged(vector: list[int], x: tuple[int, int, int, int]) -> list[int]:
        mask, n, good, toxic = x
        vector[mask] += n
        vector[masks + mask] += n * good
        vector[2 * masks + mask] += n * toxic
        return vector

    keyed = rows.rdd.map(lambda r: (r[0], tuple(r)[1:]))
    vectors = keyed.combineByKey(lambda x: merged([0] * (3 * masks), x), merged, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], partitions(spark))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return spark.createDataFrame(vectors.flatMap(lambda x: orders(*x)), schema, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
f AS (
  SELECT doc_id, part,
         CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INT)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) AS INT) AS mask
  FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
v AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(0, 5)) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (
  SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', CAST(k AS INT) + 1, 1)), '') AS filter_order, CAST(step AS INT) AS step, CAST(1 << ks[step] AS INT) AS bit,
         CAST(coalesce(list_sum(list_transform(ks[1:step - 1], lambda k: 1 << k)), 0) AS INT) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM v, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM g"""
