"""Exact top-k inner products by MaxScore over shards of the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import partitions, table, written

SHARD_ROWS, QUERY_ROWS = 8192, 512
#: Beyond these, sums of products are no longer exact in doubles, or in 64-bit integers.
DOUBLE, EXACT = float(1 << 53), float(1 << 62)
#: Queries whose essential postings are traversed together, and the share of a shard's rows, as one in so many, from which a
#: term's postings take part in that.
TOGETHER, MANY = 64, 8
#: Terms of the shards that a task holds, about, and blocks of queries that go through them together.
HELD_TERMS, LOTS = 1 << 24, 16
#: A shard's postings, with lot -1, or a block of queries, whose terms are the values.
BLOBS = "shard int, lot int, ids binary, dim int, ends binary, rows binary, values binary"


def quantised(vectors: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double, held within a long; null if the vector is null or has a null or
    non-finite component."""
    x = F.transform(vectors, lambda x: x.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def dense(group: pd.DataFrame) -> np.ndarray:
    """The terms of a group as a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(group), max(map(len, group["terms"]), default=0)), "<i8")
    for row, terms in zip(out, group["terms"], strict=True):
        row[: len(terms)] = terms
    return out


def slim(numbers: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest of them needs; the first byte says how many."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    size = next(n for n in (1, 2, 4, 8) if -(1 << 8 * n - 1) <= low and high < 1 << 8 * n - 1)
    return bytes([size]) + numbers.astype(f"<i{size}").tobytes()


def wide(blob: bytes) -> np.ndarray:
    """What slim() was given, as longs."""
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).astype("<i8")


def pack(group: pd.DataFrame) -> pd.DataFrame:
    """A group of queries (shard, id, terms) as one row of blobs, its number as `lot`."""
    group = group.sort_values("id", kind="stable")
    rows = dense(group)
    return pd.DataFrame({"shard": [0], "lot": [group["shard"].iloc[0]], "ids": [slim(group["id"].to_numpy())], "dim": [rows.shape[1]], "ends": [None], "rows": [None], "values": [slim(rows)]})


def invert(group: pd.DataFrame) -> pd.DataFrame:
    """A shard of vectors as one row of postings: for each term the rows that have it, ascending, and their values."""
    group = group.sort_values("id", kind="stable")
    rows = dense(group)
    term, row = np.nonzero(rows.T)
    ends = np.searchsorted(term, np.arange(rows.shape[1]), "right")
    blobs = {"ends": ends, "rows": row, "values": rows.T[term, row]}
    return pd.DataFrame({"shard": [group["shard"].iloc[0]], "lot": [-1], "ids": [slim(group["id"].to_numpy())], "dim": [rows.shape[1]], **{k: [slim(v)] for k, v in blobs.items()}})


class Shard:
    """The postings of a shard, with the highest and lowest contribution that a term's weight can meet in it."""

    def __init__(self, ids: bytes, ends: bytes, rows: bytes, values: bytes) -> None:
        self.ids = wide(ids)
        ends, rows, values = wide(ends), wide(rows).astype("i4"), wide(values)
        self.rows, self.values = np.split(rows, ends[:-1]) if len(ends) else [], np.split(values, ends[:-1]) if len(ends) else []
        whole = [len(r) == len(self.ids) for r in self.rows]
        # terms that many rows have, side by side with zeros for the others: their postings are traversed for many queries at once
        self.many = np.flatnonzero([len(r) * MANY >= len(self.ids) for r in self.rows])
        self.place = np.full(max(len(self.rows), 1), -1)
        self.place[self.many] = np.arange(len(self.many))
        self.dense = np.zeros((len(self.many), len(self.ids)), "<i8")
        for own, t in zip(self.dense, self.many, strict=True):
            own[self.rows[t]] = self.values[t]
        self.doubles = self.dense.astype("f8")
        # a row without a term contributes nothing
        self.high = np.array([max(int(v.max()), -(2**63) if w else 0) if len(v) else 0 for v, w in zip(self.values, whole, strict=True)], "f8")
        self.low = np.array([min(int(v.min()), 2**63 - 1 if w else 0) if len(v) else 0 for v, w in zip(self.values, whole, strict=True)], "f8")

    def at(self, term: int, rows: np.ndarray) -> np.ndarray:
        """The term's values in some rows, 0 where they lack it."""
        if self.place[term] >= 0:
            return self.dense[self.place[term]][rows]
        own, values = self.rows[term], self.values[term]
        if not len(own):
            return np.zeros(len(rows), "<i8")
        place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        return np.where(own[place] == rows, values[place], 0)

    def split(self, query: np.ndarray, floor: float) -> tuple[np.ndarray, int, np.ndarray, float]:
        """The query's terms by falling bounds, how many are essential, what the terms from each place on can add at most, and
        how large a sum can become.

        Essential are the terms without which the rest together stays below the floor: a row in none of their postings can't
        reach it.
        """
        terms = np.flatnonzero(query)
        terms = terms[terms < len(self.rows)]
        weights = query[terms].astype("f8")
        bound = np.maximum(weights * self.high[terms], weights * self.low[terms])
        reach = np.maximum(np.abs(self.high[terms]), np.abs(self.low[terms]))
        most = float(np.abs(weights) @ reach)
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order], bound[order]
        # a hair more, as sums of doubles round
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0.0)
        rest += np.abs(rest) * 1e-9
        below = rest < max(floor, 0.0)
        return terms, int(np.argmax(below)) if floor > 0 and below.any() and most < EXACT else len(terms), rest, most

    def maxscore(self, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, (row, score) of all rows that can reach its floor, scores exact.

        Postings of essential terms are traversed: those of terms that many rows have as one product of the queries'
        essential weights and these postings, as long as doubles hold the sums exactly, the others term by term. The other
        terms are probed for the rows that are left, while their bounds can still lift them to the floor.
        """
        for at in range(0, len(queries), TOGETHER):
            part = queries[at : at + TOGETHER]
            splits = [self.split(q, f) for q, f in zip(part, floors[at : at + TOGETHER], strict=True)]
            weights = np.zeros((len(part), len(self.many)))
            for w, q, (terms, essential, _, most) in zip(weights, part, splits, strict=True):
                if most < DOUBLE:
                    own = terms[:essential][self.place[terms[:essential]] >= 0]
                    w[self.place[own]] = q[own]
            summed = (weights @ self.doubles).astype("i8")
            for q, f, base, one in zip(part, floors[at : at + TOGETHER], summed, splits, strict=True):
                yield self._reach(q, f, base, *one)

    def _reach(self, query: np.ndarray, floor: float, base: np.ndarray, terms: np.ndarray, essential: int, rest: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        exact, together = most >= EXACT, most < DOUBLE
        score = np.zeros(len(self.ids), object) if exact else base
        met = np.zeros(len(self.ids), bool) if floor > 0 else np.ones(len(self.ids), bool)
        for t in terms[:essential]:
            rows = self.rows[t]
            if self.place[t] >= 0 and together:
                met[:] = True  # those without the term go below
                continue
            score[rows] += self.values[t].astype(object) * int(query[t]) if exact else self.values[t] * query[t]
            met[rows] = True
        left = np.flatnonzero(met & (score + rest[essential] >= floor))
        some = score[left]
        for k in range(essential, len(terms)):
            if not len(left):
                break
            some = some + query[terms[k]] * self.at(terms[k], left)
            keep = some + rest[k + 1] >= floor
            left, some = left[keep], some[keep]
        if exact:
            some = np.clip(some, -(2**63), 2**63 - 1)
        return left, some.astype("i8")


def search(blobs: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """The best k of each of a task's shards for each query of the blocks that follow them, see search_lots()."""
    shards, lots = [], []
    for batch in blobs:
        for p in batch.itertuples():
            if p.lot < 0:
                shards.append(p)
                continue
            lots.append(p)
            if len(lots) == LOTS:
                yield from search_lots(shards, lots, k)
                lots = []
    yield from search_lots(shards, lots, k)


def search_lots(shards: list, lots: list, k: int) -> Iterator[pd.DataFrame]:
    """Shards are unfolded one by one; floors that a block's queries find on one hold for the next ones."""
    floors: dict[int, np.ndarray] = {}
    for s in shards if lots else []:
        shard = Shard(s.ids, s.ends, s.rows, s.values)
        for p in lots:
            q_ids = wide(p.ids)
            queries = wide(p.values).reshape(len(q_ids), p.dim)
            floor = floors.setdefault(p.lot, np.full(len(q_ids), -np.inf))
            found = []
            for q, (query_id, (rows, score)) in enumerate(zip(q_ids, shard.maxscore(queries, floor), strict=True)):
                own = shard.ids[rows] != query_id
                ids, score = shard.ids[rows[own]], score[own]
                if len(score) > 4 * k:  # only those that reach the k-th highest are sorted
                    high = score >= np.partition(score, -k)[-k]
                    ids, score = ids[high], score[high]
                top = np.lexsort((ids, ~score))[:k]  # ~x falls as x rises, without overflow
                if len(top) == k:
                    floor[q] = max(floor[q], float(score[top[-1]]))
                found.append((np.full(len(top), q), ids[top], score[top]))
            q, i, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pd.DataFrame({"q_shard": p.lot, "q": q, "query_id": q_ids[q], "vec_id": i, "score": score}).astype({"q_shard": "int32", "q": "int32"})


def dealt(rows: DataFrame, count: int) -> DataFrame:
    """rows of a written table with `shard`, by id and place, so that equal rows are dealt apart."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(count)).cast("int"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all rows of other ids.

    vectors and queries have (id long, terms array<long>). Rows with a null id or null terms take no part,
    missing components count as 0, an id's repeated rows are ranked as rows of their own, ties go to the
    smaller id. Rows, equal ones too, are dealt to shards of about SHARD_ROWS and inverted to postings, queries to blocks; every
    block meets every shard, as blobs, and each query's own split of terms decides what it reads there. Shards and blocks are not
    joined but sorted together, a task's shards before the blocks: a shard goes to one task, a block once to each task, and
    nothing by the driver. Scores beyond a long are held at its ends. Vectors may have any length, other columns aren't read,
    empty tables give no rows.
    """
    vectors, queries = (x.where("id is not null and terms is not null") for x in (vectors, queries))
    vectors, queries = written(vectors, "vectors"), written(queries, "queries")
    rows, terms = vectors.agg(F.count("*"), F.sum(F.size("terms"))).first()
    shards, lots = max(1, -(-rows // SHARD_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    packed = dealt(vectors, shards).groupBy("shard").applyInPandas(invert, BLOBS)
    asked = dealt(queries, lots).groupBy("shard").applyInPandas(pack, BLOBS)
    # few tasks, each with many shards: floors rise from one to the next, so that fewer rows are left to rank
    spark = vectors.sparkSession
    few = min(partitions(spark), 2 * spark.sparkContext.defaultParallelism)
    tasks = min(shards, max(few, -(-(terms or 0) // HELD_TERMS)))
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    blobs = packed.withColumn("task", F.col("shard") % tasks).union(asked.withColumn("task", each))
    blobs = blobs.repartitionById(tasks, F.col("task")).sortWithinPartitions("lot", "shard")
    found = blobs.mapInPandas(lambda it: search(it, k), "q_shard int, q int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_shard", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("terms"))
    return top_k(rows, rows.where("id % 20 = 0"), 20)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.terms, c.terms), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
