"""Quality classifier: random-indexing word vectors pooled by document, a two-layer network in numpy, and
probabilities calibrated by a temperature."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import partitions_of, release, table

#: Words are hashed to this many rows; a word's index vector has NONZERO entries of +-1 among DIM.
ROWS, DIM, NONZERO = 1 << 14, 32, 4
#: Neighbours on either side whose index vectors a word gathers.
REACH = 2
#: The network learns from this many labelled rows at most, those of smallest hash.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.3
PIECES = re.compile(r"\w+|[^\w\s]+").findall
KNOWN = 400_000
CHUNK = 1_000_000
#: Input of a task that sums up: it returns a whole table of vectors.
TASK_BYTES = 64 << 20


def rows_of(text: str, known: dict[str, int]) -> np.ndarray:
    """The row of each word and each run of signs; `known` lasts for a task, so that an idle worker holds nothing."""
    words = PIECES(text)
    out = list(map(known.get, words))
    if None in out:
        if len(known) > KNOWN:
            known.clear()
        for i, (w, r) in enumerate(zip(words, out, strict=True)):
            if r is None:
                out[i] = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % ROWS
    return np.array(out, "<i4")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors' entries; the row after the last stands for nothing."""
    rng = np.random.default_rng(20240301)
    places = rng.permuted(np.tile(np.arange(DIM), (ROWS, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (ROWS, NONZERO))
    return np.vstack([places, np.zeros((1, NONZERO), places.dtype)]), np.vstack([signs, np.zeros((1, NONZERO))])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, sums): what the words of a task's texts gathered from their neighbours, 256 rows a block."""
    places, signs = index_vectors()
    total = np.zeros((ROWS + 1) * DIM)
    apart = np.full(REACH, ROWS, "<i4")
    held, size, known = [], 0, {}

    def add() -> None:
        ids = np.concatenate([apart, *held]).astype("i8")
        for d in range(1, REACH + 1):
            for word, near in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                for k in range(NONZERO):
                    np.add(total, np.bincount(word * DIM + places[near, k], signs[near, k], len(total)), out=total)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held += [rows_of(text or "", known), apart]
            size += len(held[-2])
            if size >= CHUNK:
                add()
                held, size = [], 0
    if size:
        add()
    blocks = total[: ROWS * DIM].astype("<i8").reshape(-1, 256 * DIM)
    yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "sums"])
    known.clear()
    held.clear()
    release()


def summed(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(256 * DIM, "<i8")
    for x in group["sums"]:
        total += np.frombuffer(x, "<i8")
    return pd.DataFrame({"block": [group["block"].iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector for each row of words, from all texts.

    A task sums what its words gathered; Spark adds the tasks' blocks up in two steps. What reaches the driver is
    ROWS x DIM numbers (4 MB) whatever the input.
    """
    texts = partitions_of(docs.select(F.col("text").cast("string")), TASK_BYTES)
    side = math.ceil(math.sqrt(texts.rdd.getNumPartitions()))
    rows = texts.mapInArrow(gathered, "block int, sums binary").withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(side)))
    # in two steps, so that no group has more blobs than the root of the tasks' count
    rows = rows.groupBy("block", "lot").applyInPandas(summed, "block int, sums binary").groupBy("block").applyInPandas(summed, "block int, sums binary")
    out = np.zeros((ROWS // 256, 256 * DIM))
    for r in rows.collect():
        out[r["block"]] = np.frombuffer(r["sums"], "<i8")
    out = out.reshape(ROWS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype("f4")


def pooled(text: str, vectors: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """Mean and root mean square of a text's word vectors, the mean's length, and the log of its count of words."""
    rows = rows_of(text, known)
    out = np.zeros(2 * DIM + 3, "f4")
    if len(rows):
        v = vectors[rows]
        out[:DIM] = v.mean(0)
        out[DIM : 2 * DIM] = np.sqrt(np.einsum("ij,ij->j", v, v) / len(v))
        out[2 * DIM] = np.sqrt(out[:DIM] @ out[:DIM])
        out[2 * DIM + 1] = len(np.unique(rows)) / len(rows)
        out[2 * DIM + 2] = np.log1p(len(rows))
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probabilities(self, texts: list[str | None], known: dict[str, int]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([pooled(t or "", self.vectors, known) for t in texts]).astype("f8")
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Model:
    """A network learnt by Adam from rows that aren't `check`; the temperature is fitted to those that are."""
    rng = np.random.default_rng(7)
    n = x.shape[1]
    if not len(y):
        return Model(vectors, np.zeros(n), np.ones(n), np.zeros((n, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    learn = ~check if 0 < check.sum() < len(y) else np.ones(len(y), bool)
    a, t = x[learn], y[learn]
    mean, scale = a.mean(0), a.std(0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    z = np.clip((a - mean) / scale, -8, 8)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            b = order[at : at + BATCH]
            hidden = np.tanh(z[b] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-(hidden @ p[2] + p[3]))) - t[b]) / len(b)
            back = np.outer(error, p[2]) * (1 - hidden**2)
            step += 1
            for i, g in enumerate((z[b].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                rate = RATE * (1 - epoch / EPOCHS)
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8) - rate * DECAY * p[i]
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    held = check if 0 < check.sum() < len(y) else learn
    logits, truth = model.logits(x[held]), y[held]

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - truth * s))

    model.temperature = float(min(np.geomspace(0.25, 8, 80), key=loss))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all of docs, the network from at most `sample` labelled rows that aren't held out.

    Labels of one doc_id are averaged; of its rows in docs one is learnt from, that of the least text hash. Without labels
    every score is one half.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # 16 bytes a row
    sent = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            yield pd.Series([pooled(t or "", sent.value, known).tobytes() for t in texts])
        known.clear()
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(known), "doc_id")
    # one row for each id, however often it occurs: that of the least text hash
    rows = rows.select("doc_id", "quality", F.struct(F.xxhash64("text").alias("h"), features("text").alias("x")).alias("of"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("of").alias("of")).select("doc_id", "quality", "of.x").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], "f4") for r in rows], "f8").reshape(len(rows), 2 * DIM + 3)
    check = np.array([xxhash.xxh3_64_intdigest(str(r["doc_id"])) % 5 == 0 for r in rows], bool)
    y = np.array([r["quality"] for r in rows], "f8")
    rows.clear()
    sent.unpersist()
    release()
    return fit(vectors, x, y, check)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, the probability that a text is of quality 1; null texts are empty ones, equal texts have equal
    scores. A column of docs named score is replaced, null or repeated doc_ids make no difference, whole texts of any
    length count, and an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            yield pd.Series(sent.value.probabilities(list(texts), known), dtype="float64")
        known.clear()
        release()

    return docs.withColumn("score", score(F.col("text").cast("string")))


def good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all their columns as they were."""
    model = train(docs, labels)
    row = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return scored(row, model).where(F.col("score") >= threshold).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
