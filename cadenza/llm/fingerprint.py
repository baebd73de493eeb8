"""Threshold-scaled sketches: every shingle hash below a fixed share of the hash range is kept."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import ranges, table
from cadenza.llm.shingles import WORDS, shingles

#: One hash in 2**SCALE_BITS is kept, as its next 40 bits.
SCALE_BITS = 2


#: Values from here on are hashes above the threshold.
ABOVE = np.uint64(1 << 40)


def sketch(text: str, scale_bits: int = SCALE_BITS) -> np.ndarray:
    """The kept hashes of a text's five-word shingles, ascending, 40 bits each. A text with words but no hash below the
    threshold keeps its smallest one as a stand-in, from ABOVE on, so that different short texts don't look alike. No words: none."""
    h = shingles(WORDS(text))
    kept = h[: max(1, int(np.searchsorted(h, np.uint64(1 << (64 - scale_bits)))))]
    return np.unique(kept >> np.uint64(24 - scale_bits)) if len(kept) else kept


def fingerprint(kept: np.ndarray) -> str:
    """Base64 of the kept hashes, big-endian, five bytes each; a stand-in takes six."""
    size = 6 if len(kept) == 1 and kept[0] >= ABOVE else 5
    return base64.b64encode(kept.astype(">u8").view("u1").reshape(-1, 8)[:, 8 - size :].tobytes()).decode()


def hashes(fingerprint_: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint_), "u1")
    raw = raw.reshape(-1, 6 if len(raw) == 6 else 5)
    return np.pad(raw, ((0, 0), (8 - raw.shape[1], 0))).copy().view(">u8").ravel().astype("u8")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together (but for shingles over the seam): a stand-in stays only if there is nothing else."""
    both = np.union1d(a, b)
    below = both[both < ABOVE]
    return below if len(below) else both[:1]


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty sketches are alike."""
    both = common(a, b)
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b holds, whatever their lengths; an empty a is contained."""
    return common(a, b) / len(a) if len(a) else 1.0


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double"


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of sorted (part, is_next, doc_id, text), each with the text that follows in its part."""
    names = [c.split()[0] for c in OUT.split(", ")]
    last = None
    for batch in batches:
        for lot in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            rows = []
            for part, is_next, doc_id, text in zip(*(c.to_pylist() for c in lot.columns), strict=True):
                text = text or ""
                own = sketch(text)
                if last and last[0] == part and not last[1]:
                    _, _, one, was, kept = last
                    half = len(was) // 2
                    edited = was[: len(was) - half] + text[:half]
                    new = kept if edited == was else sketch(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((one, len(was), digest, fingerprint(kept), fingerprint(new), likeness(kept, new), likeness(kept, own), containment(kept, new)))
                last = (part, is_next, doc_id, text, own)
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def with_next(docs: DataFrame) -> DataFrame:
    """(part, is_next, doc_id, text) in partitions sorted so that each row's next one by descending doc_id
    follows it in its part; the row that follows a part's last one is there once more as is_next.

    Null doc_ids come last, rows of one doc_id by descending hash of their texts; the last row is followed
    by the first. Parts are ranges of doc_id and hash, as many as the session has shuffle partitions, so nothing global
    is sorted in one task, nor all rows of an id that very many have.
    """
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    place, parts = ranges(docs, "doc_id", "tie")
    rows = docs.withColumn("part", place)
    first = rows.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    up, whole = Window.orderBy("part"), Window.partitionBy()
    first = first.select("part", "first", F.coalesce(F.lead("part").over(up), F.min("part").over(whole)).alias("also"))
    rows = rows.join(F.broadcast(first), "part")  # one row for each part
    is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    own, copy = F.struct("part", F.lit(False).alias("is_next")), F.struct(F.col("also").alias("part"), F.lit(True).alias("is_next"))
    rows = rows.select(F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("at"), "doc_id", "text", "tie")
    rows = rows.select("at.part", "at.is_next", "doc_id", "text", "tie")
    order = ["part", "is_next", F.col("doc_id").desc_nulls_last(), F.desc("tie")]
    return rows.repartitionById(parts, "part").sortWithinPartitions(*order).select("part", "is_next", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text (null: empty) and of its edited text, whose last half is the start
    of the next row's text; see OUT for the columns. Other columns of docs aren't read."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return with_next(docs).mapInArrow(pairs, OUT)


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
