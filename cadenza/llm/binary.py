"""Token ids as binary files: each document compressed by itself with a shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import new_path, table, written
from cadenza.llm.units import Known, Runs, plain, units_of

#: A file: MAGIC, sha256 of the dictionary, the documents' frames, then the index and its length.
MAGIC = b"CADIDS01"
#: Index entry of a document: frame offset, frame length, ids; doc_id and whether it is null.
ENTRY = np.dtype([("at", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("doc_id", "<i8"), ("null", "u1")])
#: The dictionary is trained on this many pieces of texts at most (those of smallest hash), of this many characters.
SAMPLE_PIECES, PIECE_CHARS, DICT_BYTES = 600, 4000, 32_768
#: A worker forgets its units beyond this many.
KNOWN_UNITS = 1_000_000
#: Units asked for in one text.
LOT = 500


class Encoder:
    """The tokenizers library, asked once for each distinct unit of ordinary texts."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.new: list[str] = []
        self.unit, self.ids = Known(self._number), Runs()
        if self.line is not None:
            self.unit["\n"] = 0
            self.ids.add(np.ones(1, "i8"), np.full(1, self.line, "<u4"))

    def _number(self, unit: str) -> int:
        self.new.append(unit)
        return self.ids.count + len(self.new) - 1

    def plain(self, text: str) -> bool:
        return self.line is not None and not any(s in text for s in self.special) and plain(text)

    def learn(self) -> None:
        """One call for all new units: joined by line ends, each of which is an id by itself."""
        units, self.new = self.new, []
        lots = ["\n".join(units[i : i + LOT]) for i in range(0, len(units), LOT)]
        found = self.library.encode_batch_fast(lots, add_special_tokens=False)
        ids = np.concatenate([x for e in found for x in ([self.line], np.array(e.ids, "<u4"))][1:])
        ends = np.append(np.flatnonzero(ids == self.line), len(ids))
        lens = np.diff(ends, prepend=-1) - 1
        if len(lens) != len(units):
            raise ValueError("a unit holds a line end")
        self.ids.add(lens, ids[ids != self.line])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.unit) > KNOWN_UNITS:
            self.clear()
        split = [units_of(t) if self.plain(t) else None for t in texts]
        codes = [np.fromiter(map(self.unit.__getitem__, s), "<i4", len(s)) for s in split if s is not None]
        if self.new:
            self.learn()
        flat, n = self.ids.of(np.concatenate(codes)) if codes else (np.zeros(0, "<u4"), np.zeros(0, "i8"))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, codes)])]
        known = iter([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") if s is None else next(known) for t, s in zip(texts, split, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def train(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; with too few samples to train on, their plain bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


MANIFEST = "file int, path string, docs bigint, ids bigint"


def write_file(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, raw: bytes, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """Encodes a task's sorted (doc_id, text) and streams them to one file, which takes its name when it is whole."""
    (fs, root), number = store(folder), TaskContext.get().partitionId()
    own, shared = encoder(vocabulary), _dictionary(raw)
    if shared:
        shared.precompute_compress(level=1)
    press = zstandard.ZstdCompressor(dict_data=shared) if shared else zstandard.ZstdCompressor(level=1)
    tail = np.array([] if end_id is None else [end_id], "<u4")
    name, out, index, at = f"{root}/.{uuid.uuid4().hex}", None, [], 40
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name)
                out.write(MAGIC + hashlib.sha256(raw).digest())
            texts = [t or "" for t in part.column(1).to_pylist()]
            entries = np.zeros(len(texts), ENTRY)
            for e, doc_id, ids in zip(entries, part.column(0).to_pylist(), own.encode(texts), strict=True):
                frame = press.compress(np.concatenate([ids, tail]).astype("<u4", copy=False).tobytes())
                out.write(frame)
                e["at"], e["bytes"], e["ids"], e["doc_id"], e["null"] = at, len(frame), len(ids) + len(tail), doc_id or 0, doc_id is None
                at += len(frame)
            index.append(entries)
    if out is not None:
        entries = np.concatenate(index)
        out.write(entries.tobytes())
        out.write(struct.pack("<Q", len(entries)))
        out.close()
        final = f"{root}/part-{number:06d}.ids"
        fs.move(name, final)
        columns = [pa.array([number], pa.int32()), pa.array([final]), pa.array([len(entries)], pa.int64()), pa.array([int(entries["ids"].sum())], pa.int64())]
        yield pa.record_batch(columns, names=["file", "path", "docs", "ids"])


class Reader:
    """Documents of one file by place, without reading the others."""

    def __init__(self, folder: str, path: str, raw: bytes) -> None:
        fs, _ = store(folder)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if self.file.read_at(40, 0) != MAGIC + hashlib.sha256(raw).digest():
            raise ValueError(f"{path} is no id file of this dictionary")
        (n,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, size - 8 - n * ENTRY.itemsize), ENTRY)
        self.press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def ids(self, i: int) -> np.ndarray:
        e = self.index[i]
        return np.frombuffer(self.press.decompress(self.file.read_at(int(e["bytes"]), int(e["at"])), max_output_size=max(1, 4 * int(e["ids"]))), "<u4")


def read_files(batches: Iterator[pa.RecordBatch], folder: str, raw: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids) of each document of the files in (path, base)."""
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            reader = Reader(folder, path, raw)
            starts = base + np.cumsum(reader.index["ids"], dtype="i8") - reader.index["ids"]
            for at in range(0, len(reader.index), 500):
                part = range(at, min(at + 500, len(reader.index)))
                e = reader.index[at : at + 500]
                yield pa.record_batch(
                    [pa.array(e["doc_id"], pa.int64(), mask=e["null"] > 0), pa.array(starts[at : at + 500], pa.int64()), pa.array(e["ids"].astype("i8")), pa.array([reader.ids(i).tobytes() for i in part], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


def pieces(docs: DataFrame, most: int = SAMPLE_PIECES, chars: int = PIECE_CHARS) -> list[str]:
    """At most `most` pieces of `chars` characters, those of smallest hash among the pieces of all whole texts."""
    some = docs.where("text <> ''").withColumn("h", F.xxhash64("text"))
    count = F.ceil(F.length("text") / chars)
    n = max(1, some.agg(F.sum(count)).first()[0] or 0)
    key = lambda i: F.xxhash64("h", i)
    picked = F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.struct(key(i).alias("key"), i.alias("i"))), lambda x: F.pmod(x["key"], F.lit(n)) < 2 * most)
    some = some.select("text", F.explode(picked).alias("x")).select("x.key", F.expr(f"substring(text, cast(x.i as int) * {chars} + 1, {chars})").alias("piece"))
    return [r["piece"] for r in some.orderBy("key", "piece").limit(most).collect()]


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 2) -> tuple[DataFrame, bytes]:
    """Write the ids of docs (doc_id, text) to files in `folder`, in ascending doc_id order over all files.

    Returns the manifest (file, path, docs, ids) and the dictionary, which also lies in the folder as
    `dictionary`. A null text is an empty one, null doc_ids come first, rows of one doc_id are ordered by
    a hash of their texts; other columns aren't read. `folder` must be one that driver and executors share
    and pyarrow can open (file, hdfs, s3, gs). Texts are dealt by ranges of doc_id and text hash, so that an id
    with very many rows is split too, to as many files as the session has shuffle partitions, small ones put
    together; a task encodes, compresses and streams its file, and holds only the file's index.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    raw = train([x.tobytes() for x in encoder(vocabulary).encode(pieces(docs))])
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as out:
        out.write(raw)
    sent = spark.sparkContext.broadcast((vocabulary, raw))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ordered.mapInArrow(lambda it: write_file(it, folder, *sent.value, end_id), MANIFEST), "manifest"), raw


def read_ids(manifest: DataFrame, folder: str, raw: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; start counts the ids of those before it."""
    sent = manifest.sparkSession.sparkContext.broadcast(raw)
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).cast("bigint").alias("base"))
    files = files.repartition(max(1, manifest.count()))
    return files.mapInArrow(lambda it: read_files(it, folder, sent.value), "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    manifest, raw = write_ids(table(spark, sf_dir, "documents"), folder, vocabulary, end_id=2)
    return read_ids(manifest, folder, raw).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
