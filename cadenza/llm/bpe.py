"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import partitions_of, release, table
from cadenza.llm.units import Runs, Units, gather

#: A lot of texts closes at this many characters.
LOT_CHARS = 400_000
#: Beyond this many a task forgets its units, which are split again then, or its pieces as well, which are folded again.
KNOWN_UNITS, KNOWN_PIECES = 250_000, 500_000
#: Input of a task, so that a word that recurs is folded once for as much text.
TASK_BYTES = 64 << 20
#: A piece beyond this many bytes that can't be cut is merged by a heap, as a fold takes the square of its length.
FOLD_BYTES = 1024
#: Buckets of the literal rank map, a power of two; the code point that names the first token.
BUCKETS, FIRST = 1 << 14, 0x10000


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank, from a file of `base64 rank` lines."""
    pairs = (line.split() for line in open(path, "rb") if line.strip())
    ranks = {int(rank): base64.b64decode(word) for word, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


class Cutter:
    """Parts words where no token reaches across, so that fewer and shorter pieces are left to merge.

    A merge makes a token, so none can join what stands on either side of such a place. The longest token
    from each byte on is found for all words at once, by steps down a tree of the tokens' bytes.
    """

    def __init__(self, words: list[bytes]) -> None:
        node: dict[bytes, int] = {}
        for w in words:
            for n in range(1, len(w) + 1):
                node.setdefault(w[:n], len(node))
        whole = set(words)
        self.is_token = np.array([x in whole for x in node])
        self.first = np.array([node.get(bytes([b]), -1) for b in range(256)], "i4")
        pairs = sorted((node[x[:-1]] << 8 | x[-1], n) for x, n in node.items() if len(x) > 1)
        self.keys, self.to = np.array(pairs, "i4").reshape(-1, 2).T.copy()

    def __call__(self, words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words in a row, where their pieces end in it, and how many pieces each has."""
        flat, ends = b"".join(words), np.cumsum([len(w) for w in words], dtype="i8")
        data = np.frombuffer(flat, "u1").astype("i4")
        stop = np.repeat(ends, np.diff(ends, prepend=0))
        reach = np.arange(1, len(data) + 1)
        at, state = np.arange(len(data)), self.first[data]
        for n in range(1, len(data)):
            keep = (at + n < stop[at]) & (state >= 0)
            at, state = at[keep], state[keep]
            if not len(at):
                break
            key = state << 8 | data[at + n]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            state = np.where(self.keys[place] == key, self.to[place], -1)
            met = (state >= 0) & self.is_token[state]
            reach[at[met]] = at[met] + n + 1
        cuts = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, len(data) + 1)) + 1
        return flat, cuts, np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one very long piece: always the leftmost pair of lowest rank, by a heap over linked pieces."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (r := rank.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or end[j] != stop:
            continue
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i < n:
        out.append(rank[word[i : end[i]]])
        i = after[i]
    return out


def rank_map(words: list[bytes]) -> Column:
    """Literal struct. `names`: a character for each token, that of a single byte its own; `bytes`: the ids of single
    bytes; `ranks`: for the names of two tokens that together are one its rank, dealt to buckets by crc32.
    """
    rank = {w: i for i, w in enumerate(words)}
    if len(rank) != len(words) or len(words) > 1_000_000 or any(bytes([b]) not in rank for b in range(256)):
        raise ValueError("ranks must be distinct, a million at most, and hold every single byte")
    names = [w.decode("latin-1") if len(w) == 1 else chr(FIRST + i) for i, w in enumerate(words)]
    lots: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for r, w in enumerate(words):
        for i in range(1, len(w)):
            a, b = rank.get(w[:i]), rank.get(w[i:])
            if a is not None and b is not None:
                pair = names[a] + names[b]
                lots[zlib.crc32(pair.encode()) % BUCKETS][pair] = r
    value = {"names": names, "bytes": [rank[bytes([b])] for b in range(256)], "ranks": lots}
    return F.from_json(F.lit(json.dumps(value)), "names array<string>, bytes array<int>, ranks array<map<string,int>>")


def fold_sql(word: str) -> str:
    """SQL for array<int>: the ids of `word` (binary); `m` is the rank map.

    The state is the word's pieces, each by the character that names it, bytes at first. A step looks up every two
    neighbours and joins those of lowest rank, the leftmost of these: the token of that rank takes their place.
    """
    pair = "substring(s, i, 2)"
    rank = f"get(m.ranks, cast(crc32(cast({pair} as binary)) & {BUCKETS - 1} as int))[{pair}]"
    least = f"array_min(transform(sequence(1, length(s) - 1), i -> shiftleft(cast({rank} as bigint), 20) | i))"
    joined = "overlay(s placing get(m.names, cast(shiftright(b, 20) as int)) from cast(b & 1048575 as int) for 2)"
    step = f"if(length(s) < 2, s, aggregate(array({least}), s, (z, b) -> if(b is null, s, {joined})))"
    ids = f"transform(transform(sequence(1, length(s)), i -> ascii(substring(s, i, 1))), c -> if(c < 256, get(m.bytes, c), c - {FIRST}))"
    folded = f"aggregate(sequence(2, greatest(2, length({word}))), decode({word}, 'ISO-8859-1'), (s, x) -> {step}, s -> {ids})"
    # bound as a variable, the map stands in the plan once, not once for each use
    return f"if({word} is null, null, aggregate(array(m), cast(null as array<int>), (z, m) -> {folded}))"


#: A row is a new word (`word`, or the ids of one that is known), or a lot of texts: its new units as counts of words
#: and word numbers, its documents as unit numbers. `turn` changes when a task starts anew to number words, `unit_turn` when
#: it starts anew to number units.
CHUNK = "turn int, unit_turn int, word binary, known array<int>, unit_lens binary, unit_words binary, doc_id array<bigint>, n array<int>, codes binary"
_CHUNK = pa.schema(
    [
        ("turn", pa.int32()),
        ("unit_turn", pa.int32()),
        ("word", pa.binary()),
        ("known", pa.list_(pa.int32())),
        ("unit_lens", pa.binary()),
        ("unit_words", pa.binary()),
        ("doc_id", pa.list_(pa.int64())),
        ("n", pa.list_(pa.int32())),
        ("codes", pa.binary()),
    ]
)
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


def word_rows(words: list[bytes], turn: int, rank: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(words), 10_000):
        lot = words[at : at + 10_000]
        long = [len(w) > FOLD_BYTES for w in lot]
        word = pa.array([None if far else w for w, far in zip(lot, long, strict=True)], pa.binary())
        known = pa.array([merge(w, rank) if far else None for w, far in zip(lot, long, strict=True)], pa.list_(pa.int32()))
        # Spark sizes a batch up after each row, and walks every null at the end of a list column again each time; empty lists it passes over
        rest = [pa.array([[]] * len(lot), t) if pa.types.is_list(t) else pa.nulls(len(lot), t) for t in _CHUNK.types[4:]]
        yield pa.record_batch([pa.array([turn] * len(lot), pa.int32()), pa.nulls(len(lot), pa.int32()), word, known, *rest], schema=_CHUNK)


def chunks(batches: Iterator[pa.RecordBatch], pattern: str, words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK for texts (doc_id, text): a lot's new words stand before it."""
    cut, rank, turn, unit_turn = Cutter(words), {w: i for i, w in enumerate(words)}, 0, 0
    units, doc_ids, codes, size = Units(pattern, cut), [], [], 0

    def close() -> Iterator[pa.RecordBatch]:
        fresh, lens, parts = units.take()
        yield from word_rows(fresh, turn, rank)
        values = [turn, unit_turn, None, None, lens, parts, doc_ids, [len(c) for c in codes], np.concatenate(codes).tobytes()]
        yield pa.record_batch([pa.array([v], type=f.type) for v, f in zip(values, _CHUNK, strict=True)], schema=_CHUNK)

    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                doc_ids.append(doc_id)
                codes.append(units.codes(text or ""))
                size += len(text or "")
                if size >= LOT_CHARS:
                    yield from close()
                    doc_ids, codes, size = [], [], 0
                    if units.count >= KNOWN_UNITS:
                        units.forget()
                        unit_turn += 1
                        if len(units.piece) >= KNOWN_PIECES:
                            units.piece.clear()
                            turn += 1
    if doc_ids:
        yield from close()
    units, doc_ids, codes = Units(pattern, cut), [], []
    release()


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids) of the texts of a task, from its rows of CHUNK with `ids` for each word."""
    words, units, turn, unit_turn = Runs(), Runs(), 0, 0
    for batch in batches:
        turns = batch.column("turn").to_numpy(zero_copy_only=False)
        unit_turns = batch.column("unit_turn").fill_null(0).to_numpy(zero_copy_only=False)
        lots = np.flatnonzero(batch.column("codes").is_valid().to_numpy(zero_copy_only=False))
        at = 0
        for lot in [*lots.tolist(), batch.num_rows]:
            while at < lot:  # words up to the lot, or to the next turn
                if turns[at] != turn:
                    words, turn = Runs(), turns[at]
                stop = int(np.argmax(turns[at:lot] != turn)) + at if (turns[at:lot] != turn).any() else lot
                ids = batch.column("ids").slice(at, stop - at)
                words.add(ids.value_lengths().to_numpy(zero_copy_only=False), ids.flatten().to_numpy(zero_copy_only=False))
                at = stop
            if lot == batch.num_rows:
                break
            if turns[lot] != turn:
                words, turn = Runs(), turns[lot]
            if unit_turns[lot] != unit_turn:
                units, unit_turn = Runs(), unit_turns[lot]
            lens, parts, codes = (np.frombuffer(batch.column(c)[lot].as_buffer(), "<i4") for c in ("unit_lens", "unit_words", "codes"))
            flat, n = words.of(parts)
            ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lens)])]
            units.add(np.diff(ends), flat)
            doc_ids, counts = batch.column("doc_id")[lot].as_py(), batch.column("n")[lot].as_py()
            out, n = units.of(codes)
            borders = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
            blobs = [out[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False)]
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.diff(borders)), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])
            at = lot + 1


def unspell(batches: Iterator[pa.RecordBatch], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Adds `decoded`: the pieces of the ids in a row."""
    lens = np.array([len(w) for w in words], "i8")
    starts, flat = np.cumsum(lens) - lens, np.frombuffer(b"".join(words), "u1")
    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            out = [gather(starts, lens, flat, np.frombuffer(x.as_buffer(), "<u4"))[0].tobytes() for x in part.column("ids")]
            yield pa.record_batch([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])


def encode(docs: DataFrame, ranks: list[bytes], pattern: str, with_decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row's text, ids as little-endian unsigned 32-bit integers.

    with_decoded adds `decoded` as decode() does, from the ids, in the task that has just made them.

    A task streams its texts in lots of 400,000 characters, each after the words that are new in it; Spark
    folds the ranked merges over the bytes of these words, once a task for each (a task of very many words
    starts anew; it forgets its units, of which there are more, sooner), and the end of the same task spells the texts out. Nothing is shuffled or kept but the
    task's words. Words are cut where no token reaches across; a piece that is still over FOLD_BYTES, say a
    run of one letter, is merged by a heap, by the same ranks. A null text is an empty one; repeated rows and
    doc_ids, null doc_ids and texts of any length are rows like others; columns besides doc_id and text
    aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    known = spark.sparkContext.broadcast(ranks)
    rows = partitions_of(docs, TASK_BYTES).mapInArrow(lambda it: chunks(it, pattern, known.value), CHUNK)
    rows = rows.withColumn("m", rank_map(ranks))
    ids = F.expr(f"coalesce(known, {fold_sql('word')})")
    rows = rows.select("turn", "unit_turn", "unit_lens", "unit_words", "doc_id", "n", "codes", ids.alias("ids"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from unspell(spell(batches), known.value) if with_decoded else spell(batches)
        release()

    return rows.mapInArrow(finish, ENCODED + (", decoded binary" if with_decoded else ""))


def decode(encoded: DataFrame, ranks: list[bytes]) -> DataFrame:
    """encoded with `decoded`, the bytes that its ids stand for."""
    words = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(lambda it: unspell(it, words.value), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text."""
    ranks = read_ranks(vocabulary)
    both = encode(docs, ranks, pattern, with_decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
