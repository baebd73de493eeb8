"""Alignment of two tokenizers: elementary intervals of their token ends, groups between shared ends, linked id pairs."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import release, table, written
from cadenza.llm.units import Known, Runs, gather, plain

#: White space as tokenizers see it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A lot of documents ends at this many bytes of text or documents; a worker forgets its units beyond this many, or characters of them.
LOT_BYTES, LOT_DOCS, KNOWN_UNITS, KNOWN_CHARS = 8 << 20, 50_000, 400_000, 32 << 20
#: Words asked for in one text.
JOINED = 500
LINKS = ("ends", "overlaps", "products")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising arrays of token ends over the same bytes: the token of either that owns each elementary interval, and
    whether both end with it, which closes a group."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


def linked(a: np.ndarray, b: np.ndarray, closes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens that end together, overlap, or stand in one group, from what intervals() gives."""
    if kind == "overlaps":
        return a, b
    if kind == "ends":
        return a[closes], b[closes]
    if kind != "products":
        raise ValueError(f"links are one of {LINKS}")
    last_a, last_b = a[closes], b[closes]
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    place = np.arange((n_a * n_b).sum()) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
    each = np.repeat(n_b, n_a * n_b)
    return np.repeat(last_a - n_a + 1, n_a * n_b) + place // each, np.repeat(last_b - n_b + 1, n_a * n_b) + place % each


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, asked once for each distinct unit: a run of white space and the word after it.

    Tokens of neither begin before a run of white space and end in it, so units are encoded and aligned by themselves; a
    text with a sign that breaks this rule, such as CR, is one unit.
    A unit is spoilt if the bytes of its tokens aren't its own.
    """

    def __init__(self, vocabulary: str, model: bytes, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.kind, self.a, self.b = kind, Tokenizer.from_str(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        signs, size = byte_signs(), self.b.get_piece_size()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = self.b.id_to_piece(list(range(size)))
        spelt_a = [bytes(map(signs.__getitem__, t)) if all(c in signs for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        spelt_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = (np.array(x, object) for x in (spelt_a, spelt_b))
        self.lens_a, self.lens_b = (np.array(list(map(len, x)), "i8") for x in (spelt_a, spelt_b))
        self.named_a, self.named_b = (np.array([[b"%d%c" % (i, sign) for i in range(len(x))] for sign in signs_], object) for x, signs_ in ((spelt_a, b",|"), (spelt_b, b",;")))
        self.line_a = self.a.encode("\n", add_special_tokens=False).ids[0]
        self.line_b = self.b.encode("\n")[-1]
        self.space = self.b.piece_to_id("▁")
        joined = [m for i, p in enumerate(pieces) if not self.b.is_control(i) for m in re.findall(f"(?<=[^{WHITE}▁])[{WHITE}▁]|(?<=▁)[{WHITE}]", p)]
        if self.b.is_unknown(self.space) or "▁" in joined or " " in joined:
            raise ValueError("the second tokenizer joins words")
        # texts with white space that pieces hold after other signs, or that is white to some only, are one unit
        self.whole = re.compile(f"[\x1c-\x1f{re.escape(''.join(set(joined)))}]")
        self.clear()

    def clear(self) -> None:
        self.new, self.chars = [], 0
        self.unit, self.pair = Known(self._number), Known(lambda code: len(self.pair))
        self.sizes, self.names, self.links = Runs(), [], Runs()

    def full(self) -> bool:
        return len(self.unit) > KNOWN_UNITS or self.chars > KNOWN_CHARS

    def _number(self, unit: str) -> int:
        self.new.append(unit)
        self.chars += len(unit)
        return len(self.unit)

    def split(self, text: str) -> list[str]:
        """The units of a text with a space before it."""
        if plain(text) and "\0" not in text:
            return f" {text}".replace("\n", "\0\n").replace(" ", "\0 ").split("\0")[1:]
        return [f" {text}"] if self.whole.search(text) else UNIT.findall(f" {text}")

    def encoded(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both tokenizers, all units' ids in a row and the count of each unit; words after single spaces are asked for
        together, with line ends between."""
        together = np.array([len(u) > 1 and u[0] == " " and not u[1].isspace() and "\n" not in u for u in units])
        joined, single = list(itertools.compress(units, together)), list(itertools.compress(units, ~together))
        joint = ["\n".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
        place = np.empty(len(units), "i8")
        place[np.flatnonzero(together)] = np.arange(len(joined))
        place[np.flatnonzero(~together)] = len(joined) + np.arange(len(single))
        out = []
        for ask, line in ((self.ask_a, self.line_a), (self.ask_b, self.line_b)):
            many = np.fromiter(itertools.chain.from_iterable([*ids, line] for ids in ask(joint)), "i8")
            ends, few = np.flatnonzero(many == line), ask(single)
            lens = np.concatenate([np.diff(ends, prepend=-1) - 1, np.fromiter(map(len, few), "i8", len(few))])
            flat = np.concatenate([many[many != line], np.fromiter(itertools.chain.from_iterable(few), "i8")])
            out.append(gather(np.cumsum(lens) - lens, lens, flat, place))
        return out

    def ask_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_b(self, texts: list[str]) -> list[list[int]]:
        """The library puts a space before every text: the text's own, if it begins with one, else it is taken off."""
        found = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        return [ids[1:] if t[:1] != " " else ids if len(t) > 1 else [self.space] for t, ids in zip(texts, found, strict=True)]

    def spelt(self, units: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether the tokens' bytes are those of each unit; all are looked at together first."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        size, whole, good = np.fromiter(map(len, raw), "i8", len(raw)), b"".join(raw), np.ones(len(units), bool)
        for (ids, n), table, lens in zip(found, (self.bytes_a, self.bytes_b), (self.lens_a, self.lens_b), strict=True):
            until = np.concatenate([[0], np.cumsum(lens[ids])])[np.cumsum(n)]
            if b"".join(table[ids]) != whole or (np.diff(until, prepend=0) != size).any():
                starts = np.cumsum(n) - n
                good &= np.array([b"".join(table[ids[i : i + k]]) == r for i, k, r in zip(starts.tolist(), n.tolist(), raw, strict=True)])
        return good

    def learn(self) -> None:
        """Encodes and aligns all new units at once."""
        units, self.new = self.new, []
        found = self.encoded(units)
        good = self.spelt(units, found)
        if not good.all():
            found = [(ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in found]
        (a, n_a), (b, n_b) = found
        own_a, own_b, closes = intervals(np.cumsum(self.lens_a[a]), np.cumsum(self.lens_b[b]))
        from_a, from_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        last_a, last_b = own_a[closes] + 1, own_b[closes] + 1  # where groups end, as counts of tokens
        group = np.searchsorted(last_a, from_a, "right")  # units end where groups do

        # the tokens of all groups in a row, A's before B's, each spelt with the sign that follows it
        group_a, group_b = (np.searchsorted(last, np.arange(len(x)), "right") for last, x in ((last_a, a), (last_b, b)))
        items = np.empty(len(a) + len(b), object)
        items[np.arange(len(a)) + np.concatenate([[0], last_b])[group_a]] = self.named_a[np.isin(np.arange(1, len(a) + 1), last_a).astype(int), a]
        items[np.arange(len(b)) + last_a[group_b]] = self.named_b[np.isin(np.arange(1, len(b) + 1), last_b).astype(int), b]
        text, ends = b"".join(items), np.concatenate([[0], np.cumsum(np.fromiter(map(len, items), "i8", len(items)))])[from_a + from_b].tolist()
        self.names += [text[lo : max(lo, hi - 1)] for lo, hi in itertools.pairwise(ends)]

        sizes = np.column_stack([n_a, n_b, np.diff(group), ~good])
        self.sizes.add(np.full(len(units), sizes.shape[1]), sizes.ravel())
        link_a, link_b = linked(own_a, own_b, closes, self.kind)
        codes, which = np.unique((a[link_a] << 32) | b[link_b], return_inverse=True)
        numbers = np.fromiter(map(self.pair.__getitem__, codes.tolist()), "<u4", len(codes))
        self.links.add(np.diff(np.searchsorted(link_a, from_a)), numbers[which])

    def codes(self, texts: list[str]) -> list[np.ndarray | None]:
        """The units of each text by number; None where the text has no tokens."""
        out = []
        for text in texts:
            units = self.split(text) if text else []
            out.append(np.fromiter(map(self.unit.__getitem__, units), "i8", len(units)) if units else None)
        if self.new:
            self.learn()
        spoilt = self.figures()[:, 3] > 0
        return [None if c is None or spoilt[c].any() else c for c in out]

    def spans(self, text: str) -> tuple[list[int], list[int], list[dict]]:
        """The ids of both for a text, and its groups."""
        if not text:
            return [], [], []
        whole = [f" {text}"]
        a, b = (np.array(ask(whole)[0], "i8") for ask in (self.ask_a, self.ask_b))
        if not self.spelt(whole, [(a, np.array([len(a)])), (b, np.array([len(b)]))]).all():
            return [], [], []
        ends = np.cumsum(self.lens_a[a]), np.cumsum(self.lens_b[b])
        last_a, last_b = linked(*intervals(*ends), "ends")
        sizes = zip(np.diff(last_a, prepend=-1).tolist(), np.diff(last_b, prepend=-1).tolist(), ends[0][last_a].tolist(), strict=True)
        return a.tolist(), b.tolist(), [{"a": x, "b": y, "end": e} for x, y, e in sizes]

    def figures(self) -> np.ndarray:
        """Of each unit: its tokens of either, its groups, and whether it is spoilt."""
        return self.sizes.flat[: self.sizes.used].reshape(-1, 4)


_aligners: dict[tuple, Aligner] = {}


def aligner(vocabulary: str, model: bytes, kind: str) -> Aligner:
    """One for each Python worker, kept from task to task."""
    key = (hashlib.sha256(vocabulary.encode()).digest(), hashlib.sha256(model).digest(), kind)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(vocabulary, model, kind)
    return _aligners[key]


LOT = "lot bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, hash array<string>, pair array<bigint>, times array<bigint>, which binary"
_LOT = pa.schema(
    [("lot", pa.int64())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("hash", pa.list_(pa.string())), ("pair", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("which", pa.binary())]
)


def lots(batches: Iterator[pa.RecordBatch], vocabulary: str, model: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    """A row for each lot of (doc_id, text): figures by document, the lot's distinct id pairs and how often, and the pair of
    each link, compressed."""
    own, press = aligner(vocabulary, model, kind), zstandard.ZstdCompressor(level=1)
    number, docs, links, size = TaskContext.get().partitionId() << 32, [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal number, docs, links, size
        every = np.concatenate(links)
        seen = np.bincount(every, minlength=len(own.pair))
        found, which = np.flatnonzero(seen), (np.cumsum(seen > 0) - 1)[every]
        codes, times = np.fromiter(own.pair, "i8", len(own.pair))[found], seen[found]
        packed = press.compress(which.astype("<u2" if len(found) <= 1 << 16 else "<u4").tobytes())
        columns = [[x] for x in zip(*docs, strict=True)]
        row = [[number], *columns, [codes], [times], [packed]]
        number, docs, links, size = number + 1, [], [], 0
        if own.full():
            own.clear()
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(row, _LOT, strict=True)], schema=_LOT)

    for batch in batches:
        for at in range(0, batch.num_rows, 50):
            part = batch.slice(at, 50)
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = own.codes(texts)
            figures = own.figures()[:, :3]
            for doc_id, text, codes in zip(part.column(0).to_pylist(), texts, found, strict=True):
                pairs, groups, sizes = np.zeros(0, "<u4"), "", [0, 0, 0]
                if codes is not None:
                    pairs, _ = own.links.of(codes)
                    groups = hashlib.sha256(b";".join(map(own.names.__getitem__, codes.tolist()))).hexdigest()
                    sizes = figures[codes].sum(0).tolist()
                docs.append((doc_id, *sizes, len(pairs), groups))
                links.append(pairs)
                size += len(text)
            if size > LOT_BYTES or len(docs) >= LOT_DOCS:
                yield close()
    if docs:
        yield close()
    release()


def scored(key: tuple, lot: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one lot, with what the counts of their linked pairs say."""
    row = lot.slice(0, 1).to_pylist()[0]
    order = np.argsort(pairs.column("at").to_numpy())
    n, best = pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy(zero_copy_only=False)[order]
    lens = np.array(row["n_links"], "i8")
    raw = zstandard.ZstdDecompressor().decompress(row["which"], max_output_size=max(1, 4 * int(lens.sum())))
    which = np.frombuffer(raw, "<u2" if len(row["pair"]) <= 1 << 16 else "<u4")
    ends = np.cumsum(lens)
    summed = lambda x: (y := np.concatenate([[0], np.cumsum(x, dtype="i8")]))[ends] - y[ends - lens]
    count, most = (summed(x[which]) if len(which) else np.zeros(len(lens), "i8") for x in (n, best))
    columns = [row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([pa.array(x, pa.int64()) for x in (*columns, most, count)] + [pa.array(row["hash"])], names=NAMES)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, a, b, n, best) over all lots: how many links hold the id pair linked, and whether no pair of its b has more."""
    each = found.select(F.inline(F.arrays_zip(F.col("pair"), F.col("times"))))
    per = each.groupBy("pair").agg(F.sum("times").alias("n"))
    per = per.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")
    return per.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # a row for each a at most


def align(docs: DataFrame, vocabulary: str, model: bytes, links: str = "ends") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text).

    A encodes a space and the text by the `vocabulary` of the tokenizers library, B the text by the sentencepiece `model`;
    special tokens' strings are plain text. Offsets where tokens of both end cut a text into groups. Linked are pairs of
    tokens that end together, overlap or stand in one group, see LINKS. A pair of ids counts how many links of all texts
    have it; n_best are the links whose count is the highest of their B id, count_sum adds the counts up.

    Texts that are null or empty, or whose tokens don't spell a space and the text, have no tokens: zeros and an empty
    hash. Rows that share a doc_id, or have none, are judged each by its own text. Other columns aren't read.

    A task encodes its documents in lots of about 8 MB, each with its distinct pairs and their counts, so a frequent pair
    is shuffled once for each lot and not for each document. Lots are written to the shared folder and meet the counts
    of their own pairs again; nothing is broadcast but the vocabularies.
    """
    if links not in LINKS:
        raise ValueError(f"links are one of {LINKS}")
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = written(texts.mapInArrow(lambda it: lots(it, *sent.value, links), LOT), "lots")
    wanted = found.select("lot", F.posexplode("pair").alias("at", "pair"))
    counted = wanted.join(pair_counts(found).select("pair", "n", "best"), "pair").select(F.col("lot").alias("of"), "at", "n", "best")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return found.drop("times").groupBy("lot").cogroup(counted.groupBy("of")).applyInArrow(scored, schema)


def groups(docs: DataFrame, vocabulary: str, model: bytes) -> DataFrame:
    """(doc_id, text, a_ids, b_ids, groups) of each row of docs: both tokenizers' ids, and of each group how many of either
    it takes and where it ends in the bytes of a space and the text. Texts without tokens have empty arrays."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*sent.value, "ends")
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                rows = [own.spans(t or "") for t in part.column(1).to_pylist()]
                a, b, ends = zip(*rows, strict=True)
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("end", pa.int64())])))
                yield pa.record_batch([*part.columns, *[pa.array(x, k) for x, k in zip((a, b, ends), kinds, strict=True)]], names=["doc_id", "text", "a_ids", "b_ids", "groups"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(each, "doc_id bigint, text string, a_ids array<int>, b_ids array<int>, groups array<struct<a:int,b:int,end:bigint>>")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        vocabulary = file.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    return align(table(spark, sf_dir, "documents"), vocabulary, model)
