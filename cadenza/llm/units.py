"""Texts as numbered units: what stands between single spaces and line ends, split once for each distinct unit."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import regex

#: Texts that hold none of these, and no white space at their ends, are units with at most one space
#: before each, and single line ends.
ODD = ("  ", "\n\n", " \n", "\n ", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"))
UNIT = re.compile(r"\n| ?[^ \n]+")
#: Words cut at once.
LOT = 10_000


def plain(text: str) -> bool:
    return text[:1] not in (" ", "\n") and text[-1:] not in (" ", "\n") and not any(x in text for x in ODD)


def units_of(text: str) -> list[str]:
    """The units of a plain text; what UNIT finds, by two replacements and a split."""
    if "\0" in text or not text:
        return UNIT.findall(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


class Known(dict):
    """Numbers of keys; a key not met before is given to `learn`."""

    def __init__(self, learn: Callable[[str], int]) -> None:
        self.learn = learn

    def __missing__(self, key: str) -> int:
        self[key] = n = self.learn(key)
        return n


class Units:
    """Numbers of distinct units and of the pieces of their words, over the texts seen so far.

    A pattern of the byte-level kind starts a new word at a single space between other characters and
    makes a single line end a word by itself, so units can be split apart from each other. Other texts
    are split whole, their words standing as units. `cut` parts many words into pieces at once, LOT of them, as
    it takes some hundred bytes for each of theirs.
    """

    def __init__(self, pattern: str, cut: Callable[[list[bytes]], tuple[bytes, np.ndarray, np.ndarray]]) -> None:
        self.find, self.cut = regex.compile(pattern).findall, cut
        self.piece: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        """Start anew to number units, once take() has given them; pieces keep their numbers."""
        self.words, self.counts, self.count = [], array("i"), 0
        # a word of an odd text is kept apart from a unit of the same letters
        self.unit = Known(lambda key: self._new(self.find(key)))
        self.odd = Known(lambda key: self._new([key]))

    def _new(self, words: list[str]) -> int:
        self.words += words
        self.counts.append(len(words))
        self.count += 1
        return self.count - 1

    def codes(self, text: str) -> np.ndarray:
        found, known = (units_of(text), self.unit) if plain(text) else (self.find(text), self.odd)
        return np.fromiter(map(known.__getitem__, found), "<i4", len(found))

    def take(self) -> tuple[list[bytes], bytes, bytes]:
        """What is new since the last call: pieces, and of units the counts of their pieces, and these pieces."""
        known, fresh, numbers, n = self.piece, [], array("i"), [np.zeros(1, "i8")]
        for lot in range(0, len(self.words), LOT):
            flat, cuts, pieces = self.cut([w.encode("utf-8", "surrogatepass") for w in self.words[lot : lot + LOT]])
            n.append(pieces)
            a = 0
            for b in cuts.tolist():
                piece, a = flat[a:b], b
                at = known.get(piece)
                if at is None:
                    at = known[piece] = len(known)
                    fresh.append(piece)
                numbers.append(at)
        lens = np.diff(np.cumsum(np.concatenate(n))[np.cumsum(self.counts, dtype="i8")], prepend=0).astype("<i4")
        self.words, self.counts = [], array("i")
        return fresh, lens.tobytes(), numbers.tobytes()


def gather(starts: np.ndarray, lens: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that `which` names, in a row, and their lengths."""
    n = lens[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[which] - (ends - n), n) + np.arange(total)], n


class Runs:
    """Runs of numbers that are added to."""

    def __init__(self) -> None:
        self.flat, self.lens, self.starts, self.used, self.count = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, "i8"), np.zeros(1 << 14, "i8"), 0, 0

    def add(self, lens: np.ndarray, flat: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lens) > len(self.lens):
            self.lens, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.starts))
        self.flat[self.used : self.used + len(flat)] = flat
        at = slice(self.count, self.count + len(lens))
        self.lens[at] = lens
        self.starts[at] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.count += len(lens)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.starts, self.lens, self.flat, which)
