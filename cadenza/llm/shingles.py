"""Hashes of word shingles, stable over processes and machines."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from cadenza.llm.common import release

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
KNOWN_WORDS = 500_000
_known: dict[str, int] = {}
#: Odd 64-bit constants: the base of the rolling polynomial and the two of the finalizer.
BASE, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(29))) * MIX_2
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    out = list(map(_known.get, words))
    if None in out:
        if len(_known) > KNOWN_WORDS:
            _known.clear()
        for w in {w for w, h in zip(words, out, strict=True) if h is None}:
            _known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        out = [h if h is not None else _known[w] for w, h in zip(words, out, strict=True)]
    return np.array(out, "u8")


def forget() -> None:
    """At the end of a task: an idle worker holds no words."""
    _known.clear()
    release()


def shingles(words: list[str], size: int = 5) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of `size` words; of all words together if they are fewer; none for no words."""
    if not words:
        return np.zeros(0, "u8")
    h = word_hashes(words)
    size = min(size, len(h))
    with np.errstate(over="ignore"):
        runs = np.full(len(h) - size + 1, size, "u8")
        for i in range(size):
            runs = runs * BASE + h[i : i + len(runs)]
        return np.unique(mixed(runs))
