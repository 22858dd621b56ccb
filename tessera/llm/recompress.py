"""Recompression of token sequences: rounds that name runs and pairs of neighbours, the same everywhere.

Round 0 names every run of one token as one symbol. Each later round splits the symbols into left and right ones by a bit
of their name and names every left symbol with a right one after it as one symbol. Names are hashes of what they name,
so equal substrings of any two documents, wherever they are worked on, get the same symbols except near their ends.

How near is tracked: ``low`` and ``high`` bound the words that a symbol depends on. Two occurrences of the same words
hold every symbol with those bounds inside them in common.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import textkernel as tk

U64 = np.uint64


@dataclass
class Symbols:
    name: np.ndarray
    begin: np.ndarray  # first word
    low: np.ndarray  # bounds of the words it depends on
    high: np.ndarray
    doc: np.ndarray


def runs(words: np.ndarray, doc: np.ndarray) -> Symbols:
    """Maximal runs of a word in a document as one symbol; a symbol depends on the word before and the one after."""
    n = len(words)
    new = np.ones(n, bool)
    if n:
        new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    size = (end - begin).astype(np.uint64)
    name = words[begin].copy()
    long = size > 1
    name[long] = tk.mix(name[long] + size[long] * U64(0xA0761D6478BD642F))
    return Symbols(name, begin, begin - 1, end + 1, doc[begin])


def pairs(s: Symbols, bit: int) -> Symbols:
    """One round of pair naming. A pair depends on its own words; a symbol left alone also on the neighbour that might
    have joined it. A symbol at a document's end already depends on that end."""
    n = len(s.name)
    if n < 2:
        return s
    right = ((s.name >> U64(bit)) & U64(1)).astype(bool)
    join = np.zeros(n, bool)
    join[:-1] = ~right[:-1] & right[1:] & (s.doc[1:] == s.doc[:-1])
    keep = np.ones(n, bool)
    keep[1:] = ~join[:-1]
    at = np.flatnonzero(keep)
    joined = join[at]
    last = at + joined
    name = s.name[at].copy()
    name[joined] = tk.mix(name[joined] * U64(0x9FB21C651E98DF25) + s.name[last[joined]] + U64(bit))
    low, high = s.low[at].copy(), s.high[last].copy()
    before, after = np.maximum(at - 1, 0), np.minimum(last + 1, n - 1)
    lone_right, lone_left = ~joined & right[at], ~joined & ~right[at]
    same = (s.doc[before] == s.doc[at]) & (at > 0)
    low[lone_right] = np.where(same, s.low[before], low)[lone_right]
    same = (s.doc[after] == s.doc[at]) & (last < n - 1)
    high[lone_left] = np.where(same, s.high[after], high)[lone_left]
    return Symbols(name, s.begin[at], low, high, s.doc[at])


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int) -> Symbols:
    s = runs(words, doc)
    for k in range(rounds):
        s = pairs(s, 7 + 5 * k)
    return s


def bigrams(s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of neighbouring symbols of a document, what they depend on, and the number of the first of the two."""
    at = np.flatnonzero(s.doc[1:] == s.doc[:-1]) if len(s.name) > 1 else np.zeros(0, np.int64)
    return tk.mix(s.name[at] * U64(0x8CB92BA72F3D8DD7) + s.name[at + 1]), s.low[at], s.high[at + 1], at
