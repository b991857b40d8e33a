"""Texts cut into units that subword tokenizers never join, so that each distinct unit is encoded once.

A cut stands before a single space, or a single newline, whose neighbours on both sides are no white space. Byte-level
BPE (whose pre-tokenizer starts a word at such a space and keeps such a newline apart) and piece BPE (no piece holds a
space mark after another character, and a newline falls back to its byte) give a unit the same ids wherever it stands.
A text with any other white space between its words is *odd* and must be encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_MARK = "▁"


def odd_unit(unit: str) -> bool:
    """True if the unit cannot be encoded apart: no word, white space at an end, or a literal space mark."""
    word = unit[1:] if unit[:1] == "\n" else unit
    return not word or word[0].isspace() or word[-1].isspace() or SPACE_MARK in word


def odd_units(units: pa.Array) -> np.ndarray:
    """:func:`odd_unit` for all units of an array."""
    words = pc.replace_substring_regex(units, "^\n", "")
    sizes = pc.binary_length(words)
    trimmed = pc.binary_length(pc.utf8_trim_whitespace(words))
    odd = pc.or_(pc.or_(pc.equal(sizes, 0), pc.not_equal(sizes, trimmed)), pc.match_substring(words, SPACE_MARK))
    return odd.to_numpy(zero_copy_only=False)


def split_units(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets per text, distinct units, index of each unit): units carry a newline that stands before them, no space."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    encoded = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), encoded.dictionary, encoded.indices.to_numpy()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[k], starts[k] + 1, ...`` of all ``lengths[k]`` elements, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class UnitCache:
    """Numbers of distinct units; ``learn`` gets the new ones in order of their numbers, ``forget`` drops all.

    At most ``limit`` units are remembered when a new batch begins, so memory does not grow with the input.
    """

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], limit: int = 300_000):
        self.learn, self.forget, self.limit = learn, forget, limit
        self.known: dict[str, int] = {}
        self.count = 0

    def numbers(self, units: pa.Array) -> np.ndarray:
        """Number of each unit, -1 for odd ones."""
        if len(self.known) > self.limit:
            self.known.clear()
            self.count = 0
            self.forget()
        known, names, new = self.known, units.to_pylist(), []
        for name in names:
            if name not in known:
                odd = odd_unit(name)
                known[name] = -1 if odd else self.count
                if not odd:
                    new.append(name)
                    self.count += 1
        if new:
            self.learn(new)
        return np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))
