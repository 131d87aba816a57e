"""Vectorised words, lines and rolling hashes over many texts at once (numpy, no loop over words)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE, _WBASE = U(0x9E3779B97F4A7C15 | 1), U(0xD1B54A32D192ED03 | 1)
_inv = lambda b: U(pow(int(b), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 4 << 20:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Prefix sums of a sequence from which the hash of any range follows in O(1)."""

    def __init__(self, values: np.ndarray, base: np.uint64):
        n = len(values)
        self.inverse = _inv(base)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * powers(base, n), out=self.sums[1:])
        self.n = n

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * powers(self.inverse, self.n + 1)[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts in one pass."""

    data: np.ndarray
    offsets: np.ndarray  # of texts in data
    solid: np.ndarray  # per byte: part of a word
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per text and once more: index of its first word
    doc: np.ndarray  # per word: index of its text

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def byte_sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def roller(self) -> Roller:
        return Roller(_TABLE[self.data], _BASE)

    def hashes(self) -> np.ndarray:
        return self.roller().ranges(self.starts, self.ends)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Per text, the sum of a per-word value."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> Words:
    """solid: which bytes words are made of, if not all but white space."""
    n = len(data)
    solid = ~_WS[data] if solid is None else solid
    before, after = np.ones(n + 1, bool), np.ones(n + 1, bool)
    before[1:] = ~np.append(solid, False)[:n]
    after[: max(n - 1, 0)] = ~solid[1:]
    before[offsets] = True
    after[np.maximum(offsets - 1, 0)[offsets > 0]] = True
    starts = np.flatnonzero(solid & before[:n])
    ends = np.flatnonzero(solid & after[:n]) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, solid, starts, ends, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, roller: Roller | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions where k consecutive words of one text start, and the hashes of these windows."""
    n = len(hashes)
    room = np.zeros(n + 1, np.int64)
    # a start is good if its text has k words from there
    size = np.diff(first)
    good = np.maximum(size - k + 1, 0)
    np.add.at(room, first[:-1], (good > 0).astype(np.int64))
    np.add.at(room, first[:-1] + good, -(good > 0).astype(np.int64))
    at = np.flatnonzero(np.cumsum(room)[:n] > 0)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    return at, (roller or Roller(hashes, _WBASE)).ranges(at, at + k)


def word_roller(hashes: np.ndarray) -> Roller:
    return Roller(hashes, _WBASE)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the positions 0..n-1 that lie in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:n] > 0
