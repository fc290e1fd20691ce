"""Vectorised text features for Arrow batches: code points, words and n-gram hashes of many texts at once.

Texts are laid end to end with a separator before and LONGEST after each. The range of a text holds all of these, and the
windows that belong to it (window_range) end within it, so what is computed for a text depends on that text alone,
whatever stands next to it. A block holds about 260,000 code points (or one longer text), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BLOCK_CHARS = 1 << 18
SEPARATOR = 0x20
LONGEST = 4  # code points of the longest window
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Block:
    """Code points of texts [first, first + n) and where the range of each begins; starts has n + 1 entries."""

    first: int
    codes: np.ndarray
    starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def window_range(self, i: int, order: int) -> tuple[int, int]:
        """First and past-last place at which windows of order code points begin that lie within text i and its separators."""
        return int(self.starts[i]), int(self.starts[i + 1]) - order + 1


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[Block]:
    """Cut a list of texts into blocks; null counts as the empty text."""
    first = 0
    while first < len(texts):
        stop, chars = first, 0
        while stop < len(texts) and (stop == first or chars + len(texts[stop] or "") <= limit):
            chars += len(texts[stop] or "")
            stop += 1
        part = [t or "" for t in texts[first:stop]]
        lengths = np.fromiter((len(t) + 1 + LONGEST for t in part), np.int64, len(part))
        tail = " " * LONGEST
        joined = "".join(f" {t}{tail}" for t in part)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield Block(first, codes, np.concatenate([[0], np.cumsum(lengths)]))
        first = stop


@lru_cache(1)
def letter_map() -> np.ndarray:
    """For each code point below 65536: its lower-case form if it is a letter, else a space."""
    out = np.full(1 << 16, SEPARATOR, np.uint32)
    for i in range(1 << 16):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
    return out


@lru_cache(1)
def word_map() -> np.ndarray:
    """As letter_map, but digits stay."""
    out = letter_map().copy()
    for i in range(1 << 16):
        if not 0xD800 <= i < 0xE000 and chr(i).isdigit():
            out[i] = i
    return out


def mapped(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """codes through a table of the basic plane; other planes stay as they are."""
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finaliser published with MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the order code points that begin at each place."""
    h = np.zeros(len(codes), np.uint32)
    for k in range(order):
        shifted = np.full(len(codes), SEPARATOR, np.uint32)
        shifted[: len(codes) - k] = codes[k:]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77 + 2 * order)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


@lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    power = np.ones(size, np.uint64)
    inverse = np.ones(size, np.uint64)
    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), out=power)
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]), out=inverse)
    return power, inverse


def words(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block (runs that table doesn't map to a space): text index, begin, 64-bit hash of the mapped word."""
    codes = mapped(block.codes, table)
    inside = codes != SEPARATOR
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    begin, end = edge[0::2], edge[1::2]
    size = 1 << max(19, int(len(codes)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
        raw = (sums[end] - sums[begin]) * inverse[begin]
        hashed = mix64(raw + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B1))
    owner = np.searchsorted(block.starts, begin, side="right") - 1
    return owner, begin, hashed
