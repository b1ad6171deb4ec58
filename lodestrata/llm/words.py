"""Whole-column text arithmetic: word bounds, word hashes and n-gram hashes as NumPy arrays.

A chunk of texts is one byte buffer with document bounds. Substring hashes come from prefix sums of a polynomial with
random byte codes modulo 2**64, so any span hashes in constant time; a bijective mix spreads the bits afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Spaces that part words: 0x20 and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_GRAM = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, 1 << 20), _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        _powers[which] = np.multiply.accumulate(step)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Texts:
    """data: all bytes; at: bounds of each document, one more than there are documents."""

    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        return cls(data, at - at[0])

    @classmethod
    def joined(cls, texts: list[bytes]) -> Texts:
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    def prefix_hashes(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_CODES[self.data] * _power("up", len(self.data)), out=out[1:])
        return out

    def tokens(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes marked `inside`, and for each document its range of runs."""
        n = len(self.data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.at[(self.at > 0) & (self.at < n)]
        before[edges], after[edges - 1] = False, False
        starts = np.flatnonzero(inside & ~before)
        return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, self.at)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.tokens(~SPACES[self.data])


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal bytes give equal hashes, wherever the span lies."""
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * _power("down", len(prefix))[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def rolling_hashes(prefix: np.ndarray, low: int, high: int, length: int) -> np.ndarray:
    """span_hashes of all spans of a length within [low, high), without index arrays."""
    n = max(high - low - length + 1, 0)
    out = prefix[low + length : low + length + n] - prefix[low : low + n]
    out *= _power("down", len(prefix))[low : low + n]
    out += np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(out)


def grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive word hashes within a document; bounds of each document in them."""
    counts = np.maximum(np.diff(at) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(bounds[-1]) + np.repeat(at[:-1] - bounds[:-1], counts)
    out = np.zeros(len(starts), np.uint64)
    for j in range(n):
        out += words[starts + j] * _GRAM[j]
    return mix(out), bounds


def run_hashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n values from each start."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power("up", len(values)), out=sums[1:])
    return mix((sums[starts + n] - sums[starts]) * _power("down", len(sums))[starts])


def spans(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of the values of each range."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(1)) * _power("up", len(values)), out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) * _power("down", len(total))[bounds[:-1]])


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each element, the document whose range it lies in."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each range."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
