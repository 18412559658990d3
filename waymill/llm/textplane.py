"""Texts of an Arrow batch as flat NumPy planes: code points, classes, run borders and run hashes.

One slice of many texts is handled by a fixed number of vector operations; nothing is done text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of run hashes; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Longest run that is hashed; longer ones are handled as text, since the low bits of long polynomials are weak.
HASHED = 64

#: Code points hashed at a time, so that a very long text needs no more memory for its hashes than a short one.
BLOCK = 1 << 20

_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; one table per process, which grows."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = np.full(size, BASE, np.uint64)
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        base[0] = back[0] = 1
        _POWERS[:] = [(np.cumprod(base), np.cumprod(back))]
    return _POWERS[0]


def slices(texts: pa.Array, chars: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive slices of about ``chars`` bytes; a longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(texts):
        limit = (ends[begin - 1] if begin else 0) + chars
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


class Plane:
    """Code points of consecutive texts, with the start of each text (``bounds`` has one entry more)."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.joined = "".join(texts)
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    @classmethod
    def of(cls, texts: pa.Array) -> Plane:
        return cls([t if t is not None else "" for t in texts.to_pylist()])

    def __len__(self) -> int:
        return len(self.points)

    def first(self) -> np.ndarray:
        """Mask of the first code point of each non-empty text."""
        mask = np.zeros(len(self) + 1, bool)
        mask[self.bounds] = True
        return mask[:-1]

    def last(self) -> np.ndarray:
        """Mask of the last code point of each non-empty text."""
        mask = np.zeros(len(self) + 1, bool)
        mask[self.bounds] = True
        return mask[1:]


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs points[start:end], the same for equal runs wherever they stand. Starts ascend."""
    if len(points) <= BLOCK:
        return _hashes(points, starts, ends)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(starts, low + BLOCK, "left"))
        high = int(ends[at:to].max())
        out[at:to] = _hashes(points[low:high], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class HashIndex:
    """Numbers 0, 1, ... by hash: a direct-mapped front over a sorted table, both grown as hashes are added."""

    FRONT_BITS = 17

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.values = np.zeros(0, np.int64)
        self.front_key = np.zeros(1 << self.FRONT_BITS, np.uint64)
        self.front_value = np.full(1 << self.FRONT_BITS, -1, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it has none."""
        slot = hashes >> np.uint64(64 - self.FRONT_BITS)
        value = np.where(self.front_key[slot] == hashes, self.front_value[slot], -1)
        rest = np.flatnonzero(value < 0)
        if len(rest) and len(self.keys):
            wanted = hashes[rest]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[at] == wanted
            value[rest[found]] = self.values[at[found]]
        return value

    def add(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers for new, distinct hashes, in their order."""
        fresh = np.arange(len(self.keys), len(self.keys) + len(hashes))
        order = np.argsort(np.concatenate([self.keys, hashes]), kind="stable")
        self.keys, self.values = np.concatenate([self.keys, hashes])[order], np.concatenate([self.values, fresh])[order]
        slot = hashes >> np.uint64(64 - self.FRONT_BITS)
        free = self.front_value[slot] < 0
        self.front_key[slot[free]], self.front_value[slot[free]] = hashes[free], fresh[free]
        return fresh
