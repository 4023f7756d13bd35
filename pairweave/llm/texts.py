"""Word hashes of Arrow text columns, computed on whole buffers with numpy.

Words are maximal runs of bytes other than space and \\x09-\\x0D; those bytes
never occur inside a longer UTF-8 character. A text of any length is hashed in
slices cut at separators, so the work arrays stay small.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes hashed together; sizes the work arrays, never the text
BASE = 0x9E3779B97F4A7C15 | 1
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` with freed memory handed back to the system after each task.

    Python workers outlive their task, and what one stage freed but kept would
    add to the next stage's need beside the JVM.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX2)
    x ^= x >> np.uint64(31)
    return x


def text_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Bytes of each value without a copy; None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i + 1]] if valid[i] else None


class WordHasher:
    """64-bit hashes of words; equal words hash alike wherever they stand.

    A word is a polynomial in random byte values modulo 2**64. Prefix sums give
    all words of a slice at once; the odd base makes every power invertible.
    """

    def __init__(self, fold: bool = False):
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        if fold:  # A-Z count as a-z
            values[65:91] = values[97:123]
        self.values = values
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverses = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n + 1:
            with np.errstate(over="ignore"):
                base = np.full(n + 1, BASE, np.uint64)
                base[0] = 1
                self.powers = np.cumprod(base)
                base = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
                base[0] = 1
                self.inverses = np.cumprod(base)

    def _slice(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._grow(max(len(b), SLICE))
        gap = np.ones(len(b) + 2, np.int8)
        gap[1:-1] = self.blank[b]
        edge = np.diff(gap)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.powers[: len(b)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts]), starts, ends

    def spans(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, byte starts and byte ends of all words of one text."""
        parts, at = [], 0
        while at < len(b):
            end = min(len(b), at + SLICE)
            if end < len(b):  # cut after a separator; a longer word makes a longer slice
                cut = np.flatnonzero(self.blank[b[at:end]])
                while not len(cut) and end < len(b):
                    end = min(len(b), end + SLICE)
                    cut = np.flatnonzero(self.blank[b[at:end]])
                end = at + int(cut[-1]) + 1 if len(cut) else len(b)
            h, s, e = self._slice(b[at:end])
            parts.append((h, s + at, e + at))
            at = end
        if not parts:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), none, none
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]

    def words(self, b: np.ndarray) -> np.ndarray:
        return self.spans(b)[0]


class PlacedHasher(WordHasher):
    """64-bit hashes of words without algebraic collisions.

    A word is the sum of one random value per (place, byte). A polynomial modulo
    2**64 gives some long words of two letters one hash; here the values of
    different places are unrelated.
    """

    PLACES = 64  # values of the first places are tabled, those of later ones computed

    def __init__(self, fold: bool = False):
        super().__init__(fold)
        letters = np.arange(256, dtype=np.uint64)
        if fold:
            letters[65:91] = letters[97:123]
        self.letters = letters
        self.table = self._values(np.repeat(np.arange(self.PLACES, dtype=np.uint64), 256), np.tile(letters, self.PLACES))

    @staticmethod
    def _values(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((place * np.uint64(256) + letter + np.uint64(1)) * np.uint64(BASE))

    def _slice(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = np.ones(len(b) + 2, np.int8)
        gap[1:-1] = self.blank[b]
        edge = np.diff(gap)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        inside = gap[1:-1] == 0
        sizes = ends - starts
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        letter = b[inside]
        late = np.flatnonzero(place >= self.PLACES) if int(sizes.max()) > self.PLACES else None
        if late is None:
            values = self.table[place * 256 + letter]
        else:
            values = self.table[np.minimum(place, self.PLACES - 1) * 256 + letter]
            values[late] = self._values(place[late].astype(np.uint64), self.letters[letter[late]])
        return mixed(np.add.reduceat(values, firsts)), starts, ends


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence when it is shorter."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < size:
            out = np.uint64(n)
            for w in words:
                out = out * np.uint64(BASE) + w
            return mixed(np.array([out], np.uint64))
        out = words[: n - size + 1].copy()
        for k in range(1, size):
            out *= np.uint64(BASE)
            out += words[k : n - size + 1 + k]
    return mixed(out)


def groups(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay near ``limit``; a longer text stands alone."""
    first = size = 0
    for i, view in enumerate(text_views(texts)):
        more = 0 if view is None else len(view)
        if size and size + more > limit:
            yield first, i
            first, size = i, 0
        size += more
    if first < len(texts):
        yield first, len(texts)
