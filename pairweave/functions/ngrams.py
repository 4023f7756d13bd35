"""Hashed character n-grams as an Arrow function: one narrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_AT_ONCE = 4_000_000
BASE = 31
PRIME = 8191  # takes all bits of a number into its slot


def slot_counts(texts: list[str], n: int, slots: int) -> np.ndarray:
    """Row i counts the n-grams of text i by slot.

    The n code points of a gram are digits in base 31; its slot is that number
    modulo a prime, modulo ``slots``.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    lengths = np.array([len(t) for t in texts], "i8")
    rows = np.repeat(np.arange(len(texts)), lengths)
    width = len(codes) - (n - 1)
    if width <= 0:
        return np.zeros((len(texts), slots))
    number = np.zeros(width, "i8")
    for step in range(n):
        number = (number * BASE + codes[step : step + width]) % PRIME
    whole = rows[:width] == rows[n - 1 :]  # grams that do not run into the next text
    cells = rows[:width][whole] * slots + number[whole] % slots
    return np.bincount(cells, minlength=len(texts) * slots).reshape(len(texts), slots).astype("f8")


def pieces(texts: list[str]):
    """Consecutive texts of bounded total length; a longer text stands alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > CHARS_AT_ONCE:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def ngram_vector(n: int = 3, dim: int = 64) -> Callable[[str | Column], Column]:
    """Column function: unit-length vector of a text's n-gram counts.

    Covers the whole text. A text shorter than n gives the zero vector, a null
    text gives null.
    """

    @F.arrow_udf("array<double>")
    def vector(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        blocks = [slot_counts(part, n, dim) for part in pieces([t or "" for t in values])]
        m = np.concatenate(blocks) if blocks else np.zeros((0, dim))
        length = np.sqrt((m * m).sum(axis=1))
        m /= np.where(length == 0.0, 1.0, length)[:, None]
        known = np.array([t is not None for t in values], bool)
        sizes = np.where(known, dim, 0)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype("i4"), mask=np.r_[~known, False])
        return pa.ListArray.from_arrays(offsets, pa.array(m[known].ravel()))

    return vector
