"""Indel similarity of strings, by a bit-parallel longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def positions(text: str) -> dict[str, int]:
    """For each character, a bit for every place where it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(short: str, long_positions: dict[str, int], long_size: int) -> int:
    """Length of the longest common subsequence: one step of integer arithmetic a character."""
    full = (1 << long_size) - 1
    free = full
    get = long_positions.get
    for c in short:
        met = free & get(c, 0)
        free = (free + met | free - met) & full
    return long_size - free.bit_count()


def ratio_of(a: int, b: int, common: int) -> float:
    """The similarity from two lengths and the common one, in the arithmetic of the scores to be matched."""
    n = a + b
    return 1.0 if not n else ((1.0 - (n - 2 * common) / n) * 100.0) / 100.0


class Lanes:
    """Texts side by side in one integer, so that a step of arithmetic serves them all.

    Each has a lane of whole 64-bit words with a spare bit above the text, where carries end.
    """

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        words = self.sizes // 64 + 1
        self.starts = np.cumsum(words) - words
        self.bytes = 8 * int(words.sum())
        self.full, self.where = 0, {}
        for text, start in zip(texts, self.starts.tolist(), strict=True):
            self.full |= (1 << len(text)) - 1 << 64 * start
            for c, bits in positions(text).items():
                self.where[c] = self.where.get(c, 0) | bits << 64 * start

    def ratios(self, text: str) -> np.ndarray:
        """The similarity of ``text`` to each of the texts."""
        free = full = self.full
        get = self.where.get
        for c in text:
            met = free & get(c, 0)
            free = (free + met | free - met) & full
        left = np.bitwise_count(np.frombuffer(free.to_bytes(self.bytes, "little"), np.uint64)).astype(np.int64)
        return ratios_of(self.sizes, len(text), self.sizes - np.add.reduceat(left, self.starts))


def ratios_of(a: np.ndarray, b: int, common: np.ndarray) -> np.ndarray:
    """:func:`ratio_of` for arrays."""
    n = a + b
    return ((1.0 - (n - 2 * common) / np.maximum(n, 1)) * 100.0) / 100.0


def ratio(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    return ratio_of(len(a), len(b), common_length(a, positions(b), len(b)))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel similarity of two columns, 0 to 1; null if either is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
