"""Vectorised word and window hashes over Arrow string columns.

Words are cut at ASCII white space (0x20, 0x09-0x0D).  A word's hash adds one
random number for each of its bytes and their places; words longer than the
table of these numbers have a keyed BLAKE2 digest.  The table and the digests
come from a key that the driver draws for each run (:func:`fresh_key`), so any
two words share a hash with a chance of 2**-64 and none can be built to.  A window's hash is a Rabin-Karp
polynomial over its words' hashes; both come from prefix sums, so every window
costs the same whatever its length.  A polynomial modulo 2**64 over bytes would
not do: words of 1,024 bytes can be built that share its value for every base.
Windows are far shorter than that.  Work is done a few megabytes at a time.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multipliers of a window's hash and of the second hash that confirms it.
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
CHECK_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that the table of random numbers covers.
COVERED = 64
#: Bytes hashed at a time.
SEGMENT = 1 << 18

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += np.uint8(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fresh_key() -> bytes:
    """A key of word hashes; hashes of one key only may be compared, so a run has one for all its tasks."""
    return secrets.token_bytes(16)


@lru_cache(maxsize=4)
def _table(key: bytes) -> np.ndarray:
    """A random number for each place in a word and byte there, a row for each place."""
    return np.frombuffer(hashlib.shake_256(key).digest(8 * COVERED * 256), dtype="<u8").astype(np.uint64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, ``n`` of each."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(int(base), size)
    return up[:n], down[:n]


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _segment_words(raw: np.ndarray, opens: np.ndarray, values: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of ``raw``; ``opens`` marks where a row begins."""
    n = len(raw)
    ink = ~WHITE[raw]
    left = np.empty(n, dtype=bool)
    left[0] = True
    left[1:] = ~ink[:-1]
    left |= opens
    starts = np.flatnonzero(ink & left)
    right = np.empty(n, dtype=bool)
    right[-1] = True
    right[:-1] = ~ink[1:] | opens[1:]
    ends = np.flatnonzero(ink & right) + 1
    sizes = ends - starts
    at = np.flatnonzero(ink).astype(np.int32)
    place = at - np.repeat(starts.astype(np.int32), sizes)
    if len(sizes) and sizes.max() > COVERED:
        np.minimum(place, COVERED - 1, out=place)
    letters = values[raw[at]]
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    np.cumsum(_table(key)[place * np.int32(256) + letters], out=total[1:])
    last = np.cumsum(sizes)
    out = mixed(total[last] - total[last - sizes] + sizes.astype(np.uint64))
    for k in np.flatnonzero(sizes > COVERED).tolist():
        word = letters[last[k] - sizes[k] : last[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key).digest(), "little")
    return out, starts


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the rows in that list)."""
    values = LOWER if lower else SAME
    opens = np.zeros(len(raw) + 1, dtype=bool)
    opens[at] = True
    hashes, starts, low = [], [], 0
    while low < len(raw):
        high = min(len(raw), low + SEGMENT)
        while high < len(raw):  # never within a word
            free = np.flatnonzero(WHITE[raw[high : high + SEGMENT]] | opens[high : min(high + SEGMENT, len(raw))])
            high = high + int(free[0]) if len(free) else min(len(raw), high + SEGMENT)
            if len(free):
                break
        h, s = _segment_words(raw[low:high], opens[low:high], values, key)
        hashes.append(h)
        starts.append(s + low)
        low = high
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, at, side="left")


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """The hash of every ``width`` consecutive words, rows not regarded."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[width:] - total[:-width]) * down[:n] + np.uint64(width))


def slices(sizes: np.ndarray, most: int):
    """Ranges of rows that hold about ``most`` bytes each, in order."""
    ends = np.cumsum(sizes)
    low, n = 0, len(sizes)
    while low < n:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, high
        low = high
