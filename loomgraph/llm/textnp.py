"""Vectorised word and hash kernels over Arrow string buffers, used inside tasks only.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Hashes are 64-bit polynomial hashes taken from
prefix sums modulo 2**64, finished with an avalanche step, so that each costs a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a task to a few dozen times this.
CHUNK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche step (xor-shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _powers[base] = (made[0], made[1])
    return have[0][: n + 1], have[1][: n + 1]


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base)[0][: len(values)], out=out[1:])
    return out


def ranges_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[starts:ends] from prefix(); equal contents hash alike wherever they start."""
    raw = (sums[ends] - sums[starts]) * powers(len(sums) - 1, base)[1][starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32, len(col) + 1, col.offset * (8 if large else 4)) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off.astype(np.int64)


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about limit bytes each: (first row, end row, bytes, offsets from 0)."""
    data, off = buffers(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the words; a row's end also ends a word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_IS_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = off[(off > 0) & (off < n)]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranges_hash(prefix(data.astype(np.uint64) + np.uint64(1)), starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of values[i:i+width]; width is a power of two."""
    at = np.arange(len(values))
    step = 1
    while step < width:
        left, right = at[:-step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        step *= 2
    return at
