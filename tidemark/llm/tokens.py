"""Vectorised text primitives shared by the operators that run numpy in Spark tasks.

Everything works on the raw UTF-8 bytes of an Arrow string column, laid end to
end, with one offset per row; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space that separates words: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The id that a null document id stands for: it sorts after all others.
NO_ID = np.iinfo(np.int64).max
#: Odd multipliers of the rolling fingerprints.
BASE_BYTES, BASE_WORDS, BASE_WORDS_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least; kept for later calls."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 18, 1 << int(n).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, U64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        held = _POWERS[base] = (both[0], both[1])
    return held


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums: entry i covers values[:i]."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Fingerprints of values[start:end], alike wherever the same values stand."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(U64))


def window_hashes(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """Fingerprints of every run of `width` values."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, U64)
    return mix((sums[width:] - sums[:n]) * powers(base, len(sums))[1][:n])


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and len + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each (a longer row stands alone)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and len + 1 word offsets of the rows."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _NOT_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:end]."""
    return span_hashes(prefix_sums(_TABLE[data], BASE_BYTES), starts, ends, BASE_BYTES)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which any substring's fingerprint follows (base BASE_BYTES)."""
    return prefix_sums(_TABLE[data], BASE_BYTES)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, in a logarithmic number of passes."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def run_cover(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [m, m + width) of a marked window start m."""
    step = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(marks)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0
