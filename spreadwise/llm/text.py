"""Vectorised text helpers that run inside tasks: Arrow string columns -> NumPy arrays.

Words and lines of at most 16 bytes are hashed by mixing their bytes as two numbers, longer ones by XXH3. Windows of symbols (words, bytes) have
64-bit polynomial hashes (arithmetic modulo 2^64 over mixed symbols) with a final avalanche, computed
by prefix sums, so the hash of any window costs O(1). A polynomial modulo 2^64 is weak on long sequences of
two symbols, so it is never used over the bytes of a word or line, which may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (finaliser with two multiplications)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: one odd random-looking 64-bit value for each byte
BYTE_CODES = mix64(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2^64 for i < n; grown by doubling and kept for the worker's life."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (max(n, 1) - 1).bit_length())
        full = np.full(size, base, dtype=U)
        full[0] = 1
        _POWERS[base] = have = np.cumprod(full, dtype=U)
        if size > 1 << 23:   # one extraordinarily long text must not pin its table
            del _POWERS[base]
    return have[:n]


class Prefix:
    """Prefix sums of ``codes[i] * BASE**i``: hash of any [start, end) in O(1)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(codes * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Raw (not mixed) hashes; equal contents give equal values wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1
        if n < size:
            return np.zeros(0, dtype=U)
        return mix64((self.sums[size:] - self.sums[:-size]) * self.inverse[:n - size + 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset:]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and len(column) else np.zeros(0, np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    return data[lo:hi], offsets - lo


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text each (or one row)."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def separator_table(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: words are runs of anything but ASCII white space
WHITE = separator_table([0x20, *range(0x09, 0x0E)])
#: words are runs of ASCII letters, digits and every non-ASCII byte
NOT_ALNUM = separator_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


#: masks that keep the first 0 to 8 bytes of a little-endian number
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Hashes of the byte strings [start, end); equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), dtype=U)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))       # the eight bytes from any place
    for lo in range(0, len(starts), chunk):
        s, size = starts[lo:lo + chunk], ends[lo:lo + chunk] - starts[lo:lo + chunk]
        own = mix64((eight[s] & _KEEP[np.minimum(size, 8)]) + size.astype(U) * U(BASE))
        long = np.flatnonzero(size > 8)
        own[long] = mix64(own[long] ^ (eight[s[long] + 8] & _KEEP[np.minimum(size[long] - 8, 8)]) * U(INVERSE))
        long = np.flatnonzero(size > 16)
        if len(long):
            view = memoryview(padded)
            own[long] = np.fromiter((xxh3_64_intdigest(view[i:i + n]) for i, n in zip(s[long].tolist(), size[long].tolist(), strict=True)), U, len(long))
        out[lo:lo + chunk] = own
    return out


class Words:
    """Words of many texts at once: byte ranges, the text of each word, and word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True                      # a text begins here
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:n]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        #: words of text i are [bounds[i], bounds[i + 1])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=lead[1:])
        return lead[self.ends] - lead[self.starts]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each window of ``size`` values, by doubling."""
    if len(x) < size:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= size:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = size - span
    return np.minimum(cur[:len(cur) - rest], cur[rest:]) if rest else cur


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions inside any [start, end)."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(starts, size), 1)
    np.add.at(edge, np.minimum(ends, size), -1)
    return np.cumsum(edge[:-1]) > 0
