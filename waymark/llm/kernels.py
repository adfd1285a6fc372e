"""Vectorised text kernels over Arrow string buffers: word runs, polynomial span hashes, sliding windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
_INV = pow(int(BASE), -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
BLOCK_BYTES = 1 << 20


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n, grown by doubling."""
    have = _POWERS.get(name)
    if have is None:
        have = np.ones(1, U64)
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _POWERS[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the output (splitmix64's constants)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_dictionary(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def doc_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `limit` bytes each; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every values[starts:ends]: a polynomial's prefix sums, so any number of spans costs one pass."""
    n = len(values)
    prefix = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * _powers("up", int(BASE), n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _powers("down", _INV, n + 1)[starts] + (ends - starts).astype(U64))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words, maximal runs of bytes other than space and 0x09-0x0D."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and their row numbers, in row order.

    A text of fewer words, but at least one, has a single shingle of all its words; one without words has none.
    """
    starts, ends, rows = words(raw, offsets)
    n = len(offsets) - 1
    h = span_hashes(raw, starts, ends)
    out = np.zeros(len(h), U64)
    for k in range(size):
        shifted = np.zeros(len(h), U64)
        shifted[: max(0, len(h) - k)] = h[k:]
        last = np.full(len(rows), -1)
        last[: max(0, len(rows) - k)] = rows[k:]
        out = np.where(last == rows, mix(out * BASE + shifted), out)
    count = row_counts(rows, n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    at = np.arange(len(rows)) - first[rows]
    keep = (at + size <= count[rows]) | ((at == 0) & (count[rows] < size))
    return out[keep], rows[keep]


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every h[i : i + width], by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
