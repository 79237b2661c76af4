"""Vectorised text kernels on Arrow string columns, used inside Spark tasks.

All functions work on the UTF-8 bytes of a whole Arrow column at once. Word separators are the
ASCII characters space and 0x09-0x0D, so a byte-level scan finds exactly the words
``[^\\x20\\x09-\\x0D]+`` of the decoded text. Words and lines are hashed by XXH64 and windows of a
few words by a polynomial of such hashes: two that differ share one with a probability of about 2**-64,
unless somebody has searched for such a pair, as neither is cryptographic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
# The primes of XXH64.
_P1 = U64(0x9E3779B185EBCA87)
_P2 = U64(0xC2B2AE3D27D4EB4F)
_P3 = U64(0x165667B19E3779F9)
_P4 = U64(0x85EBCA77C2B2AE63)
_P5 = U64(0x27D4EB2F165667C5)
_MASK = (1 << 64) - 1
_SPAN, _LONG = 1 << 16, 1024

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows laid end to end, and the row offsets (one more than there are rows). A null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: int, max_bytes: int = 1 << 20, max_rows: int = 16384) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of few bytes (a longer row is a slice of its own), which bounds the working memory.

    What Arrow keeps for reuse is given back after each batch, since workers stay for later stages.
    """
    _, offs = byte_column(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(offs, offs[start] + max_bytes, "right")) - 1
        end = min(max(end, start + 1), start + max_rows, n)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at row boundaries."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(state + lane * _P2, 31) * _P1


def _xxh64_short(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of spans side by side. ``data`` has eight bytes more than the spans need, so that lanes can be read anywhere."""
    lanes = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    halves = np.ndarray((len(data) - 7,), "<u4", data, 0, (1,))
    at, left = at.copy(), size.copy()
    h = np.full(len(at), (seed + int(_P5)) & _MASK, dtype=U64)
    big = np.flatnonzero(size >= 32)
    if len(big):
        state = [np.full(len(big), (seed + x) & _MASK, dtype=U64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        place, rest, live = at[big], left[big], np.arange(len(big))
        while len(live):
            for k in range(4):
                state[k][live] = _round(state[k][live], lanes[place[live] + 8 * k])
            place[live] += 32
            rest[live] -= 32
            live = live[rest[live] >= 32]
        joined = _rotated(state[0], 1) + _rotated(state[1], 7) + _rotated(state[2], 12) + _rotated(state[3], 18)
        for part in state:
            joined = (joined ^ _round(np.zeros_like(part), part)) * _P1 + _P4
        h[big], at[big], left[big] = joined, place, rest
    h += size.astype(U64)
    live = np.flatnonzero(left >= 8)
    while len(live):
        h[live] = _rotated(h[live] ^ _round(U64(0), lanes[at[live]]), 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    h[live] = _rotated(h[live] ^ (halves[at[live]].astype(U64) * _P1), 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left)
    while len(live):
        h[live] = _rotated(h[live] ^ (data[at[live]].astype(U64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each span of bytes, many at a time; spans of over ``_LONG`` bytes, which are few, one by one. Spans may overlap."""
    out, size = np.empty(len(starts), dtype=U64), ends - starts
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(np.ascontiguousarray(data[starts[i] : ends[i]]), seed)
    rest = np.flatnonzero(size <= _LONG)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for low in range(0, len(rest), _SPAN):
        some = rest[low : low + _SPAN]
        out[some] = _xxh64_short(padded, starts[some], size[some], seed)
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = IDENTITY) -> np.ndarray:
    """One 64-bit hash (XXH64) per span of bytes, after mapping each byte through ``table``."""
    return xxh64(data if table is IDENTITY else table[data], starts, ends)


def row_of(positions: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, positions, "right") - 1


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = IDENTITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word, in text order."""
    starts, ends = spans(~SEPARATOR[data], offs)
    return hash_spans(data, starts, ends, table), row_of(starts, offs), starts, ends


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words inside one row, and the index of each window's first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:count] == rows[n - 1 :])
    total = np.zeros(count, dtype=U64)
    for j in range(n):
        total = total * U64(0xA24BAED4963EE407) + hashes[j : j + count]
    return mix(total[first] + U64(n)), first


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each row (A-Z lower-cased), sorted, laid end to end, with row offsets.

    A row with fewer than n words, but one at least, has its whole word sequence as its only shingle.
    """
    h, row, _, _ = words(data, offs, LOWER)
    rows = len(offs) - 1
    grams, first = windows(h, row, n)
    gram_row = row[first]
    count = np.bincount(row, minlength=rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])[short]
        total = np.zeros(len(short), dtype=U64)
        for j in range(n - 1):
            has = count[short] > j
            total[has] = total[has] * U64(0xA24BAED4963EE407) + h[begin[has] + j]
        grams = np.concatenate([grams, mix(total + (count[short].astype(U64) << U64(8)))])
        gram_row = np.concatenate([gram_row, short])
        order = np.argsort(gram_row, kind="stable")
        grams, gram_row = grams[order], gram_row[order]
    return distinct_by_row(grams, gram_row, rows)


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort and deduplicate the values of each row; ``row`` is ascending."""
    bounds = np.searchsorted(row, np.arange(rows + 1))
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    if not len(values):
        return values, bounds
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[bounds]
