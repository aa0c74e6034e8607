"""Vectorised text kernels: they work on the UTF-8 bytes of an Arrow column, without a Python object per word.

A word is a maximal run of bytes other than ASCII white space; offsets count from the start of the given slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _lean() -> None:
    """Have glibc give large arrays back to the system when they are freed, Arrow's too: a Python worker lives on after its task."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


_lean()
BASE = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


_POWERS = powers(1 << 12)


def power_table(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = powers(2 * n)
    return _POWERS


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and len + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``most`` bytes; a longer row is a run of its own."""
    raw, o = column_bytes(column)
    lo, n = 0, len(o) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + most, "right")) - 1)
        yield lo, hi, raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]
        lo = hi


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and for each row the number of its first word (len(offsets) entries)."""
    space = SPACE[raw]
    before = np.empty(len(raw), bool)
    before[:1] = True
    before[1:] = space[:-1]
    inner = offsets[:-1]
    before[inner[inner < len(raw)]] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of words, their starts, and each row's first word."""
    starts, first = word_starts(raw, offsets)
    if not len(starts):
        return np.zeros(0, U64), starts, first
    a = int(starts[0])
    lengths = np.diff(np.append(starts, len(raw)))
    at = np.arange(a, len(raw)) - np.repeat(starts, lengths)
    v = raw[a:].astype(U64)
    v += U64(1)
    v *= power_table(int(at.max()) + 1)[at]
    v[SPACE[raw[a:]]] = 0
    return mix(np.add.reduceat(v, starts - a)), starts, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of n consecutive words by doubling; entry i is of words i to i + n - 1, modulo the end."""
    if len(words) < n:
        return np.zeros(0, U64)
    out, width, done, block = None, 1, 0, words
    # block[i] is the hash of `width` words from i; the binary digits of n say which blocks make up n words.
    while True:
        if n & width:
            out = block if out is None else out[: len(block) - done] + power_of(done) * block[done:]
            done += width
        if done == n:
            return mix(out[: len(words) - n + 1])
        block = block[: len(block) - width] + power_of(width) * block[width:]
        width *= 2


def power_of(n: int) -> np.uint64:
    return power_table(n + 1)[n]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and each row's first one (len(offsets) entries)."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    head = raw[lead].astype(np.int32)
    if len(lead) == len(raw):
        return head, offsets
    width = np.diff(np.append(lead, len(raw)))
    code = np.where(width == 1, head, head & (0xFF >> (width + 1)))
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        code[more] = code[more] << 6 | (raw[lead[more] + k] & 0x3F)
    return code, np.searchsorted(lead, offsets)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of ``width`` values, by doubling."""
    have, block = 1, values
    while 2 * have <= width:
        block = op(block[:-have], block[have:])
        have *= 2
    rest = width - have
    return op(block[: len(block) - rest], block[rest:]) if rest else block


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column; row i holds counts[i] of the entries of data."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * data.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by key, cut anew so that no key's rows are split between two of them."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if held:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            cut = int(np.searchsorted(k, last, "right")) if k[0] == last else 0
            if cut == len(k):
                held.append(b)
                rows += len(k)
                continue
            if rows + cut >= least:
                if cut:
                    held.append(b.slice(0, cut))
                yield one(held)
                held, rows = [b.slice(cut)], len(k) - cut
                continue
        held.append(b)
        rows += len(k)
    if held:
        yield one(held)


def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches(max_chunksize=None)[0]
