"""Numpy views of Arrow text columns, shared by the text operators.

Everything works on one block of whole documents at a time (about ``BLOCK_BYTES`` of UTF-8, or one longer
document), so a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

#: A random code for each byte.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def slices(lengths: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive spans of about ``most`` items, or one longer span."""
    upto, first = np.cumsum(lengths), 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - lengths[first] + most, "right")))
        yield first, last
        first = last


def span_hashes(code: np.ndarray, items: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans: the sum of a mixed number for each item and its place in the span, mixed with the length.

    code: a random number for each possible item.  Every (item, place) has a number of its own, as in tabulation hashing, so no run of
    items can cancel out as it can in a polynomial modulo a power of two.
    """
    out, length = np.empty(len(start), np.uint64), end - start
    for a, b in slices(length, 1 << 15):  # few enough that the arrays stay in the processor's cache
        n = length[a:b]
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1]))
        at = place + np.repeat(start[a:b] - upto + n, n)
        place -= np.repeat(upto - n, n)
        numbers = place.view(np.uint64)
        numbers *= _STEP
        numbers += code[items[at]]
        sums = np.zeros(len(at) + 1, np.uint64)
        np.cumsum(mix(numbers), out=sums[1:])
        out[a:b] = mix(sums[upto] - sums[upto - n] + n.astype(np.uint64))
    return out


def release() -> None:
    """Gives freed memory back to the system, so that a worker that is used again doesn't keep the most it ever held."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def text_blocks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of whole documents: the rows, their UTF-8 as one uint8 array, and the n + 1 offsets.

    A null text is an empty one here; the rows still tell which were null.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        n = len(column)
        if not n:
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
            own = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[own[0] : own[-1]], own - own[0]
            first = last
    release()


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-space bytes: start, end, and for each document the index of its first word (n + 1)."""
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices, empty ones included."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each item the index of the slice that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def scan(df, function, schema: str, id_col: str, text_col: str, *more):
    """mapInArrow over the id (first) and text (second) columns alone: other columns never reach Python."""
    from pyspark.sql import functions as F

    return df.select(F.col(id_col), F.col(text_col).cast("string"), *more).mapInArrow(function, schema)
