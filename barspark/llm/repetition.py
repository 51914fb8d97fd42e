"""Operator 7: quality rules, with repetition found by suffix arrays.

The words of a block of documents become one integer array.  Its suffixes are sorted by prefix doubling, documents
apart; only suffixes that still share their first words with another one are sorted on.  Ranks kept from each doubling give the
longest common prefix of neighbours, so for each word the longest repeat that starts there.  Where such a repeat is not the
rest of a longer one it is maximal; the union of the maximal repeats' spans is what a text repeats of itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import textarrays as ta

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINE_END = np.arange(256) == 10


@dataclass(frozen=True)
class Limits:
    """Beyond these a document is rejected, besides the base rules (10 words at least; a fifth of the words in repeated 5-word windows)."""

    least_words: int = 10
    window: int = 5
    window_percent: int = 20
    shortest_repeat: int = 3  # words of a repeat that is reported; what counts as covered grows with the text, see least_covered
    most_covered: float = 0.35  # fraction of the words
    longest_repeat: int = 60  # words
    longest_share: float = 0.01  # and the longest repeat's share of the words, for it to count
    longest_anyway: int = 600  # words of a repeat that counts whatever its share
    symbol_share: float = 0.20  # symbols per character of the words
    short_word: float = 2.0  # mean characters of a word
    long_word: float = 25.0
    dup_line_share: float = 0.50  # of the lines with a word


def suffix_array(key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, by prefix doubling; and the ranks after each doubling.

    key: equal where word and document are equal; end: for each position the end of its document.
    Two positions have equal ranks at level k just if 2**k words from there on are equal, inside one document.
    """
    n = len(key)
    array = np.argsort(key, kind="stable")
    sorted_key = key[array]
    slots, levels, step = np.arange(n), [], 1
    rank = np.empty(n, np.int64)
    while True:
        new = np.append(True, sorted_key[1:] != sorted_key[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(slots)))
        rank[array[slots]] = np.repeat(slots[head], size)
        levels.append(rank.copy())
        slots = slots[np.repeat(size, size) > 1]
        if not len(slots):
            return array, levels
        live = array[slots]
        then = live + step
        follow = np.where(then < end[live], rank[np.minimum(then, n - 1)], -1)
        both = rank[live] * (n + 1) + follow + 1
        order = np.argsort(both, kind="stable")
        array[slots] = live[order]
        sorted_key = both[order]
        step *= 2


def common_prefixes(array: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the one before it in the array."""
    n = len(array)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    pair = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    a, b, shared = array[pair], array[pair + 1], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + shared, b + shared
        same = (i < n) & (j < n)
        same &= levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]
        shared += same.astype(np.int64) << k
    out[pair + 1] = shared
    return out


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word the length of the longest run of words from there that starts elsewhere in its document, too.

    ids: equal for equal words; doc: the document of each word, ascending.
    """
    longest = np.zeros(len(ids), np.int64)
    if len(ids) < 2:
        return longest
    distinct, ids = np.unique(ids, return_inverse=True)
    array, levels = suffix_array(ids + doc.astype(np.int64) * len(distinct), np.searchsorted(doc, doc, "right"))
    shared = common_prefixes(array, levels)
    longest[array] = np.maximum(shared, np.append(shared[1:], 0))
    return longest


def maximal(longest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the repeats that are not the rest of a longer one starting a word earlier."""
    out = longest > 0
    out[1:] &= ~((longest[:-1] == longest[1:] + 1) & (doc[1:] == doc[:-1]))
    return out


def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n words inside the union of the spans."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def least_covered(n_words: np.ndarray, limits: Limits) -> np.ndarray:
    """Words of a repeat that counts as covered in texts of so many words: shorter ones come by chance, the longer the text.

    The whole logarithm to base 4: 3 up to 255 words, 6 at 5,000, 7 at 50,000.
    """
    return np.maximum(limits.shortest_repeat, (np.frexp(np.maximum(np.asarray(n_words, np.float64), 1))[1] - 1) // 2)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_covered_words long, longest_repeat long"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]


_REPEATS = "array<struct<start: bigint, length: bigint>>"


def _measured(batches: Iterator[pa.RecordBatch], text: int, limits: Limits) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], pa.Array]]:
    """Blocks of rows with their measures and maximal repeats."""
    for rows, data, offsets in ta.text_blocks(batches, text):
        start, end, at = ta.words(data, offsets)
        doc = ta.owners(at)
        longest = longest_repeats(ta.span_hashes(ta.BYTE_CODE, data, start, end), doc)
        n = len(start)
        chars = np.append(0, np.cumsum(ta.NOT_CONTINUATION[data]))
        windows = np.flatnonzero(longest >= limits.window)
        in_window = covered(windows, np.full(len(windows), limits.window), n)
        long = np.flatnonzero(longest >= limits.shortest_repeat)
        beyond = np.flatnonzero(longest >= least_covered(np.diff(at), limits)[doc])
        in_repeat = covered(beyond, longest[beyond], n)
        # lines with a word: they end at a line feed or with the document
        cut = np.unique(np.concatenate([offsets, np.flatnonzero(LINE_END[data]) + 1]))
        first, last = cut[:-1], cut[1:]
        full = np.searchsorted(start, last) > np.searchsorted(start, first)
        first, last = first[full], last[full]
        text_end = last - LINE_END[data[last - 1]]
        line_doc = np.searchsorted(offsets, first, "right") - 1
        line = ta.mix(ta.span_hashes(ta.BYTE_CODE, data, first, text_end) + line_doc.astype(np.uint64))
        _, one = np.unique(line, return_index=True)
        again = np.ones(len(line), bool)
        again[one] = False
        most = np.zeros(rows.num_rows, np.int64)
        np.maximum.at(most, doc[long], longest[long])
        out = [
            np.diff(at),
            ta.per_document(chars[end] - chars[start], at),
            ta.per_document(SYMBOLS[data], offsets),
            np.bincount(line_doc[again], minlength=rows.num_rows),
            ta.per_document(in_window, at),
            np.bincount(line_doc, minlength=rows.num_rows),
            ta.per_document(in_repeat, at),
            most,
        ]
        own = np.flatnonzero(maximal(longest, doc) & (longest >= limits.shortest_repeat))
        items = pa.StructArray.from_arrays([pa.array(own - at[doc[own]]), pa.array(longest[own])], ["start", "length"])
        yield rows, [pa.array(x.astype(np.int64)) for x in out], pa.ListArray.from_arrays(pa.array(np.searchsorted(own, at), pa.int32()), items)


def measure(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """Counts of every whole text and what it repeats of itself.

    Returns ``id_col`` and the columns of ``MEASURES``; ``with_spans`` adds ``repeats array<struct<start,length>>``, the maximal
    repeats of ``limits.shortest_repeat`` words or more by their first word.  A null text counts as an empty one: all are 0.
    Repeated rows are measured once each; other columns are left out.  A narrow pass, no shuffle; sorts stay inside a block
    of whole documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, measures, repeats in _measured(batches, 1, limits):
            arrays = [rows.column(0), *measures, repeats][: len(_NAMES) + 1 + with_spans]
            yield pa.RecordBatch.from_arrays(arrays, ["id", *_NAMES, "repeats"][: len(arrays)])

    kind = df.schema[id_col].dataType.simpleString()
    return ta.scan(df, run, f"id {kind}, {MEASURES}" + f", repeats {_REPEATS}" * with_spans, id_col, text_col).withColumnRenamed("id", id_col)


def passing(df: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text is kept by :func:`judge`: one narrow pass, without a join."""
    place, columns = df.columns.index(text_col), [f"own_{i}" for i in range(len(df.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, measures, _ in _measured(batches, place, limits):
            yield pa.RecordBatch.from_arrays([*rows.columns, *measures], [*columns, *_NAMES])

    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, df.schema.fields, strict=True))
    judged = judge(df.mapInArrow(run, f"{kinds}, {MEASURES}"), limits).filter("kept")
    return judged.select([F.col(c).alias(name) for c, name in zip(columns, df.columns, strict=True)])


def judge(measures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds ``base_failed``, ``covered_fraction`` and ``kept`` to the output of :func:`measure`.  Integers decide wherever they can."""
    n = F.col("n_words")
    base = (n < limits.least_words) | (100 * F.col("n_repeat_words") > limits.window_percent * n)
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    length = share(F.col("word_chars"), n)
    rejected = (
        (F.col("covered_fraction") > limits.most_covered)
        | ((F.col("longest_repeat") > limits.longest_repeat) & (share(F.col("longest_repeat"), n) > limits.longest_share))
        | (F.col("longest_repeat") > limits.longest_anyway)
        | (share(F.col("n_symbols"), F.col("word_chars")) > limits.symbol_share)
        | (share(F.col("n_dup_lines"), F.col("n_lines")) > limits.dup_line_share)
        | (length < limits.short_word)
        | (length > limits.long_word)
    )
    return measures.withColumn("base_failed", base).withColumn("covered_fraction", share(F.col("n_covered_words"), n)).withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`measure` and :func:`judge` together: one row per input row, with the verdict in ``kept``."""
    return judge(measure(df, limits, id_col, text_col), limits)
