"""Operator 12: collocations by direct-address tiling.

Within a block of texts words get ids by rank of frequency.  Pairs of ids fall into tiles of 256 x 256: a tile with many pairs is counted by
one dense bincount, the others, and pairs with a rarer word, as sorted coordinates.  The counts of all blocks are added up by a shuffle
on the phrase.  Frequent pairs are then ranked like words, and pairs of (pair, word) give the phrases of three words, and so on.

What can't be frequent is not counted: a phrase is no more frequent than its parts, so words, and then pairs, must pass a sieve of the
frequent ones.  A sieve is a bitmap of fixed size over hashes: it lets all frequent ones through and few others, which the exact counts drop.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import textarrays as ta
from barspark.llm.places import numbered
from barspark.llm.storage import stored


@dataclass(frozen=True)
class Settings:
    """longest: words of a phrase, 2 at least.  least: occurrences of a candidate.  absorbed: percent of a phrase's occurrences that lie in one
    longer phrase and so drop it.  top: phrases a language."""

    longest: int = 3
    least: int = 10
    absorbed: int = 50
    top: int = 2000


#: Bytes of text whose pairs are counted together, words of a longer text that are, the side of a tile in bits, pairs that fill a tile.
BLOCK_BYTES, BLOCK_WORDS, SIDE, FULL = 4 << 20, 1 << 20, 8, 4096
#: Bits of the sieves: 8 MB for words, 16 MB for phrases, whatever the corpus.
WORD_BITS, PHRASE_BITS = 26, 27
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SPACE = SEPARATOR.copy()
SPACE[[0x20, 0x09]] = True
_CODE = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _language_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a block: their keys (64 bits of language and word), and whether the next word follows in the same piece of text."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray):
        self.data = ta.LOWER[data]
        self.start, self.end, first = ta.words(data, offsets, SPACE)
        self.langs, at = np.unique(np.asarray(langs.to_pylist(), object).astype(str), return_inverse=True)
        codes = np.array([_language_code(x) for x in self.langs], np.uint64)
        doc = ta.owners(first)
        self.lang = at[doc]
        self.key = ta.mix(ta.span_hashes(_CODE, self.data, self.start, self.end) ^ codes[self.lang])
        breaks = np.cumsum(SEPARATOR[data])[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.joins = np.zeros(len(self.start), bool)
        self.joins[:-1] = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1])


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling frequency, and where each id first occurs."""
    _, first, at, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    return rank[at], first[order]


def tiled(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids and how often each occurs."""
    side, cells = (1 << SIDE) - 1, 1 << 2 * SIDE
    near = (left < cells) & (right < cells)
    a, b = left[near], right[near]
    tile = ((a >> SIDE) << SIDE | b >> SIDE).astype(np.uint16)
    cell = ((a & side) << SIDE | b & side).astype(np.uint16)
    fill = np.bincount(tile, minlength=cells)
    upto = np.append(0, np.cumsum(fill))
    order = np.argsort(tile, kind="stable")
    cell = cell[order]
    found = []
    for t in np.flatnonzero(fill >= FULL).tolist():
        n = np.bincount(cell[upto[t] : upto[t + 1]], minlength=cells)
        c = np.flatnonzero(n)
        found.append(((t >> SIDE) << SIDE | c >> SIDE, (t & side) << SIDE | c & side, n[c]))
    sparse = (fill < FULL)[tile]
    for x, y in ((a[sparse], b[sparse]), (left[~near], right[~near])):
        code, n = np.unique(x << 32 | y, return_counts=True)
        found.append((code >> 32, code & 0xFFFFFFFF, n))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _hash(keys: list[np.ndarray]) -> np.ndarray:
    """Of phrases, from the keys of their words."""
    h = keys[0]
    for k in keys[1:]:
        h = ta.mix(h * _STEP + k)
    return h


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(6)) & np.uint64(len(sieve) - 1)
    return (sieve[slot] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _sieve(frequent: DataFrame, keys: list[str], bits: int) -> np.ndarray:
    """A bitmap that every phrase of the table passes; it has 2**(bits - 6) words, whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hash([batch.column(k).to_numpy().view(np.uint64) for k in range(len(keys))])
            slot = ((h >> np.uint64(6)) & np.uint64((1 << bits - 6) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], ["slot", "bit"])

    rows = frequent.select(*keys).mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    sieve = np.zeros(1 << bits - 6, np.uint64)
    if rows.num_rows:
        sieve[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return sieve


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for rows, data, offsets in ta.text_blocks(batches, 1, BLOCK_BYTES):
        yield Words(rows.column(0), data, offsets)
        ta.release()


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word, key, n of each word; a row without a word has a language's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches):
            key, first, n = np.unique(w.key, return_index=True, return_counts=True)
            size = w.end[first] - w.start[first]
            raw = w.data[ta.ragged(w.start[first], size)]
            words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(raw))
            names = pa.array(w.langs.tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(w.lang[first])), words, pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])
            total = np.bincount(w.lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(total)], ["lang", "word", "key", "n"])

    return texts.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def phrase_counts(w: Words, m: int, sieves: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Keys and counts of the phrases of m words of a block whose parts pass the sieves of the shorter ones."""
    for a in range(0, max(len(w.key) - m + 1, 0), BLOCK_WORDS):
        key, joins = w.key[a : a + BLOCK_WORDS + m - 1], w.joins[a : a + BLOCK_WORDS + m - 1]
        passed = _passes(sieves[0], key)
        word = np.full(len(key), -1)
        used = np.flatnonzero(passed)
        word[used], first = ranked(key[used])
        shown = key[used[first]]
        # at[i]: the id of the phrase of j words that begins at word i; names: its words' keys by id
        at, names = word, [shown]
        for j in range(2, m + 1):
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0) & joins[: len(at) - 1])
            left, right = at[both], word[both + j - 1]
            if j == m:
                both = both < BLOCK_WORDS
                x, y, n = tiled(left[both], right[both])
                yield [*(k[x] for k in names), shown[y]], n
                break
            keep = _passes(sieves[j - 1], _hash([*(k[left] for k in names), shown[right]]))
            both, left, right = both[keep], left[keep], right[keep]
            following = np.full(len(at) - 1, -1)
            following[both], first = ranked(left << 32 | right)
            at, names = following, [*(k[left[first]] for k in names), shown[right[first]]]


def count_phrases(texts: DataFrame, m: int, sieves: list[np.ndarray]) -> DataFrame:
    """k1 .. km and a: phrases of m words by the keys of their words."""
    shared = texts.sparkSession.sparkContext.broadcast(sieves)
    keys = [f"k{k + 1}" for k in range(m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches):
            for found, n in phrase_counts(w, m, shared.value):
                yield pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in found), pa.array(n)], [*keys, "a"])

    schema = ", ".join(f"{k} long" for k in [*keys, "a"])
    return texts.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("a").alias("a"))


def collocations(df: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A phrase of 2 to ``longest`` words of one piece of text occurs a times, its first part l and its rest r times, where the cut with the
    lowest score floor(1000000 * a * a / (l * r)) counts, the first of equal ones; n: all words of the language.  Phrases that mostly lie in
    one longer candidate are dropped.  Order: score and a falling, then the phrase's UTF-8 bytes.

    Letters A-Z count as small ones.  A null text is empty, a null language is ``und``; repeated rows count each time, very long texts are
    counted in slices that overlap.  An empty table gives an empty one; other columns of ``df`` are not looked at.  Counts are exact up to
    10^15; two words are taken for one if 64 bits of hash agree, which has a chance of 0.0003 among 10^8 words; that is checked for words
    frequent enough to be in a candidate.
    """
    s = settings
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    words = stored(count_words(texts).filter((F.col("n") >= s.least) | F.col("word").isNull()), "words")
    totals, words = words.filter("word IS NULL").select("lang", "n"), words.filter("word IS NOT NULL")
    if not words.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError("two frequent words have the same key")
    sieves = [_sieve(words, ["key"], WORD_BITS)]
    parts = words.select(F.array("key").alias("p"), F.col("n").alias("a"))
    for m in range(2, s.longest + 1):
        keys = [f"k{k + 1}" for k in range(m)]
        counted = stored(count_phrases(texts, m, sieves).filter(F.col("a") >= s.least), f"phrases-{m}")
        parts = parts.unionByName(counted.select(F.array(*keys).alias("p"), "a"))
        if m < s.longest:
            sieves.append(_sieve(counted, keys, PHRASE_BITS))
    return _best(words, totals, parts, s)


def _best(words: DataFrame, totals: DataFrame, parts: DataFrame, s: Settings) -> DataFrame:
    """From the counts of words and phrases (p: keys, a) to the ranked table."""
    phrases = parts.filter(F.size("p") > 1)
    cuts = phrases.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", 1, F.col("k")).alias("head"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("tail"))
    of = lambda end, count: parts.select(F.col("p").alias(end), F.col("a").alias(count))
    cuts = cuts.join(of("head", "l"), "head").join(of("tail", "r"), "tail")
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    product = wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.select("p", "a", "k", "l", "r", product.alias("_above"), (wide["l"] * wide["r"]).alias("_below")).withColumn("score", F.expr("_above div _below"))
    scored = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.filter(F.size("p") > 2).select("p", "a", F.explode(F.sequence(F.lit(2), F.size("p") - 1)).alias("m"))
    inner = inner.select("a", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - F.col("m") + 1), lambda i: F.slice("p", i, F.col("m")))).alias("p"))
    inner = inner.groupBy("p").agg(F.max("a").alias("within"))
    kept = scored.join(inner, "p", "left").filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * s.absorbed))

    each = kept.select("p", F.posexplode("p").alias("at", "key")).join(words.select("key", "word", F.col("lang")), "key")
    spelt = each.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"), F.max("lang").alias("lang"))
    spelt = spelt.select("p", "lang", F.array_join("words.word", " ").alias("phrase"))
    rows = kept.join(spelt, "p").select("lang", (-F.col("cut.score")).alias("_score"), (-F.col("a")).alias("_a"), "phrase", "cut.l", "cut.r")
    placed = numbered(rows, "lang", ["_score", "_a", "phrase"], "collocations")[0].filter(F.col("_i") < s.top)
    return placed.join(totals, "lang").select("lang", (F.col("_i") + 1).alias("rank"), "phrase", (-F.col("_a")).alias("a"), "l", "r", "n", (-F.col("_score")).alias("score"))
