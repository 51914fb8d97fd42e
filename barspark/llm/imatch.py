"""Operator 13: I-Match fingerprints.

Terms are lower-cased words whose inverse document frequency lies in a band.  A fingerprint holds hashes of a text's distinct terms within
randomised subsets of that lexicon.  A subset takes a share of the lexicon that halves as the number of terms of a text doubles, so a text
of any length has about one term in a subset; two texts share a hash if they have the same terms there.  The share of subsets on which they
agree measures how alike they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm import textarrays as ta
from barspark.llm.storage import stored


#: Of a text's distinct words one in so many at least must be in the band; else all its words count.
ENOUGH = 4
#: Sizes of subsets in a fingerprint.
SIZES = 3


@dataclass(frozen=True)
class Settings:
    """lowest, highest: the band of ln(documents / documents with the term); the ends count.

    A term of the band is in a share of exp(-highest) of the documents at least, so the lexicon has at most exp(highest) terms for each
    distinct term of a mean document, however many documents there are.
    """

    lowest: float = 1.5
    highest: float = 8.0
    subsets: int = 64
    seed: int = 1
    most_listed: int = 4_000_000  # terms of the lexicon up to which tasks hold it; a larger one is joined


_ODD = 0x9E3779B97F4A7C15


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, and where each text's words begin (n + 1)."""
    start, end, first = ta.words(data, offsets)
    return ta.span_hashes(ta.BYTE_CODE, ta.LOWER[data], start, end), first


def _distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term), ordered by both."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """term (64-bit hash), n: in how many texts a word occurs, over all rows.  Each task adds up what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])

        for _, data, offsets in ta.text_blocks(batches, 0):
            term, first = _terms(data, offsets)
            held.append(_distinct(ta.owners(first), term)[1])
            if sum(map(len, held)) > 1_000_000:
                yield counts()
        if held:
            yield counts()

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The stored terms of the band, ascending."""
    n = df.count()
    low, high = n * np.exp(-settings.highest), n * np.exp(-settings.lowest)
    return stored(document_frequencies(df, text_col).filter((F.col("n") >= float(low)) & (F.col("n") <= float(high))).select("term"), "lexicon")


def signatures(doc: np.ndarray, term: np.ndarray, n: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """level (n) and hashes (n, SIZES, subsets) of texts 0..n-1 from their distinct (text, term); an empty subset has hash 0.

    At level l a subset is one of 2**l parts of the lexicon; if there are fewer parts than subsets, the lexicon is cut again by other hashes.
    Each text has the subsets of its own level, the number of binary digits of its number of terms, and of the levels after it.
    """
    own = np.bincount(doc, minlength=n)
    level = np.zeros(n, np.int64)
    level[own > 0] = np.floor(np.log2(own[own > 0])).astype(np.int64) + 1
    out = np.zeros(n * SIZES * s.subsets, np.uint64)
    digits = s.subsets.bit_length() - 1
    for step in range(SIZES):
        at = level[doc] + step
        cuts = s.subsets >> np.minimum(at, digits)  # how often the lexicon is cut for subsets of this size
        for again in range(int(cuts.max(initial=0))):
            used = np.flatnonzero(cuts > again)
            u = ta.mix(term[used] + np.uint64(_ODD * (1 + again + (s.seed << 16)) % 2**64))
            part = u & ((np.uint64(1) << at[used].astype(np.uint64)) - np.uint64(1))
            keep = part < np.uint64(s.subsets)
            subset = part[keep].astype(np.int64) + (again << np.minimum(at[used][keep], digits))
            np.add.at(out, (doc[used][keep] * SIZES + step) * s.subsets + subset, ta.mix(u[keep] ^ np.uint64(_ODD)))
    out = out.reshape(n, SIZES, s.subsets)
    return level, out


def _written(level: np.ndarray, hashes: np.ndarray) -> list[str]:
    short = (ta.mix(hashes) >> np.uint64(32)).astype(np.uint32)
    short = np.where(hashes == 0, 0, np.maximum(short, 1)).astype(">u4")
    return [":".join([f"{k:02d}", *(x.tobytes().hex() for x in own)]) for k, own in zip(level.tolist(), short, strict=True)]


def likeness(a: str | Column, b: str | Column) -> Column:
    """How alike two fingerprints are, 0 to 1: of the subsets in which either has a term, the share on which they agree.

    They are compared at the level that they have in common; texts of which one has over four to eight times as many terms have none: 0.
    Two texts without terms are alike (1).  Null if either is null.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    la, lb = F.substring(a, 1, 2).cast("int"), F.substring(b, 1, 2).cast("int")
    at = F.greatest(la, lb)
    of = lambda x, own: F.regexp_extract_all(F.get(F.split(x, ":"), at - own + 1), F.lit("(.{8})"), 1)
    pairs = F.arrays_zip(of(a, la).alias("x"), of(b, lb).alias("y"))
    none = F.lit("0" * 8)
    some = F.size(F.filter(pairs, lambda p: (p["x"] != none) | (p["y"] != none)))
    same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != none)))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(F.abs(la - lb) >= SIZES, 0.0).when(some == 0, 0.0).otherwise(same / some)


class Fingerprints:
    """Fingerprints of blocks of texts, given the sorted lexicon."""

    def __init__(self, known: np.ndarray, settings: Settings):
        self.known, self.settings = known, settings

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        term, first = _terms(data, offsets)
        doc, term = _distinct(ta.owners(first), term)
        at = np.searchsorted(self.known, term)
        inside = at < len(self.known)
        inside[inside] = self.known[at[inside]] == term[inside]
        n = len(offsets) - 1
        few = np.bincount(doc[inside], minlength=n) * ENOUGH < np.bincount(doc, minlength=n)
        inside |= few[doc]
        return _written(*signatures(doc[inside], term[inside], n, self.settings))


def edited(data: np.ndarray, offsets: np.ndarray, share: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts 0..n-2 with their last characters // share replaced by the first as many of the next text, and the characters of each text."""
    starts = np.flatnonzero(ta.NOT_CONTINUATION[data])  # of characters
    first = np.searchsorted(starts, offsets)
    chars, starts = np.diff(first), np.append(starts, len(data))
    taken = chars[:-1] // share
    head = starts[first[1:-1] - taken]  # where the replaced end begins
    tail = starts[first[1:-1] + np.minimum(taken, chars[1:])]
    own, more = head - offsets[:-2], tail - offsets[1:-1]
    places = np.column_stack([offsets[:-2], offsets[1:-1]]).ravel()
    lengths = np.column_stack([own, more]).ravel()
    return data[ta.ragged(places, lengths)], np.append(0, np.cumsum(own + more)), chars


def _listed(terms: DataFrame, settings: Settings) -> np.ndarray | None:
    if terms.count() > settings.most_listed:
        return None
    return np.sort(terms.toArrow().column("term").to_numpy().view(np.uint64)) if not terms.isEmpty() else np.zeros(0, np.uint64)


def fingerprints(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """id, ``fingerprint`` of each row, by the lexicon ``terms`` (that of ``df`` by default).

    Whole texts count; a null text is an empty one, and texts without words have the fingerprint of no terms.  If under a quarter
    of a text's words are in the band, all of them count.  Equal texts have equal fingerprints, and so have texts of the same terms.  Repeated rows each have a row.
    An empty table gives an empty one.  Other columns are not looked at.  A lexicon of more than ``most_listed`` terms is joined to the
    words of each text by a shuffle instead of being held by each task, with the same result.
    """
    terms = lexicon(df, settings, text_col) if terms is None else terms
    known = _listed(terms, settings)
    if known is None:
        return _joined(df, terms, settings, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprints(shared.value, settings)
        for rows, data, offsets in ta.text_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(of(data, offsets))], [id_col, "fingerprint"])

    return ta.scan(df, run, f"{id_col} {_type(df, id_col)}, fingerprint string", id_col, text_col)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def against_edited(df: DataFrame, settings: Settings = Settings(), share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_chars`` and the fingerprints of each text, of its edited text and of the next text by ascending id (after the last, the first).

    In the edited text the last n_chars // share characters give way to the first as many of the next text, or all; ``edited_sha256`` is of
    its UTF-8.  Nulls, empty tables and so on as in ``fingerprints``; rows without an id come first, rows that repeat one by a hash of their text.
    """
    terms = lexicon(df, settings, text_col)
    known = _listed(terms, settings)
    columns = ["fingerprint", "edited_fingerprint", "next_fingerprint"]
    start = f"{id_col} {_type(df, id_col)}, n_chars long, edited_sha256 string"

    def changed(data: np.ndarray, offsets: np.ndarray) -> tuple:
        new, ends, chars = edited(data, offsets, share)
        raw = new.tobytes()
        return new, ends, chars[:-1], [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    if known is not None:
        shared = df.sparkSession.sparkContext.broadcast(known)

        def held(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            of = Fingerprints(shared.value, settings)
            new, ends, chars, digests = changed(data, offsets)
            own = of(data, offsets)
            return pa.RecordBatch.from_arrays([ids, pa.array(chars), pa.array(digests), pa.array(own[:-1]), pa.array(of(new, ends)), pa.array(own[1:])], [id_col, "n_chars", "edited_sha256", *columns])

        return with_next(df, held, f"{start}, " + ", ".join(f"{c} string" for c in columns), id_col, text_col)

    def texts(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        new, ends, chars, digests = changed(data, offsets)
        whole, new = data.tobytes(), new.tobytes()
        each = [[whole[offsets[k] : offsets[k + 1]].decode(), new[ends[k] : ends[k + 1]].decode(), whole[offsets[k + 1] : offsets[k + 2]].decode()] for k in range(len(ids))]
        return pa.RecordBatch.from_arrays([ids, pa.array(chars), pa.array(digests), pa.array(each, pa.list_(pa.string()))], [id_col, "n_chars", "edited_sha256", "_texts"])

    rows = stored(with_next(df, texts, f"{start}, _texts array<string>", id_col, text_col).withColumn("_row", F.monotonically_increasing_id() * 3), "edited")
    made = _joined(rows.select("_row", F.posexplode("_texts")).select((F.col("_row") + F.col("pos")).alias("_key"), "col"), terms, settings, "_key", "col")
    which = F.pmod("_key", F.lit(3))
    made = made.groupBy((F.col("_key") - which).alias("_row")).agg(*[F.max(F.when(which == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(columns)])
    return rows.join(made, "_row").select(id_col, "n_chars", "edited_sha256", *columns)


def _joined(df: DataFrame, terms: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """The way for a lexicon that is too large to be held: (row, term) joined to it and put together again for each row."""
    rows = stored(df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row")), "texts")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data, offsets in ta.text_blocks(batches):
            term, first = _terms(data, offsets)
            doc, term = _distinct(ta.owners(first), term)
            yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(doc)), pa.array(term.view(np.int64))], ["_row", "term"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            doc = ta.owners(offsets - offsets[0])
            term = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            made = _written(*signatures(*_distinct(doc, term), batch.num_rows, settings))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], [id_col, "fingerprint"])

    each = ta.scan(rows, words, "_row long, term long", "_row", "_text").join(terms.withColumn("_known", F.lit(True)), "term", "left")
    lists = each.groupBy("_row").agg(F.collect_list(F.when(F.col("_known"), F.col("term"))).alias("_inside"), F.collect_list("term").alias("_all"))
    picked = lists.select("_row", F.when(F.size("_inside") * ENOUGH < F.size("_all"), F.col("_all")).otherwise(F.col("_inside")).alias("_terms"))
    whole = rows.select(id_col, "_row").join(picked, "_row", "left").select(id_col, F.coalesce("_terms", F.array().cast("array<long>")))
    return whole.mapInArrow(run, f"{id_col} {_type(df, id_col)}, fingerprint string")


def _order_key(value, order: int) -> tuple:
    """Ids ascend, null first; rows with one id by a hash of their text."""
    return (value is not None, 0 if value is None else value, order)


def with_next(df: DataFrame, function, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Calls function(ids, data, offsets) over blocks of texts in ascending order of ids, in which the last text is the first of the next block.

    After the last text of all comes the first.  The texts are dealt by ranges of ids and shuffled once.  The first row of each range goes to
    the range before, too.  Rows that repeat an id are ordered by a hash of their text and may be in several ranges.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_order"), text.alias("_text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("_id", "_order").repartitionByRange(parts, "_id", "_order").groupBy(F.spark_partition_id()).agg(F.min(F.struct("_id", "_order")).alias("first"))
    cuts = sorted(_order_key(r["first"]["_id"], r["first"]["_order"]) for r in ranges.collect())  # one for each range

    @F.arrow_udf("array<int>")
    def ranges_of(ids: pa.Array, orders: pa.Array) -> pa.Array:
        out = []
        for value, order in zip(ids.to_pylist(), orders.to_pylist(), strict=True):
            key = _order_key(value, order)
            k = bisect_right(cuts, key) - 1
            out.append([k, (k - 1) % len(cuts) + len(cuts)] if bisect_left(cuts, key) == k else [k])
        return pa.array(out, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                over = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False))
                yield batch.slice(0, over[0] + 1) if len(over) else batch
                if len(over):
                    return

        held: tuple | None = None
        for own, data, offsets in ta.text_blocks(texts()):
            ids = own.column(0)
            if held is not None:
                before, text = held
                ids = pa.concat_arrays([before, ids])
                data, offsets = np.concatenate([text, data]), np.append(0, offsets + len(text))
            if len(ids) > 1:
                yield function(ids[:-1], data, offsets)
            held = ids[-1:], data[offsets[-2] : offsets[-1]].copy()
        for _ in batches:  # repeats of the row after the range
            pass

    if not cuts:
        return df.sparkSession.createDataFrame([], schema)
    dealt = rows.withColumn("_part", F.explode(ranges_of("_id", "_order"))).withColumn("_after", F.col("_part") >= len(cuts))
    dealt = dealt.repartitionById(len(cuts), F.col("_part") % len(cuts)).sortWithinPartitions("_after", "_id", "_order")
    return dealt.select("_id", "_text", "_after").mapInArrow(run, schema)
