"""Operator 2: MinHash near-duplicates with tensored banding.

Two small collections of m short hashes each, made of few minhashes, are combined pairwise into m * m table keys: documents share a
table just if they agree in some hash of either collection, at the cost of about 2 * m instead of m * m hash computations.
Documents with equal shingle sets are one node.  In each table, blocks of nodes are compared by their minhashes and a forest of
likely links is confirmed on full sets; large buckets are cut into chunks for that.  Then one node of each component in a very large bucket is
compared with those of other components, again in chunks and chunks of chunks, so that a large group of near copies becomes one component
at a cost that grows with its size and not with its square.  Last, all likely pairs between the components so far are confirmed, so that no
link that could join two components is passed over.  A pair that several tables hold is passed on by the first of them only, and only
if sketches of both sets (the least of their hashes, or all those of a small set) do not rule it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm import buckets, textarrays as ta
from barspark.llm.components import components
from barspark.llm.storage import stored


@dataclass(frozen=True)
class Settings:
    """At similarity s a pair shares a table with probability (1 - (1 - s**width)**collection)**2: 0.9994 at 0.75."""

    words: int = 5
    percent: int = 75
    collection: int = 10  # hashes in each of the two collections
    width: int = 2  # minhashes in each hash
    least_agreeing: float = 0.4  # of the minhashes, for a pair to be likely; five standard deviations below 0.75
    sketch: int = 1024  # the least of a set's hashes, of nodes with a likely partner; smaller sets are sketched whole
    deviations: float = 4.0  # of a sketch's estimate below the limit, from which on a pair between components isn't confirmed


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of 64-bit hashes of each document's n-word shingles; of fewer words, one hash of them all."""
    data = ta.LOWER[data]
    start, end, at = ta.words(data, offsets)
    word = ta.span_hashes(ta.BYTE_CODE, data, start, end)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.full(max(0, len(word) - n + 1), n, np.uint64)
    for i in range(n):
        rolled = ta.mix(rolled * step + word[i : i + len(rolled)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(rolled[a : b - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        else:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = ta.mix(whole * step + word[i : i + 1])
            out.append(whole[: min(1, b - a)])
    return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each set, whatever the order; 0 for an empty one."""
    size = np.array([len(x) for x in sets], np.int64)
    total, full = np.zeros(len(sets), np.uint64), size > 0
    if full.any():
        head = (np.cumsum(size) - size)[full]
        flat = ta.mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F))
        total[full] = ta.mix(np.add.reduceat(flat, head) + size[full].astype(np.uint64))
    return total.view(np.int64)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20200519)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _documents(df: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, node (a hash of the set, null for an empty one), the minhashes and, for a row without an id, a hash of its text."""
    n = 2 * s.collection * s.width
    mask, factor = _multipliers(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ta.text_blocks(batches):
            sets = shingles(data, offsets, s.words)
            size = np.array([len(x) for x in sets], np.int64)
            full = size > 0
            flat = np.concatenate(sets)
            least = np.zeros((len(sets), n), np.uint32)
            if len(flat):
                head = (np.cumsum(size) - size)[full]
                for j in range(n):
                    hashed = (flat ^ mask[j]) * factor[j]
                    least[full, j] = np.minimum.reduceat(hashed, head) >> np.uint64(32)
            signs = least.astype("<u4").tobytes()
            width = 4 * n
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size), pa.array(set_hashes(sets), mask=~full), pa.array([signs[i : i + width] if f else None for i, f in zip(range(0, len(signs), width), full.tolist(), strict=True)], pa.binary()), rows.column(2)],
                ["id", "n_shingles", "node", "least", "of_text"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    without_id = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string")))
    return ta.scan(df, run, f"id {kind}, n_shingles long, node long, least binary, of_text long", id_col, text_col, without_id)


#: The low bits of a key are the number of its table.
TABLE = np.uint64(1023)


def _tables(nodes: DataFrame, s: Settings) -> DataFrame:
    """(key, node) for every table: each hash of one collection with each of the other."""
    m = s.collection

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            if not len(node):
                continue
            least = buckets.fixed(batch.column(1).cast(pa.binary()), "<u4")[0].reshape(len(node), 2, m, s.width).astype(np.uint64)
            hashed = np.zeros((len(node), 2, m), np.uint64)
            for i in range(s.width):
                hashed = ta.mix(hashed * np.uint64(0x9E3779B97F4A7C15) + least[..., i])
            place = np.arange(m, dtype=np.uint64)
            for i in range(m):
                table = place + np.uint64(i * m)
                key = ta.mix(hashed[:, 0, i, None] * np.uint64(0xD6E8FEB86659FD93) + hashed[:, 1] + table) & ~TABLE | table
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, m))], ["key", "node"])

    return nodes.select("node", "least").mapInArrow(run, "key long, node long")


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint8)
    for j in range(a.shape[1]):
        out += a[:, j, None] == b[None, :, j]
    return out


def _first_table(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """The number of the first table that holds each of the pairs (a[i], b[i])."""
    same = (a == b).reshape(len(a), 2, s.collection, s.width).all(3)
    return same[:, 0].argmax(1) * s.collection + same[:, 1].argmax(1)


def _likely(s: Settings, every: bool, earlier: bool = True):
    """Likely pairs (a, b) of each block.  ``every``: all of them between components, each in its first table only; else for each node b its best
    partner a, of the nodes before it if ``earlier``.

    Minhashes are whole with ``every``, as in the tables, so that a pair is found in the first table it shares; else their lower halves.
    Where the payload has roots, only nodes of different components are partners.
    """
    n = 2 * s.collection * s.width
    least = int(np.ceil(s.least_agreeing * n))

    def run(whole: Iterator[tuple[list[pa.Array], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for columns, bounds in whole:
            key, side, node = (columns[i].to_numpy() for i in (0, 3, 4))
            signs = buckets.fixed(columns[5].cast(pa.binary()), "<u4" if every else "<u2")[0].reshape(len(node), n)
            root = columns[6].to_numpy() if len(columns) > 6 else None
            images, at = buckets.fixed(columns[7].cast(pa.binary()), "<u4") if every else (None, None)
            found: list[np.ndarray] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2 or (root is not None and (root[a:b] == root[a]).all()):
                    continue
                cut = a + int(np.searchsorted(side[a:b], 1))
                two = cut < b
                if two and cut == a:
                    continue
                rows, cols = (slice(a, cut), slice(cut, b)) if two else (slice(a, b), slice(a, b))
                agree = _agreeing(signs[cols], signs[rows])
                if not two:
                    agree = np.tril(agree, -1) if every or earlier else np.where(np.eye(b - a, dtype=bool), 0, agree)
                if root is not None:
                    agree[root[cols][:, None] == root[rows][None, :]] = 0
                if not every:
                    best = (agree // 4).argmax(1)  # of about equally good partners the first, so that tables agree on it
                    good = np.flatnonzero(agree[np.arange(len(best)), best] >= least)
                    found.append(np.stack([node[rows][best[good]], node[cols][good]], 1))
                    continue
                i, j = np.nonzero(agree >= least)
                table = int(key.view(np.uint64)[a] & TABLE)
                for k in range(0, len(i), 20_000):
                    x, y = i[k : k + 20_000] + cols.start, j[k : k + 20_000] + rows.start
                    own = _first_table(signs[x], signs[y], s) == table
                    x, y = x[own], y[own]
                    near = _near(images, at, x, y, s)
                    found.append(np.stack([node[x[near]], node[y[near]]], 1))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            pairs = np.unique(np.sort(pairs, 1) if every else pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sketches(sets: DataFrame, s: Settings) -> DataFrame:
    """node and the ``s.sketch`` least of its set's hashes, cut to four bytes each and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                flat, at = buckets.fixed(part.column(1).cast(pa.binary()), "<u8")
                images = (ta.mix(flat) >> np.uint64(32)).astype("<u4")
                own = [np.unique(images[a:b])[: s.sketch].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], ["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, sketch binary")


def _near(images: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Whether the sketches of each pair (x[i], y[i]) leave it likely; sketch i is images[at[i] : at[i + 1]].

    Up to the smaller of the greatest hashes of full sketches both are complete, so the sets are compared there.  Two sketches of whole
    sets are ruled out by their sizes alone, less two hashes that may be equal once cut.
    """
    size = np.diff(at)
    top = np.where(size == s.sketch, images[at[1:] - 1], np.uint32(0xFFFFFFFF))
    limit, out = s.percent / 100, np.zeros(len(x), bool)
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1])) if len(x) else []
    for places in np.split(order, first[1:]) if len(x) else []:
        one, others = x[places[0]], y[places]
        own = images[at[one] : at[one + 1]]
        flat = np.concatenate([images[at[j] : at[j + 1]] for j in others.tolist()])
        head = np.cumsum(size[others]) - size[others]
        bound = np.minimum(top[one], top[others])
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat, head, dtype=np.int64)
        union = np.searchsorted(own, bound, "right") + np.add.reduceat(flat <= np.repeat(bound, size[others]), head, dtype=np.int64) - both
        whole = (size[one] < s.sketch) & (size[others] < s.sketch)
        spread = s.deviations * np.sqrt(limit * (1 - limit) * union)
        out[places] = np.where(whole, both + 2 >= limit * (union - 2), both >= limit * union - spread)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _sets(df: DataFrame, wanted: DataFrame, ids_repeat: bool, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (sorted 64-bit hashes): one row for each wanted node; wanted: node, id and, where that is null, of_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in ta.text_blocks(batches):
            sets = shingles(data, offsets, s.words)
            node = rows.column(0).to_numpy()
            right = np.flatnonzero(set_hashes(sets) == node)  # an id may have another text, too
            right = right[np.unique(node[right], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array([sets[i].astype("<u8").tobytes() for i in right], pa.binary())], ["node", "shingles"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    by_id = wanted.filter("id IS NOT NULL").hint("shuffle_hash").join(texts, "id").select("node", "text").mapInArrow(run, "node long, shingles binary")
    if ids_repeat:
        by_id = by_id.dropDuplicates(["node"])
    nameless = wanted.filter("id IS NULL").select("node", "of_text")
    if nameless.isEmpty():
        return by_id
    same = texts.filter("id IS NULL").withColumn("of_text", F.xxhash64("text")).dropDuplicates(["of_text"])
    return by_id.unionByName(nameless.join(same, "of_text").select("node", "text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]))


#: Chunks of a bucket of which all pairs are compared at once; a larger bucket starts with single chunks.
PAIRED = 8
#: Rounds in which components in large buckets are compared by one node each; each leaves about one in a chunk's size.
ROUNDS = 4


def link(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups near-duplicates: ``id_col, n_shingles, component_id, kept``, one row per input row.

    ``component_id`` is the smallest id reached by links, the row's own included; ``kept`` says whether it is the row's own.
    A null or empty text has no shingles, stays alone and is kept.  Equal texts and repeated rows share a component; of rows that
    repeat an id, all count as that id.  A null id shares the component of what it links with, but never names a component that has an id.
    Other columns are left out.  Texts are read twice; what is shuffled are table keys, minhashes of colliding nodes and the
    sets of likely pairs.
    """
    s = settings
    documents = stored(_documents(df, s, id_col, text_col), "shingled")
    nodes = documents.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("least").alias("least"), F.max("of_text").alias("of_text"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "nodes")
    shared = stored(buckets.shared_keys(nodes, lambda x: _tables(x, s)), "tables")
    large = stored(buckets.large_keys(shared), "large")
    large_few = buckets.few(large)
    crowd = large.filter(F.col("n") > PAIRED)
    crowded = not crowd.isEmpty()
    half = nodes.select("node", "id", "of_text", _low_halves(F.col("least")).alias("least"))
    pairs = "a long, b long"
    in_order = lambda found: found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one_partner = lambda found: in_order(found.groupBy("b").agg(F.mode("a", True).alias("a")))
    payload = half.select("node", "least")
    ordinary = shared.join(crowd.select("key"), "key", "left_anti") if crowded else shared
    forest = in_order(buckets.in_blocks(buckets.blocks(ordinary, large_few), payload, _likely(s, False), pairs))
    if crowded:  # there a node may meet other partners in every table; one is enough for a start
        in_large = stored(shared.join(crowd, "key"), "in-large")
        start = buckets.in_blocks(buckets.blocks(in_large.select("key", "node"), crowd, False), payload, _likely(s, False, False), pairs)
        forest = forest.unionByName(one_partner(start)).distinct()
    forest = stored(forest, "forest")
    likely_nodes = forest.select(F.col("a").alias("node")).union(forest.select("b"))
    if crowded:  # they may have partners in other chunks
        likely_nodes = likely_nodes.union(in_large.select("node"))
    ids_repeat = not documents.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    sets = stored(_sets(df, half.join(likely_nodes.distinct(), "node").select("node", "id", "of_text"), ids_repeat, s, id_col, text_col), "sets")
    links = stored(_confirmed(forest, sets, s), "links")
    roots = components(links)
    sketched = nodes.select("node", "least").join(_sketches(sets, s), "node")
    sketched = stored(sketched, "sketched") if crowded else sketched
    rooted = lambda: sketched.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"), "sketch")
    for turn in range(ROUNDS if crowded else 0):
        # the node with the most links stands for its component: what many are near to
        degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        known = stored(in_large.select("node").distinct().join(roots, "node", "left").join(degree, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree")), "known")
        members = in_large.select("key", "node").join(known, "node").groupBy("key", "root").agg(F.max_by("node", F.struct("degree", "node")).alias("node"))
        members = stored(members, "members")
        several = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", F.ceil(F.col("m") / buckets.CHUNK).cast("int").alias("n"))
        several = stored(several, "several")
        if several.isEmpty():
            break
        placed = buckets.blocks(members.select("key", "node").join(several.select("key"), "key", "left_semi"), several, False, turn)
        found = stored(_confirmed(one_partner(buckets.in_blocks(placed, rooted().drop("sketch").withColumn("least", _low_halves(F.col("least"))), _likely(s, False, False), pairs)), sets, s), "links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = components(links)
    # in each table once more: likely pairs that may join two components
    rooted_now = stored(rooted(), "rooted")
    own = stored(shared.join(rooted_now.select("node", "root"), "node"), "rooted-tables")
    open_keys = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    again = buckets.blocks(own.join(open_keys, "key", "left_semi").select("key", "node"), large_few)
    more = buckets.in_blocks(again, rooted_now, _likely(s, True), pairs)
    links = links.unionByName(stored(_confirmed(more.join(forest, ["a", "b"], "left_anti"), sets, s), "links"))
    grouped = nodes.select("node", "id", "copies").join(components(links), "node", "left").select("node", "id", "copies", F.coalesce("root", "node").alias("root"))
    named = stored(grouped.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")), "named")
    total = documents.count()
    by_node = stored(buckets.left_join(grouped, named, "root", "members", total).select("node", "component_id", "copies"), "groups")
    out = buckets.left_join(documents.select("id", "n_shingles", "node"), by_node, "node", "copies", total)
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _low_halves(least):
    """Two of the four bytes of each minhash, to compare by."""
    return F.unhex(F.regexp_replace(F.hex(least), "(.{4}).{4}", "$1"))
