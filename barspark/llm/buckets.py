"""Work inside hash buckets without emitting a bucket's pairs.

A bucket that a single node has is dropped while sorted rows stream by.  Large buckets are cut into chunks: either each chunk is a block,
or each pair of chunks is, so that every pair of nodes of a bucket shares a block.  No key's rows meet in one task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512
#: Of the nodes one in so many is looked at for keys that very many have; a key is one of them from so many nodes there on.  At most so many are listed.
ONE_IN, OFTEN, MOST_LISTED = 64, 256, 10_000
#: Rows up to which a table of large keys is broadcast.
MOST_BROADCAST = 500_000


def shared_keys(nodes: DataFrame, tables: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows (key long, node long) of ``tables(nodes)`` whose key other nodes have, too.

    Keys that very many nodes have are found among a part of the nodes first.  That they are shared is then known, so their rows, all of them,
    go on without meeting in one task; which keys are listed changes the way of the rows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # the last row so far, and whether it is already known to share its key
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            before = held is not None and held[0] == key[0]
            if held is not None and (held[2] or before):
                yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], ["key", "node"])
            same = key[1:] == key[:-1]
            shares = np.append(before, same) | np.append(same, False)
            out = np.flatnonzero(shares[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])
            held = int(key[-1]), int(node[-1]), bool(shares[-1])
        if held is not None and held[2]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], ["key", "node"])

    part = nodes.filter(F.pmod(F.xxhash64("node", F.lit("often")), F.lit(ONE_IN)) == 0)
    often = tables(part).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN).orderBy(F.desc("n")).limit(MOST_LISTED).collect()
    light = tables(nodes).select("key", "node")
    if not often:
        return _shared(light, run)
    listed = F.broadcast(nodes.sparkSession.createDataFrame([(r["key"],) for r in often], "key long"))
    return _shared(light.join(listed, "key", "left_anti"), run).unionByName(light.join(listed, "key", "left_semi"))


def _shared(light: DataFrame, run) -> DataFrame:
    return light.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def large_keys(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key and n, the number of chunks, of keys that more than ``chunk`` nodes have."""
    return rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("n")).filter(F.col("n") > 1)


def few(df: DataFrame) -> DataFrame:
    """The stored table as one to be broadcast, if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def blocks(rows: DataFrame, large: DataFrame, all_pairs: bool = True, salt: int = 0) -> DataFrame:
    """Adds the block (lo, hi) and the side of each row.  With ``all_pairs``, rows of large buckets occur once for each chunk; else once, in their own chunk."""
    sized = rows.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("n")).cast("int")
    placed = sized.withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)) if all_pairs else F.col("own"))
    return placed.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "node")


def left_join(rows: DataFrame, found: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row for each key and says in ``size`` how many rows have it.

    Keys with at least a 5,000th of all rows, and so 5,000 of them at most, are broadcast; the others are joined by a shuffle, null keys not at all.
    """
    limit = max(20_000, total // 5_000)
    hot = found.filter(F.col(size) >= limit).drop(size)
    rest = found.filter(F.col(size) < limit).drop(size)
    known = rows.filter(F.col(key).isNotNull())
    out = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    if not hot.isEmpty():
        out = out.unionByName(known.join(F.broadcast(hot), key))
    return out.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def in_blocks(placed: DataFrame, payload: DataFrame, function, schema: str) -> DataFrame:
    """Brings each node's payload to its blocks and calls function(columns, start, end) for block after block.

    columns: key, lo, hi, side, node and then the payload, as Arrow arrays; a block is a slice of them, its rows sorted by side.
    function yields Arrow record batches of ``schema`` from an iterator over (columns, bounds).
    """
    order = ["key", "lo", "hi"]
    joined = placed.join(payload, "node").select(*order, "side", "node", *[c for c in payload.columns if c != "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(_whole_blocks(batches))

    return joined.repartition(*order).sortWithinPartitions(*order, "side", "node").mapInArrow(run, schema)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        key, lo, hi = (table.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        if len(cut):
            done = table.slice(0, cut[-1]).combine_chunks()
            yield [done.column(i).chunk(0) for i in range(done.num_columns)], np.append(0, cut)
            held = table.slice(cut[-1])
        else:
            held = table
    if held is not None:
        held = held.combine_chunks()
        yield [held.column(i).chunk(0) for i in range(held.num_columns)], np.array([0, held.num_rows])


def fixed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes as one array, and where each row's items start (n + 1)."""
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // width
