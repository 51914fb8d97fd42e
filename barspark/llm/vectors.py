"""Operator 8: embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells; the cells of several projections make a table key.
Blocks of vectors that share a key are compared by exact cosine in double precision; of several tables that hold a pair, the first
counts it.  Equal vectors are one node with a number of copies.
"""

from __future__ import annotations

import math
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
    cosine: float = 0.9
    cell: float = 2.0  # width of a projection's cells
    miss: float = 0.02  # chance that a pair exactly at the limit shares no table
    chance: float = 0.03  # vectors at a right angle that a table should put beside a vector
    seed: int = 11


def same_cell(distance: float, cell: float) -> float:
    """Chance that two points so far apart share a cell of one projection (Datar, Immorlica, Indyk and Mirrokni, 2004)."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, s: Settings) -> tuple[int, int]:
    """Projections in a key, and tables, for n vectors."""
    near, far = same_cell(math.sqrt(2 - 2 * s.cosine), s.cell), same_cell(math.sqrt(2), s.cell)
    width = max(4, math.ceil(math.log(max(n, 2) / s.chance) / -math.log(far)))
    return width, math.ceil(math.log(s.miss) / math.log1p(-(near**width)))


def _nodes(df: DataFrame, s: Settings, width: int, tables: int, vector_col: str) -> DataFrame:
    """vector (normalised doubles) and keys (one 64-bit number a table) of each usable vector."""
    spaces: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i in range(0, len(lists), 256):
                by_size: dict[int, list[int]] = {}
                for j in range(i, min(i + 256, len(lists))):
                    by_size.setdefault(len(lists[j]), []).append(j)
                for size, own in by_size.items():
                    if size not in spaces:
                        rng = np.random.default_rng((s.seed, size))
                        spaces[size] = rng.standard_normal((size, tables * width)), rng.uniform(0, s.cell, tables * width)
                    x = np.array([lists[j] for j in own], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    cells = np.floor((x @ spaces[size][0] + spaces[size][1]) / s.cell).astype(np.int64).view(np.uint64).reshape(len(own), tables, width)
                    key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(size * 1_000_003), (len(own), tables)).copy()
                    for k in range(width):
                        key = ta.mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., k])
                    as_bytes = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), as_bytes(x), as_bytes(key)], ["node", "vector", "keys"])

    return df.select("node", vector_col).mapInArrow(run, "node long, vector binary, keys binary")


def _tables(nodes: DataFrame, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                keys = buckets.fixed(part.column(1).cast(pa.binary()), "<i8")[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), tables))], ["key", "node"])

    return nodes.select("node", "keys").mapInArrow(run, "key long, node long")


def _linked(s: Settings, tables: int):
    """From each block: how many vectors each node links with there for the first time, and edges that span these links."""

    def run(whole: Iterator[tuple[list[pa.Array], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for columns, bounds in whole:
            key, side, node = (columns[i].to_numpy() for i in (0, 3, 4))
            vectors, at = buckets.fixed(columns[5].cast(pa.binary()), "<f8")
            keys = buckets.fixed(columns[6].cast(pa.binary()), "<u4")[0].reshape(len(node), tables)
            low = key.view(np.uint64).astype(np.uint32)
            copies = columns[7].to_numpy()
            out_node, out_count, out_root = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cut = a + int(np.searchsorted(side[a:b], 1))
                if b - a < 2 or cut == a:
                    continue
                block = vectors[at[a] : at[b]].reshape(b - a, -1)
                if cut < b:
                    hit = np.nonzero(block[: cut - a] @ block[cut - a :].T >= s.cosine)
                    i, j = hit[0], hit[1] + cut - a
                else:
                    i, j = np.nonzero(np.triu(block @ block.T >= s.cosine, 1))
                if not len(i):
                    continue
                own = keys[a:b]
                table = int(np.flatnonzero(own[0] == low[a])[0])
                for t in range(table):  # pairs that an earlier table holds are counted there
                    fresh = own[i, t] != own[j, t]
                    i, j = i[fresh], j[fresh]
                    if not len(i):
                        break
                if not len(i):
                    continue
                n = b - a
                count = np.bincount(i, copies[a:b][j], n) + np.bincount(j, copies[a:b][i], n)
                root = np.arange(n)
                while True:
                    least = np.minimum(root[i], root[j])
                    new = root.copy()
                    np.minimum.at(new, i, least)
                    np.minimum.at(new, j, least)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                some = np.flatnonzero(count)
                out_node.append(node[a:b][some])
                out_count.append(count[some].astype(np.int64))
                out_root.append(node[a:b][root[some]])
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_node, out_count, out_root)], ["node", "n", "root"])

    return run


def link(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Near-duplicate vectors: ``id_col, n_links, component_id, kept``, one row per input row.

    Pairs are those found in a shared table with a cosine of ``settings.cosine`` or more; ``n_links`` counts other rows, copies included.
    A vector that is null, empty, zero or holds a null or a value that is not finite links with nothing and is kept; vectors of different
    lengths do not link.  A null id never names a group while another has an id.  Other columns are left out.
    """
    s = settings
    value = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(
        (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0),
        F.lit(False),
    )
    # 0.0 for -0.0, so that both hash alike
    rows = df.select(F.col(id_col).alias("id"), F.when(usable, F.transform(value, lambda x: x + F.lit(0.0))).alias("vector")).withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    real = rows.filter("node IS NOT NULL")
    distinct = stored(real.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")), "vectors")
    width, tables = plan(distinct.count(), s)
    hashed = stored(_nodes(distinct, s, width, tables, "vector"), "hashed")
    shared = stored(buckets.shared_keys(hashed, lambda x: _tables(x, tables)), "tables")
    large = buckets.few(stored(buckets.large_keys(shared), "large"))
    low = F.unhex(F.regexp_replace(F.hex("keys"), "(.{8}).{8}", "$1"))  # half of each key tells whether an earlier table held a pair
    payload = hashed.join(distinct.select("node", "copies"), "node").select("node", "vector", low.alias("keys"), "copies")
    found = stored(buckets.in_blocks(buckets.blocks(shared, large), payload, _linked(s, tables), "node long, n long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = distinct.select("node", "id", "copies").join(roots, "node", "left").join(counts, "node", "left")
    grouped = grouped.select("node", "id", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = stored(grouped.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("members")), "named")
    total = rows.count()
    by_node = stored(buckets.left_join(grouped, named, "root", "members", total).select("node", "n_links", "component_id", "copies"), "groups")
    out = buckets.left_join(rows.select("id", "node"), by_node, "node", "copies", total)
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
