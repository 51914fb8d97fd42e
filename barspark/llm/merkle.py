"""Operator 11: a Merkle manifest of a table by time-forward processing.

Rows are leaves, every group of rows has a tree of up to 16 children a node, and the groups' roots are the leaves of one more tree.  A node's
label is (the last leaf under it, its height), so children come before parents.  Digests are messages to the parent's label: a priority
queue hands them out in label order.  The queue is external: messages inside a block of 256 neighbouring nodes wait in a heap, those that
leave it in a stored table that a shuffle sorts by label for the next blocks.  A reversed sweep, from the last label to the first,
hands every node the suffix of its proof.

No task holds more than a block; a tree of n leaves takes log256(n) rounds, and a group with most of the rows is spread over its blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.places import numbered, runs
from barspark.llm.storage import stored

#: Bits of a node's children, levels that one round climbs, and so bits of a block.
FAN, LEVELS = 4, 2
BLOCK = FAN * LEVELS

STEP = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(*columns: Column) -> Column:
    """sha256 of the values one after the other, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _label(leaf: int, height: int, last: int) -> tuple[int, int]:
    """Of the node above a leaf of the block: where its leaves end, and its height."""
    return min((leaf >> FAN * height) + 1 << FAN * height, last + 1), height


def ascend(leaves: list[str], height: int) -> dict[tuple[int, int], tuple[str, list[tuple[int, int]]]]:
    """Digest and children of each node above a block's leaves, up to the height, by label in ascending order."""
    last = len(leaves) - 1
    queue = [(_label(i, 0, last), i, (i + 1, -1), value) for i, value in enumerate(leaves)]  # in order, so a heap
    nodes = {}
    while queue:
        label, children, values = queue[0][0], [], []
        while queue and queue[0][0] == label:
            _, first, child, value = heapq.heappop(queue)
            children.append((first, child))
            values.append(value)
        nodes[label] = values[0] if label[1] == 0 else digest(values), [c for _, c in children]
        if label[1] < height:
            first = children[0][0]
            heapq.heappush(queue, (_label(first, label[1] + 1, last), first, label, nodes[label][0]))
    return nodes


def descend(nodes: dict, top: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proofs of a block's leaves: the reversed sweep from the block's top node, whose own proof is ``top``."""
    paths: list[list[tuple[str, str]]] = []
    (end, height), _ = next(reversed(nodes.items()))
    queue = [((-end, -height), top)]
    while queue:
        (end, height), path = heapq.heappop(queue)
        children = nodes[-end, -height][1]
        if height == 0:
            paths.append(path)
            continue
        values = [nodes[c][0] for c in children]
        for k, (e, h) in enumerate(children):
            heapq.heappush(queue, ((-e, -h), [("".join(values[:k]), "".join(values[k + 1 :])), *path]))
    return paths[::-1]


def _height(n: int) -> int:
    """Levels that a round climbs in a tree that has n nodes left."""
    return 0 if n == 1 else 1 if n <= 1 << FAN else LEVELS


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block after block of rows that are sorted by (_tree, _block)."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        cuts = runs([batch.column("_tree"), batch.column("_block")])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks whole in one task, their rows in order."""
    keys = ["_tree", "_block"]
    return nodes.repartition(*keys).sortWithinPartitions(*keys, "_kind", "_i")


def _climb(nodes: DataFrame) -> DataFrame:
    """One round up: the nodes above blocks of 256 of a tree; a tree of one node stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, blocks, counts, digests = [], [], [], []
        for block in _whole_blocks(batches):
            n = block.column("_n")[0].as_py()
            label, (value, _) = next(reversed(ascend(block.column("_digest").to_pylist(), _height(n)).items()))
            trees.append(block.column("_tree")[0].as_py())
            blocks.append(block.column("_block")[0].as_py())
            counts.append(-(-n >> BLOCK))
            digests.append(value)
            if len(trees) == 10_000:
                yield batch(trees, blocks, counts, digests)
                trees, blocks, counts, digests = [], [], [], []
        yield batch(trees, blocks, counts, digests)

    def batch(trees, blocks, counts, digests) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(blocks, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["_tree", "_i", "_n", "_digest"])

    rows = nodes.select("_tree", F.shiftright("_i", BLOCK).alias("_block"), F.lit(1).alias("_kind"), "_i", "_n", "_digest")
    return _dealt(rows).mapInArrow(run, "_tree string, _i long, _n long, _digest string")


def _lower(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """One round down: ``nodes`` with _path and _root, from the nodes above them (_tree, _i, _path, _root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_blocks(batches):
            top = [(s["left"], s["right"]) for s in block.column("_path")[0].as_py()]
            root, own = block.column("_root")[0].as_py(), block.slice(1)
            paths = descend(ascend(own.column("_digest").to_pylist(), _height(own.column("_n")[0].as_py())), top)
            arrays = [own.column(c) for c in own.schema.names if c not in ("_block", "_kind", "_path", "_root")]
            path = pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _PATH)
            yield pa.RecordBatch.from_arrays([*arrays, path, pa.array([root] * len(paths), pa.string())], names)

    kept = [c for c in nodes.columns if c not in ("_tree", "_i", "_n", "_digest", "_row")]
    names = ["_tree", "_i", "_n", "_digest", *kept, "_path", "_root"]
    own = nodes.select("_tree", F.shiftright("_i", BLOCK).alias("_block"), F.lit(1).alias("_kind"), "_i", "_n", "_digest", *kept)
    over = above.select("_tree", F.col("_i").alias("_block"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_i"), "_path", "_root")
    schema = T.StructType([*(nodes.schema[c] for c in names[:-2]), *T.StructType.fromDDL(f"_path {STEP}, _root string")])
    return _dealt(own.unionByName(over, allowMissingColumns=True)).mapInArrow(run, schema)


def _rounds(nodes: DataFrame, most: int, what: str) -> list[DataFrame]:
    """The nodes of each round, up to the one that has a single node a tree."""
    rounds = [nodes]
    while most > 1:
        rounds.append(stored(_climb(rounds[-1]), f"{what}-{len(rounds)}"))
        most = -(-most >> BLOCK)
    return rounds


def _descent(rounds: list[DataFrame], above: DataFrame, what: str) -> DataFrame:
    for k, nodes in reversed(list(enumerate(rounds[:-1]))):
        above = _lower(nodes, above)
        if k:
            above = stored(above.select("_tree", "_i", "_path", "_root"), f"{what}-{k}-paths")
    if len(rounds) == 1:  # every tree has a single node
        above = rounds[0].join(above.select("_tree", "_path", "_root"), "_tree")
    return above


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source", keep: dict[str, Column] | None = None) -> DataFrame:
    """For each row its id, ``leaf``, ``subroot`` (the group's), ``root`` (the table's), ``path`` and the columns of ``keep``.

    path: the proof, a step (left, right) for each level from the leaf to the root: the siblings' digests as hex, put together; ``folded``
    gives the root from it.  Leaves of a group ascend by id (null first), rows with one id by their digests; equal rows have leaves of
    their own, next to each other.  A null group is a group before all others, which are ordered by their UTF-8 bytes.  Empty and very
    long texts are values like others, a null is not an empty text.  Other columns of ``df`` are not looked at and may have any name.  An
    empty table gives an empty result.  Proofs grow with the logarithm of the rows.
    """
    keep = keep or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    named = {f"_keep_{k}": column for k, column in enumerate(keep.values())}
    leaves = df.select(
        tree.alias("_tree"), F.col(id_col).alias("_id"), leaf_digest(*[F.col(c) for c in columns]).alias("_digest"),
        *[c.alias(k) for k, c in named.items()], F.monotonically_increasing_id().alias("_row"),
    )
    nodes, most = numbered(stored(leaves, "merkle-leaves"), "_tree", ["_id", "_digest", "_row"], "merkle")
    rounds = _rounds(nodes, most, "merkle")

    tops = stored(rounds[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_id"), "_digest"), "merkle-subroots")
    top, groups = numbered(tops, "_tree", ["_id"], "merkle-top")
    top_rounds = _rounds(top, groups, "merkle-top")
    none = F.array().cast(STEP)
    start = top_rounds[-1].select("_tree", "_i", none.alias("_path"), F.col("_digest").alias("_root"))
    under = stored(_descent(top_rounds, start, "merkle-top").select(F.col("_id").alias("_tree"), F.lit(0).cast("long").alias("_i"), "_path", "_root", F.col("_digest").alias("_subroot")), "merkle-groups")

    # the proof's end is the same for all leaves of a group: subroot and root go along as one text
    over = under.select("_tree", "_i", "_path", F.concat("_subroot", "_root").alias("_root"))
    below = _descent(rounds, over, "merkle")
    return below.select(
        F.col("_id").alias(id_col), F.col("_digest").alias("leaf"), F.substring("_root", 1, 64).alias("subroot"), F.substring("_root", 65, 64).alias("root"),
        F.col("_path").alias("path"), *[F.col(k).alias(name) for k, name in zip(named, keep, strict=True)],
    )
