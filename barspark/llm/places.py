"""Places of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.buckets import few
from barspark.llm.storage import stored


def runs(columns: list[pa.Array]) -> np.ndarray:
    """Where a run of equal rows of the columns starts."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(new) + 1)


def numbered(rows: DataFrame, group: str, order: list[str], what: str) -> tuple[DataFrame, int]:
    """``rows`` with their place ``_i`` in their group (a string, not null) by ``order``, from 0, and the group's number of rows ``_n``; the largest ``_n``.

    Rows are dealt by ranges of (group, order), so no task holds a group; a range's rows are counted as they stream by and stored, and the
    counts of the ranges before are added.  They are as many as ranges and groups together.  ``order`` should tell all rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group)
            starts = runs([groups])
            base = np.full(batch.num_rows, -(2**62))
            base[starts] = starts
            if groups[0].as_py() == last:
                base[0] = -seen
            at = np.arange(batch.num_rows) - np.maximum.accumulate(base)
            last, seen = groups[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(batch.num_rows, part))], [*batch.schema.names, "_at", "_part"])

    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("_at long, _part long")])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = stored(rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).mapInArrow(run, schema), f"{what}-places")
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("own").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = own.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("own"))
    counts = stored(counts.select(group, "_part", before.alias("_before"), F.sum("own").over(whole).alias("_n")), f"{what}-counts")
    most = counts.agg(F.max("_n")).first()[0] or 0
    placed = own.join(few(counts), [group, "_part"])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at")).alias("_i"), "_n"), most
