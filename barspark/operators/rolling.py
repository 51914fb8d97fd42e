"""Rolling quantiles of wide frames: a counting tree over ranks, chunk by chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.ranges import same
from barspark.operators.scan import number_rows, with_halo
from barspark.storage import stored


class RankCounts:
    """How often each rank is there, with the k-th smallest in logarithmic time: a binary indexed tree."""

    def __init__(self, ranks: int):
        self.tree, self.size, self.top = [0] * (ranks + 1), 0, 1 << max(ranks, 1).bit_length() - 1

    def add(self, rank: int, by: int = 1) -> None:
        self.size += by
        at, tree = rank + 1, self.tree
        while at < len(tree):
            tree[at] += by
            at += at & -at

    def kth(self, k: int) -> int:
        """The rank of the k-th smallest, from 0."""
        at, step, tree = 0, self.top, self.tree
        while step:
            if at + step < len(tree) and tree[at + step] <= k:
                at += step
                k -= tree[at]
            step >>= 1
        return at

    def quantile(self, values: np.ndarray, p: float) -> float:
        place = (self.size - 1) * p
        low = int(place)
        a, b = values[self.kth(low)], values[self.kth(min(low + 1, self.size - 1))]
        return a + (b - a) * (place - low)


def frame_quantiles(x: np.ndarray, ps: list[float], n: int, least: int, before: bool) -> np.ndarray:
    """For each row the quantiles of the n rows up to it, or ``before`` it, null ones left out; NaN where fewer than ``least`` are there."""
    there = ~np.isnan(x)
    values, rank = np.unique(x[there], return_inverse=True)
    ranks = np.full(len(x), -1)
    ranks[there] = rank
    ranks, counts, out = ranks.tolist(), RankCounts(len(values)), np.full((len(x), len(ps)), np.nan)
    for i in range(len(x)):
        new, old = (i - 1, i - 1 - n) if before else (i, i - n)
        if new >= 0 and ranks[new] >= 0:
            counts.add(ranks[new])
        if old >= 0 and ranks[old] >= 0:
            counts.add(ranks[old], -1)
        if counts.size >= max(least, 1):
            out[i] = [counts.quantile(values, p) for p in ps]
    return out


def rolling_quantiles(df: DataFrame, column: str, quantiles: dict[str, float], n: int, least: int | None = None, before: bool = False, keys: tuple[str, ...] = ("symbol",), order: str = "time", chunk: int = 4096) -> DataFrame:
    """Adds ``name: p``, exact linear quantiles of the column's last n rows (``before``: of the n rows before the row), null below ``least`` values.

    A chunk's values are ranked once, and each row moves two ranks in a tree of counts, so a row costs the logarithm of the chunk and not a
    sort of its frame.  Chunks are led by the n rows before them: no task holds a series.  Nulls and NaN count as missing.
    """
    kinds, least = dict(df.dtypes), n if least is None else least
    names = list(quantiles)
    rows = stored(number_rows(df, keys, order, "__row"), "quantiles")
    cut = with_halo(rows.select(*keys, "__row", F.col(column).cast("double").alias("__x")), n, chunk, keys, order, row="__row")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__row")
        part[names] = frame_quantiles(part["__x"].to_numpy(float), list(quantiles.values()), n, least, before)
        return part.loc[~part["halo"], [*keys, "__row", *names]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__row long", *(f"`{k}` double" for k in names)])
    found = cut.groupBy(*keys, "chunk").applyInPandas(run, schema)
    # pandas has NaN for null
    found = found.withColumns({k: F.nanvl(k, F.lit(None).cast("double")) for k in names})
    return same(rows, found, [*keys, "__row"]).drop("__row")
