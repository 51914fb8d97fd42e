"""Named features and how they are added to bars, one level of dependencies at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barspark.functions import windows as x
from barspark.operators.ranges import prefix_scan
from barspark.operators.scan import ema, number_rows, with_halo


@dataclass(frozen=True)
class Feature:
    """A column made of the columns that it needs.  ``make`` gets the window of the series; ``alpha`` and ``source`` make it an exponential mean.

    ``kind`` makes it a running value of ``source`` (sum, max, min, count, last); ``reach`` overrides what :meth:`looks` finds.
    """

    name: str
    needs: tuple[str, ...]
    make: Callable[[WindowSpec], Column] | None = None
    source: str = ""
    alpha: float = 0.0
    kind: str = ""
    reach: tuple[int, int] | None = None

    @property
    def scanned(self) -> bool:
        return bool(self.alpha or self.kind)

    def looks(self) -> tuple[int, int]:
        """Rows before and after its own that the feature needs of its inputs: the largest of its window primitives'."""
        if self.reach is not None:
            return self.reach
        with x.noting() as seen:
            self.make(x.series())
        back, ahead = (max(s[k] for s in seen) for k in (0, 1))
        if float("inf") in (back, ahead):
            raise ValueError(f"{self.name} looks at a whole series: make its running part a feature of its own with Registry.running")
        return back, ahead

    def over(self, w: WindowSpec) -> Column:
        return RUNNING[self.kind](F.col(self.source), w) if self.kind else self.make(w)


#: Running values as expressions over a series' window.
RUNNING = {
    "sum": x.cumsum,
    "max": x.cummax,
    "last": x.ffill,
    "min": lambda v, w: F.min(v).over(x.running(w)),
    "count": lambda v, w: F.count(v).over(x.running(w)),
}


class Registry:
    def __init__(self):
        self.features: dict[str, Feature] = {}

    def add(self, name: str, needs: str, make: Callable[[WindowSpec], Column], reach: tuple[int, int] | None = None) -> str:
        """Of features with the same name, the one added last holds."""
        self.features[name] = Feature(name, tuple(needs.split()), make, reach=reach)
        return name

    def running(self, name: str, source: str, kind: str) -> str:
        self.features[name] = Feature(name, (source,), source=source, kind=kind)
        return name

    def mean(self, name: str, source: str, alpha: float) -> str:
        self.features[name] = Feature(name, (source,), None, source, alpha)
        return name

    def levels(self, names: Iterable[str], have: Iterable[str]) -> list[list[Feature]]:
        """The features to add, each after what it needs."""
        level: dict[str, int] = {c: 0 for c in have}

        def place(name: str, path: tuple[str, ...] = ()) -> int:
            if name not in level:
                if name in path or name not in self.features:
                    raise KeyError(f"no column or feature {name}")
                level[name] = 1 + max((place(n, (*path, name)) for n in self.features[name].needs), default=0)
            return level[name]

        for n in names:
            place(n)
        out: list[list[Feature]] = [[] for _ in range(max(level.values(), default=0))]
        for n, k in level.items():
            if k:
                out[k - 1].append(self.features[n])
        return [x for x in out if x]

    def build(self, df: DataFrame, names: Iterable[str], keys: tuple[str, ...] = ("symbol",), order: str = "time", keep_inputs: bool = True, chunk: int | None = None) -> DataFrame:
        """Adds the features; a level's windows share one sort, and its exponential means one pass.  What only other features need is dropped.

        With ``chunk``, series are cut into chunks of so many rows, see :meth:`in_chunks`.
        """
        names, have, w = list(names), df.columns, x.series(*keys, order=order)
        levels = self.levels(names, have)
        kept = [*(have if keep_inputs else [*keys, order]), *[n for n in names if not keep_inputs or n not in have]]
        if chunk:
            return self.in_chunks(df, levels, chunk, keys, order).select(*kept)
        if any(f.alpha for level in levels for f in level):
            df = number_rows(df, keys, order, "__row")
        for level in levels:
            plain = {f.name: f.over(w) for f in level if not f.alpha}
            if plain:
                df = df.withColumns(plain)
            means = {f.name: (f.source, f.alpha) for f in level if f.alpha}
            if means:
                df = ema(df, means, keys, order)
        return df.select(*kept)

    def in_chunks(self, df: DataFrame, levels: list[list[Feature]], chunk: int, keys: tuple[str, ...], order: str) -> DataFrame:
        """The features of series of any length: no window and no task goes over a series.

        Exponential means and running values are scans over chunks and ranges.  Between scans, the windows of all levels run in one pass over
        chunks of rows, each between the rows before and after that its features look at, all levels together.
        """
        stage: dict[str, int] = {}
        for f in (f for level in levels for f in level):
            stage[f.name] = max([stage[n] + f.scanned for n in f.needs if n in stage], default=0)
        df = number_rows(df, keys, order, "__row")
        w = Window.partitionBy(*keys, "__chunk").orderBy(order)
        for s in range(max(stage.values(), default=-1) + 1):
            own = [[f for f in level if stage[f.name] == s] for level in levels]
            scans = [f for level in own for f in level if f.scanned]
            if means := {f.name: (f.source, f.alpha) for f in scans if f.alpha}:
                df = ema(df, means, keys, order)
            if runs := {f.name: (f.source, f.kind) for f in scans if f.kind}:
                df = prefix_scan(df, runs, keys, order)
            far: dict[str, tuple[int, int]] = {}
            for f in (f for level in own for f in level if not f.scanned):
                inner = [far[n] for n in f.needs if n in far]
                far[f.name] = tuple(a + max([i[k] for i in inner], default=0) for k, a in enumerate(f.looks()))
            if not far:
                continue
            back, ahead = (max(v[k] for v in far.values()) for k in (0, 1))
            df = with_halo(df, back, chunk, keys, order, ahead, "__row").withColumnsRenamed({"chunk": "__chunk", "halo": "__halo"})
            for level in own:
                df = df.withColumns({f.name: f.make(w) for f in level if not f.scanned})
            df = df.filter("NOT __halo").drop("__chunk", "__halo")
        return df


#: Indicators that users of the library have added.
USER = Registry()


def register_indicator(name: str, needs: str, make: Callable[[WindowSpec], Column], reach: tuple[int, int] | None = None) -> None:
    """Makes a user's own indicator available to :func:`barspark.functions.indicators.add_indicators`.

    reach: how many rows before and after its own it looks at; not needed if it is made of the primitives in :mod:`barspark.functions.windows`.
    """
    USER.add(name, needs, make, reach)
