"""Running values over series of any length: a prefix scan over ranges of rows for any monoid.

Rows are dealt by ranges of (series, time), so that a long series lies in many ranges and no task holds it.  A range's total is one row; an
ordered fold over the totals of a series, one for each range, says what comes before a range, and is handed back to its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.storage import stored


@dataclass(frozen=True)
class Monoid:
    """running: the aggregate over an ordered window; total: over a range's rows, given the column and their order; join: of an earlier and a later value.

    Null is the neutral value.
    """

    running: Callable[[Column], Column]
    total: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]


def _either(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(op(a, b))


def _simple(aggregate: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Monoid:
    return Monoid(aggregate, lambda x, order: aggregate(x), join)


MONOIDS = {
    "sum": _simple(F.sum, _either(lambda a, b: a + b)),
    "count": _simple(F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": _simple(F.max, F.greatest),
    "min": _simple(F.min, F.least),
    "product": _simple(F.product, _either(lambda a, b: a * b)),
    "last": Monoid(lambda x: F.last(x, ignorenulls=True), lambda x, order: F.max_by(x, F.when(x.isNotNull(), order)), lambda a, b: F.coalesce(b, a)),
}


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on the keys, null ones being equal, and keeps them once."""
    other = b.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = [a[k].eqNullSafe(other[f"__k_{k}"]) for k in keys]
    return a.join(other, on, how).drop(*[f"__k_{k}" for k in keys])


def dealt(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], what: str = "ranges", ranges: int | None = None) -> DataFrame:
    """The stored rows with their range, ``__range``; rows with the same keys and order share one."""
    by = [*keys, *order]
    parted = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return stored(parted.withColumn("__range", F.spark_partition_id()), what)


def prefix_scan(df: DataFrame, scans: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("symbol",), order: str | tuple[str, ...] = "time", backward: bool = False, ranges: int | None = None) -> DataFrame:
    """Adds ``name: (column, kind)``, the running sum, count, max, min, product or last value that is not null, up to and with each row.

    ``backward`` runs from the end of a series.  A result is null as long as there was no value; rows in the same place of a series come
    in any order.  A name may be that of its own column.  ``ranges``: their number, by default as many as the data's size asks for.
    """
    order = (order,) if isinstance(order, str) else order
    rows, by = dealt(df, keys, order, ranges=ranges), [*keys, "__range"]
    place = F.struct(*order)
    total = {n: MONOIDS[kind].total(F.col(x), place) for n, (x, kind) in scans.items()}
    if backward:
        total |= {n: F.min_by(x, F.when(F.col(x).isNotNull(), place)) for n, (x, kind) in scans.items() if kind == "last"}
    way = (lambda k: F.col(k).desc()) if backward else F.col
    before = Window.partitionBy(*keys).orderBy(way("__range")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*by).orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*by).agg(*[t.alias(f"__t_{n}") for n, t in total.items()])
    # the fold of totals: sums of counts, and else the same operation
    fold = {n: F.sum if kind == "count" else MONOIDS[kind].running for n, (_, kind) in scans.items()}
    carried = totals.select(*by, *[fold[n](F.col(f"__t_{n}")).over(before).alias(f"__c_{n}") for n in scans])
    out = rows.withColumns({f"__u_{n}": MONOIDS[kind].running(F.col(x)).over(own) for n, (x, kind) in scans.items()})
    out = same(out, carried, by).withColumns({n: MONOIDS[kind].join(F.col(f"__c_{n}"), F.col(f"__u_{n}")) for n, (_, kind) in scans.items()})
    return out.drop("__range", *[f"__{k}_{n}" for n in scans for k in "uc"])


#: Columns up to which gaps are filled by a prefix scan; of more, its plan would cost more than the rows of most tables.
WIDE = 16


def ffill(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), order: str = "time", backward: bool = False) -> DataFrame:
    """Nulls become the last value before in the series (``backward``: the first after).

    Of up to ``WIDE`` columns by a prefix scan over ranges; more columns take one window a series, which streams through its rows.
    """
    if len(columns) <= WIDE:
        return prefix_scan(df, {k: (k, "last") for k in columns}, keys, order, backward)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if backward else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.last(k, ignorenulls=True).over(w) for k in columns})
