"""Window primitives (E1-E19, E21): expressions over one ordered series.

``w`` is a window partitioned by the series and ordered by time.  A result is null until the frame holds ``least`` values that are not null.
Arguments are plain columns: an expression over a window cannot stand inside another, so callers add such columns level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series(*keys: str, order: str = "time") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


#: Where the rows that an expression looks at are noted: (before, after) its own row.
_noted: ContextVar[list[tuple[float, float]] | None] = ContextVar("noted", default=None)


def note(back: float = 0, ahead: float = 0) -> None:
    if (seen := _noted.get()) is not None:
        seen.append((back, ahead))


@contextmanager
def noting() -> Iterator[list[tuple[float, float]]]:
    """Collects how far the window primitives that are called meanwhile look back and ahead."""
    token = _noted.set(seen := [(0, 0)])
    try:
        yield seen
    finally:
        _noted.reset(token)


def frame(w: WindowSpec, n: int) -> WindowSpec:
    note(n - 1)
    return w.rowsBetween(1 - n, 0)


def running(w: WindowSpec) -> WindowSpec:
    note(float("inf"))
    return w.rowsBetween(Window.unboundedPreceding, 0)


def row_number(w: WindowSpec) -> Column:
    note(float("inf"))
    return F.row_number().over(w)


def shift(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """The value k rows before; after, if k is below 0."""
    note(max(k, 0), max(-k, 0))
    return F.lag(x, k).over(w)


def diff(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return x - shift(x, w, k)


def pct_change(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return F.try_divide(x, shift(x, w, k)) - 1


def ratio(a: Column, b: Column) -> Column:
    """Quotient of doubles as floating point has it: by zero infinite, and of two zeros not a number."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """Logarithm as floating point has it: of zero minus infinity, and below it not a number."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def log_return(x: Column, w: WindowSpec) -> Column:
    return F.ln(x) - F.ln(shift(x, w))


def over_frame(aggregate: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    own = frame(w, n)
    return F.when(F.count(x).over(own) >= (n if least is None else least), aggregate(x).over(own))


def rolling_sum(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return over_frame(F.sum, x, n, w, least)


def rolling_mean(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return over_frame(F.avg, x, n, w, least)


def rolling_min(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return over_frame(F.min, x, n, w, least)


def rolling_max(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return over_frame(F.max, x, n, w, least)


def rolling_std(x: Column, n: int, w: WindowSpec, least: int | None = None, ddof: int = 1) -> Column:
    return over_frame(F.stddev_samp if ddof else F.stddev_pop, x, n, w, least)


def _moment(aggregate: Callable[[Column], Column], x: Column, n: int, w: WindowSpec, least: int | None) -> Column:
    """0 where the frame is constant; without the test, rounding there would decide."""
    own = frame(w, n)
    value = F.when(F.min(x).over(own) == F.max(x).over(own), 0.0).otherwise(F.nanvl(aggregate(x).over(own), F.lit(0.0)))
    return F.when(F.count(x).over(own) >= (n if least is None else least), value)


def rolling_skew(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Population skewness."""
    return _moment(F.skewness, x, n, w, least)


def rolling_kurt(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Population excess kurtosis."""
    return _moment(F.kurtosis, x, n, w, least)


def quantile_of(values: Column, p: float) -> Column:
    """Linear quantile of a sorted array that is not empty."""
    place = (F.size(values) - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def rolling_quantile(x: Column, p: float, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Exact: the frame is bounded, so its values may be sorted as an array."""
    own = frame(w, n)
    return F.when(F.count(x).over(own) >= (n if least is None else least), quantile_of(F.array_sort(F.collect_list(x).over(own)), p))


def rolling_median(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return rolling_quantile(x, 0.5, n, w, least)


def rolling_apply(x: Column, n: int, fn: Callable[[Column], Column], w: WindowSpec, least: int | None = None) -> Column:
    """Any function of the frame's values, an array in the window's order without nulls: higher-order functions, or a pandas UDF over arrays."""
    own = frame(w, n)
    return F.when(F.count(x).over(own) >= (n if least is None else least), fn(F.collect_list(x).over(own)))


def rolling_up_count(rise: Column, n: int, w: WindowSpec) -> Column:
    """Rises inside the frame: n - 1 steps.  rise: 1 where a row is above the one before, a column of its own."""
    return F.when(F.count(F.lit(1)).over(frame(w, n)) >= n, F.sum(rise).over(w.rowsBetween(2 - n, 0)))


def bars_since_max(x: Column, row: Column, n: int, w: WindowSpec) -> Column:
    """Rows since the first highest value of the frame; row: the row number."""
    own = frame(w, n)
    return F.when(F.count(x).over(own) >= n, row - F.min_by(row, F.struct(-x, row)).over(own))


def bars_since_min(x: Column, row: Column, n: int, w: WindowSpec) -> Column:
    own = frame(w, n)
    return F.when(F.count(x).over(own) >= n, row - F.min_by(row, F.struct(x, row)).over(own))


def rolling_slope(x: Column, row: Column, n: int, w: WindowSpec, least: int = 2) -> Column:
    """Least-squares slope against the row number."""
    own = frame(w, n)
    at = F.when(x.isNotNull(), row.cast("double"))
    return F.when(F.count(x).over(own) >= least, F.try_divide(F.covar_pop(x, at).over(own), F.var_pop(at).over(own)))


def rolling_corr(x: Column, y: Column, n: int, w: WindowSpec, least: int = 2) -> Column:
    """Pearson's correlation of the rows that have both; null where one is constant."""
    own = frame(w, n)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    flat = (F.min(a).over(own) == F.max(a).over(own)) | (F.min(b).over(own) == F.max(b).over(own))
    value = F.try_divide(F.covar_pop(a, b).over(own), F.stddev_pop(a).over(own) * F.stddev_pop(b).over(own))
    return F.when((F.count(a).over(own) >= least) & ~flat, value)


def zscore(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return (x - rolling_mean(x, n, w, least)) / (rolling_std(x, n, w, least, 0) + 1e-12)


def pos_in_channel(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    low, high = rolling_min(x, n, w, least), rolling_max(x, n, w, least)
    return (x - low) / (F.nullif(high - low, F.lit(0.0)) + 1e-12)


def wma(x: Column, row: Column, n: int, w: WindowSpec) -> Column:
    """Weights 1 to n, the newest the most."""
    own = frame(w, n)
    first = F.min(row).over(own)
    return F.when(F.count(x).over(own) >= n, (F.sum(x * row).over(own) - (first - 1) * F.sum(x).over(own)) / (n * (n + 1) / 2))


def fir_mean(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean over n with zeros before the start."""
    return F.sum(x).over(frame(w, n)) / n


def cumsum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(running(w))


def cummax(x: Column, w: WindowSpec) -> Column:
    return F.max(x).over(running(w))


def cumprod(x: Column, w: WindowSpec) -> Column:
    """Product of factors above zero; from the first other one on, null."""
    bad = F.max(F.when(x <= 0, 1).otherwise(0)).over(running(w))
    return F.when(bad == 0, F.exp(F.sum(F.ln(F.when(x > 0, x))).over(running(w))))


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(running(w))


def bfill(x: Column, w: WindowSpec) -> Column:
    note(0, float("inf"))
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def moving_average_bank(df: DataFrame, columns: dict[str, str], sizes: range, keys: tuple[str, ...] = ("symbol",), order: str = "time", chunk: int = 4096) -> DataFrame:
    """A mean of every size for each column, from differences of running sums instead of a frame each.

    A running sum begins anew in each chunk of a series, with the rows that its means look back on, so no task holds a series and sums don't
    grow until digits are lost.  columns: column -> prefix of its means.  Columns must not be null.
    """
    from barspark.operators.scan import with_halo

    df, have = with_halo(df, max(sizes), chunk, keys, order, row="__row"), df.columns
    w = Window.partitionBy(*keys, "chunk").orderBy(order)
    df = df.withColumns({f"__s_{c}": F.sum(c).over(running(w)) for c in columns})
    df = df.withColumns({f"__b_{c}": F.collect_list(f"__s_{c}").over(frame(w, max(sizes) + 1)) for c in columns})
    # as SQL: hundreds of expressions are built in one call
    before = "coalesce(get(`__b_{c}`, size(`__b_{c}`) - 1 - {n}), 0.0D)"
    means = [f"CASE WHEN __row >= {n} THEN (`__s_{c}` - {before.format(c=c, n=n)}) / {n} END AS `{prefix}{n}`" for c, prefix in columns.items() for n in sizes]
    return df.filter("NOT halo").selectExpr(*[f"`{k}`" for k in have], *means)
