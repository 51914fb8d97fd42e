"""Cleaning bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barspark.functions import windows as x
from barspark.operators.ranges import ffill
from barspark.operators.stats import exact_quantiles, unpivot
from barspark.operators.scan import varying_scan

OHLCV = ("open", "high", "low", "close", "volume")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def finite(col: Column) -> Column:
    """The value, or null for NaN and infinities."""
    v = col.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def coerce_numeric(df: DataFrame, columns: tuple[str, ...] = OHLCV) -> DataFrame:
    """Unreadable numbers become null, and rows with a null among the columns go."""
    return df.withColumns({k: F.col(k).try_cast("double") for k in columns}).dropna(subset=list(columns))


def trim_from(df: DataFrame, start, order: str = "time") -> DataFrame:
    return df.filter(F.col(order) >= F.lit(start))


def common_start(df: DataFrame, floor, key: str = "tf", order: str = "time") -> DataFrame:
    """Rows from the latest of the timeframes' first times on, and not before the floor; one row is broadcast."""
    firsts = df.groupBy(key).agg(F.min(order).alias("__first")).agg(F.greatest(F.max("__first"), F.lit(floor).cast("timestamp_ntz")).alias("__start"))
    return df.join(F.broadcast(firsts), F.col(order) >= F.col("__start")).drop("__start")


def flag_outliers(df: DataFrame, column: str = "close", k: float = 3.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Adds ``bad``: null, zero, or further than k standard deviations from the series' mean."""
    stats = df.groupBy(*keys).agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    v = F.col(column)
    bad = v.isNull() | (v == 0) | F.coalesce(F.abs(v - F.col("__m")) > k * F.col("__s"), F.lit(False))
    return df.join(stats, list(keys)).withColumn("bad", bad).drop("__m", "__s")


def repair_outliers(df: DataFrame, column: str = "close", k: float = 3.0, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Bad values become the mean of the repaired value before and the raw value after; at the ends, the one neighbour there is.

    A missing value after leaves the repair null until the next good row.
    """
    w = x.series(*keys, order=order)
    df = flag_outliers(df, column, k, keys)
    after, first = F.lead(column).over(w), F.row_number().over(w) == 1
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())) == 1
    df = df.withColumns({"__next": after, "__first": first, "__last": last})
    bad = F.col("bad")
    df = df.withColumns(
        {
            "__a": F.when(bad & ~F.col("__first"), F.when(F.col("__last"), 1.0).otherwise(0.5)).otherwise(0.0),
            "__b": F.when(~bad, F.col(column).cast("double"))
            .when(F.col("__first"), F.coalesce(F.col("__next").cast("double"), F.lit(float("nan"))))
            .when(F.col("__last"), 0.0)
            .otherwise(F.coalesce(F.col("__next") / 2, F.lit(float("nan")))),
        }
    )
    out = varying_scan(df, f"{column}_fixed", "__a", "__b", keys, order)
    return out.drop("__a", "__b", "__next", "__first", "__last")


def basic_clean(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """No infinities, no repeated rows; nulls become the mean of a number and the commonest string (the first of equals)."""
    numbers = [k for k in numeric_columns(df) if k not in keys]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    df = df.withColumns({k: finite(F.col(k)) for k in numbers}).dropDuplicates()
    fill = df.agg(*[F.avg(k).alias(f"__{k}") for k in numbers], *[F.mode(k, True).alias(f"__{k}") for k in texts])
    return df.join(F.broadcast(fill)).withColumns({k: F.coalesce(k, f"__{k}") for k in [*numbers, *texts]}).drop(*fill.columns)


def finite_ffill(df: DataFrame, columns: list[str], backward: bool = False, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Infinities become null, nulls the last value before (and then the first after, if ``backward``); rows without any value go."""
    df = ffill(df.withColumns({k: finite(F.col(k)) for k in columns}), columns, keys, order)
    if backward:
        df = ffill(df, columns, keys, order, backward=True)
    return df.dropna("all", subset=columns)


def intervals_to_seconds(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
    micros = lambda k: F.unix_micros(F.col(k).cast("timestamp"))
    return df.withColumn(name, (micros(end) - micros(start)) / 1e6)


def drop_weekends(df: DataFrame, order: str = "time") -> DataFrame:
    return df.filter(F.weekday(order) < 5)


def is_weekend_now(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    return df.groupBy(*keys).agg((F.weekday(F.max(order)) >= 5).alias("weekend"))


def dedup_last(df: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """One row per key: the last by the given columns."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(k).desc() for k in order]))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def signed_log1p(df: DataFrame, pattern: str = "(?i)volume") -> DataFrame:
    import re

    return df.withColumns({k: F.signum(k) * F.log1p(F.abs(k)) for k in numeric_columns(df) if re.search(pattern, k)})


def add_calendar(df: DataFrame, lag: int = 1, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Hour, day of week (Monday is 0) and weekend flag of the row ``lag`` rows before."""
    at = F.lag(order, lag).over(x.series(*keys, order=order)) if lag else F.col(order)
    df = df.withColumn("__t", at)
    return df.withColumns({"hour": F.hour("__t"), "day_of_week": F.weekday("__t"), "is_weekend": F.when(F.weekday("__t") >= 5, 1).when(F.col("__t").isNotNull(), 0)}).drop("__t")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: distinct values, largest absolute value, whether it is all 0 or 1."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in columns])).alias("p")).select("p.*")
    v = F.col("value")
    return long.groupBy("feature").agg(
        F.countDistinct(v).alias("n_distinct"), F.max(F.abs(v)).alias("max_abs"), F.coalesce(F.min(F.when(v.isNotNull(), v.isin(0.0, 1.0))), F.lit(True)).alias("is_binary")
    )


def drop_constant(df: DataFrame, columns: list[str], near_zero: float | None = None) -> DataFrame:
    """Without columns of one value at most; with ``near_zero``, without those that never exceed it and are not binary."""
    rule = F.col("n_distinct") <= 1 if near_zero is None else (F.col("max_abs") <= near_zero) & ~F.col("is_binary")
    return df.drop(*[r["feature"] for r in column_profile(df, columns).filter(rule).collect()])


def zeros_to_ffill(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    return ffill(df.withColumns({k: F.nullif(F.col(k), F.lit(0.0)) for k in columns}), columns, keys, order)


def impute(df: DataFrame, columns: list[str], strategy: str = "median") -> DataFrame:
    """median, mean, zero, or drop the rows."""
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "zero":
        return df.fillna(0.0, columns)
    if strategy == "median":
        middle = exact_quantiles(unpivot(df, [], columns), [0.5])
        fill = middle.agg(*[F.max(F.when(F.col("feature") == k, F.col("q0"))).alias(f"__{k}") for k in columns])
    else:
        fill = df.agg(*[F.avg(k).alias(f"__{k}") for k in columns])
    return df.join(F.broadcast(fill)).withColumns({k: F.coalesce(F.col(k).cast("double"), F.col(f"__{k}")) for k in columns}).drop(*fill.columns)


def conform(df: DataFrame, columns: list[str], fill: dict[str, float] | None = None, keys: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """Just these columns in this order: missing ones and nulls take their fill, or 0."""
    fill = fill or {}
    return df.select(*[k for k in keys if k in df.columns], *[F.coalesce(F.col(k).cast("double") if k in df.columns else F.lit(None).cast("double"), F.lit(float(fill.get(k, 0.0)))).alias(k) for k in columns])


def drop_warmup(df: DataFrame, n: int = 151, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    return df.withColumn("__r", F.row_number().over(x.series(*keys, order=order))).filter(F.col("__r") > n).drop("__r")


def diff_features(df: DataFrame, columns: list[str], lag: int = 1, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The change of each column between the last two rows that were known ``lag`` rows ago."""
    w = x.series(*keys, order=order)
    return df.withColumns({k: F.lag(k, lag).over(w) - F.lag(k, lag + 1).over(w) for k in columns})
