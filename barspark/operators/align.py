"""Resampling and aligning timeframes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.functions import windows as x
from barspark.operators.clean import dedup_last, drop_weekends
from barspark.operators.ranges import ffill, prefix_scan
from barspark.sources.bars import duration, tail_n

BARS = {"open": F.min_by, "close": F.max_by}


def _bucket(order: str, every: str):
    return F.window(order, every)["start"]


def resample(df: DataFrame, every: str, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Coarser bars: first, highest, lowest, last and summed volume."""
    at = F.col(order)
    return (
        df.groupBy(*keys, F.window(order, every).alias("__w"))
        .agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"))
        .select(*keys, F.col("__w.start").alias(order), "open", "high", "low", "close", "volume")
    )


def safe_resample(df: DataFrame, every: str, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Coarser bars from closed rows only.

    The bucket's last row goes.  Of those kept, open is the first; the others look at all kept rows but the last: close and extra columns
    their last, volume their sum, high and low their extremes.  A bucket of one row passes as it is; of two, close is null and the volume 0.
    """
    bucket = df.withColumn("__w", _bucket(order, every))
    up = Window.partitionBy(*keys, "__w").orderBy(order)
    bucket = bucket.withColumns({"__r": F.row_number().over(up), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys, "__w"))})
    alone = F.col("__n") == 1
    closed = alone | (F.col("__r") <= F.col("__n") - 2)
    at = F.when(closed, F.col(order))
    last = lambda k: F.max_by(F.when(closed, F.col(k)), at).alias(k)
    return (
        bucket.groupBy(*keys, "__w")
        .agg(
            F.min_by("open", order).alias("open"),
            F.max(F.when(closed, F.col("high"))).alias("high"),
            F.min(F.when(closed, F.col("low"))).alias("low"),
            last("close"),
            F.coalesce(F.sum(F.when(closed, F.col("volume"))), F.lit(0.0)).alias("volume"),
            *[last(k) for k in extra],
        )
        .withColumnRenamed("__w", order)
    )


def merge_timeframes(main: DataFrame, others: dict[str, DataFrame], main_tf: str = "30T", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Full outer join on series and time, columns prefixed by timeframe; each timeframe's columns filled forward, no weekends, one row a time."""
    out = _prefixed(main, main_tf, keys, order)
    for tf, df in others.items():
        out = out.join(_prefixed(df, tf, keys, order), [*keys, order], "full_outer")
    values = [k for k in out.columns if k not in (*keys, order)]
    return drop_weekends(ffill(out, values, keys, order), order)


def _prefixed(df: DataFrame, tf: str, keys: tuple[str, ...], order: str) -> DataFrame:
    rows = dedup_last(df, (*keys, order), *[k for k in df.columns if k not in (*keys, order)][:1])
    return rows.select(*keys, order, F.col(order).alias(f"{tf}_{order}"), *[F.col(k).alias(f"{tf}_{k}") for k in df.columns if k not in (*keys, order)])


def join_exact(frames: dict[str, DataFrame], keys: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """Inner join of any number of feeds on the keys; their other columns get the feed's name as suffix."""
    out = None
    for name, df in frames.items():
        own = df.select(*keys, *[F.col(k).alias(f"{k}_{name}") for k in df.columns if k not in keys])
        out = own if out is None else out.join(own, list(keys))
    return out


def keep_common(a: DataFrame, b: DataFrame, n: int | None = None, keys: tuple[str, ...] = ("symbol", "time")) -> DataFrame:
    """Rows of a whose keys b has; the last n of each series."""
    rows = a.join(b.select(*keys).distinct(), list(keys), "left_semi")
    return rows if n is None else tail_n(rows, n, keys[:-1], keys[-1])


def asof_value(left: DataFrame, right: DataFrame, values: list[str], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """For each row of left, right's values at its time or else at the last time before: one union and one prefix scan, no range join.

    Both are dealt by ranges of time, so a long series is spread over tasks.
    """
    a = left.select(*keys, order, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("__left"))
    b = right.select(*keys, order, *values, F.lit(0).alias("__left"))
    both = a.unionByName(b).withColumn("__v", F.when(F.col("__left") == 0, F.struct(*values)))
    found = prefix_scan(both, {"__v": ("__v", "last")}, keys, (order, "__left")).filter("__left = 1")
    return found.select(*keys, order, *[F.col(f"__v.{v}").alias(v) for v in values])


def label_at(times: DataFrame, bars: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The next bar's rise, looked up by time; null where the time has no bar or no next one."""
    w = x.series(*keys, order=order)
    once = dedup_last(bars.select(*keys, order, "close"), (*keys, order), "close")
    after = F.lead("close").over(w)
    known = once.withColumn("__n", after).select(*keys, order, F.when(F.col("__n").isNotNull(), (F.col("__n") > F.col("close")).cast("int")).alias("y"))
    return times.join(known, [*keys, order], "left")


def latest_common_time(frames: dict[str, DataFrame], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The last time that all timeframes have, for each series."""
    all_times = None
    for tf, df in frames.items():
        own = df.select(*keys, order).distinct().withColumn("__tf", F.lit(tf))
        all_times = own if all_times is None else all_times.unionByName(own)
    shared = all_times.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(frames))
    return shared.groupBy(*keys).agg(F.max(order).alias(order))


def trim_to_common(frames: dict[str, DataFrame], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> dict[str, DataFrame]:
    last = latest_common_time(frames, keys, order).withColumnRenamed(order, "__last")
    return {tf: df.join(last, list(keys)).filter(F.col(order) <= F.col("__last")).drop("__last") for tf, df in frames.items()}


def bar_at(times: DataFrame, bars: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The bar of the timeframe that a time falls into; none if that bar is missing."""
    floored = times.withColumn("bar_time", _bucket(order, duration(tf)))
    return floored.join(bars.withColumnRenamed(order, "bar_time"), [*keys, "bar_time"])


def check_alignment(merged: DataFrame, main_tf: str, late_minutes: dict[str, int] | None = None, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Per series and timeframe: its last time in a merged frame, how late it is, and whether that is allowed (0 minutes unless given)."""
    late_minutes = late_minutes or {"1H": 30}
    tfs = [k[: -len(order) - 1] for k in merged.columns if k.endswith(f"_{order}")]
    last = merged.groupBy(*keys).agg(*[F.max(f"{tf}_{order}").alias(tf) for tf in tfs])
    rows = last.select(*keys, F.col(main_tf).alias("__m"), F.explode(F.array(*[F.struct(F.lit(tf).alias("tf"), F.col(tf).alias("last"), F.lit(late_minutes.get(tf, 0)).alias("allowed")) for tf in tfs])).alias("p"))
    late = F.abs(F.unix_micros(F.col("__m").cast("timestamp")) - F.unix_micros(F.col("p.last").cast("timestamp"))) / 6e7
    return rows.select(*keys, "p.tf", "p.last", late.alias("late_minutes"), (late <= F.col("p.allowed")).alias("aligned"))


def concat_history(history: DataFrame, new: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Saved rows and new ones, new ones instead of saved ones of the same time, the last n of each series."""
    both = history.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return tail_n(dedup_last(both, (*keys, order), "__new").drop("__new"), n, keys, order)
