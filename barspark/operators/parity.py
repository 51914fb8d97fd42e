"""Parity of two feeds (L1-L13) and data guards (M1-M5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.operators.stats import unpivot
from barspark.sources.bars import tail_n

div = F.try_divide
KEYS = ("symbol", "time")


def is_close(a: Column, b: Column, rtol: float, atol: float, symmetric: bool = False) -> Column:
    """Two nulls are equal, one is not; ``symmetric`` measures against the larger of both, else against b."""
    reach = F.greatest(rtol * F.greatest(F.abs(a), F.abs(b)), F.lit(atol)) if symmetric else F.lit(atol) + rtol * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= reach)


def feature_diff_long(a: DataFrame, b: DataFrame, columns: list[str], rtol: float = 1e-5, atol: float = 1e-8, keys: tuple[str, ...] = KEYS, symmetric: bool = False) -> DataFrame:
    """One row per key and feature of both feeds: values, differences and whether they differ.  Joined wide, so that each row is shuffled once."""
    own = a.select(*keys, F.struct(*[F.col(k).cast("double").alias(k) for k in columns]).alias("__a"))
    other = b.select(*keys, F.struct(*[F.col(k).cast("double").alias(k) for k in columns]).alias("__b"))
    items = F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"__a.{k}").alias("a"), F.col(f"__b.{k}").alias("b")) for k in columns])
    rows = own.join(other, list(keys)).select(*keys, F.explode(items).alias("p")).select(*keys, "p.*")
    d = F.abs(F.col("a") - F.col("b"))
    return rows.withColumns({"abs_diff": d, "rel_diff": div(d, F.abs("b")), "is_diff": F.when(is_close(F.col("a"), F.col("b"), rtol, atol, symmetric), 0).otherwise(1)})


def feature_diff_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("tests"), F.sum("is_diff").alias("n_diff"), (F.sum("is_diff") / F.count(F.lit(1))).alias("ratio_diff"), F.max("abs_diff").alias("max_diff"), F.avg("abs_diff").alias("mean_abs_diff")
    )


def row_diff_list(long: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per row the names of the differing features, sorted, and their number; a list is no longer than the features."""
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("is_diff") == 1, F.col("feature")))).alias("features"), F.sum("is_diff").alias("n_diff"))


def tail_row_diff(a: DataFrame, b: DataFrame, columns: list[str], atol: float = 1e-4, rtol: float = 1e-2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last row of each series in both feeds, whatever its time."""
    last = lambda df: tail_n(df, 1, keys[:-1], keys[-1])
    out = feature_diff_long(last(a), last(b), columns, rtol, atol, keys[:-1])
    bad = lambda k: F.col(k).isNull() | F.isnan(k) | (F.abs(k) == float("inf"))
    return out.withColumn("not_finite", F.when(bad("a") | bad("b"), 1).otherwise(0))


def prediction_compare(a: DataFrame, b: DataFrame, p: str = "p", decision: str = "decision", y: str = "y", tol: float = 1e-6, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row: shares of equal probabilities and decisions, and each side's accuracy and coverage."""
    both = a.select(*keys, F.col(p).alias("pa"), F.col(decision).alias("da"), F.col(y).alias("y")).join(b.select(*keys, F.col(p).alias("pb"), F.col(decision).alias("db")), list(keys))
    acc = lambda d: 100 * div(F.count_if((F.col(d) == F.col("y")) & (F.col(d) != -1)), F.count_if((F.col(d) != -1) & F.col("y").isNotNull()))
    n = F.count(F.lit(1))
    return both.agg(
        n.alias("n"),
        (100 * div(F.count_if(F.abs(F.col("pa") - F.col("pb")) <= tol), n)).alias("same_p"),
        (100 * div(F.count_if(F.col("da") == F.col("db")), n)).alias("same_decision"),
        acc("da").alias("accuracy_a"), acc("db").alias("accuracy_b"),
        (100 * div(F.count_if(F.col("da") != -1), n)).alias("coverage_a"), (100 * div(F.count_if(F.col("db") != -1), n)).alias("coverage_b"),
    )


def diff_reason(long: DataFrame, short: float = 0.6, off: float = 0.2, spread: float = 0.2) -> DataFrame:
    """Why a feature differs: one side is mostly empty, both differ by a steady factor, or something else."""
    one_null = F.col("a").isNull() != F.col("b").isNull()
    ratio = F.when(F.abs("b") > 1e-12, F.col("a") / F.col("b"))
    out = long.filter("is_diff = 1").groupBy("feature").agg(F.avg(one_null.cast("double")).alias("null_share"), F.avg(ratio).alias("ratio_mean"), F.stddev_pop(ratio).alias("ratio_std"))
    steady = (F.abs(F.col("ratio_mean") - 1) > off) & (F.col("ratio_std") < spread)
    return out.withColumn("reason", F.when(F.col("null_share") > short, "insufficient_history").when(steady, "scale_mismatch").otherwise("other"))


def row_distance(long: DataFrame, k: int = 3, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per row the Euclidean and the largest distance, and the k features that differ most (first by name among equals)."""
    item = F.struct((-F.col("abs_diff")).alias("d"), F.col("feature").alias("f"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("abs_diff").isNotNull(), item))), 1, k), lambda s: s["f"])
    return long.groupBy(*keys).agg(F.sqrt(F.sum(F.col("abs_diff") * F.col("abs_diff"))).alias("l2"), F.max("abs_diff").alias("max_abs"), top.alias("top"))


def readiness_gate(predictions: DataFrame, long: DataFrame, least: float = 99.9, most_gap: float = 0.5) -> DataFrame:
    """READY if predictions and features agree and accuracies are near; predictions: the row of :func:`prediction_compare`."""
    features = long.agg((100 * (1 - F.avg("is_diff"))).alias("feature_parity"))
    gap = F.abs(F.coalesce("accuracy_a", F.lit(0.0)) - F.coalesce("accuracy_b", F.lit(0.0)))
    out = predictions.join(F.broadcast(features)).select("same_decision", "feature_parity", gap.alias("accuracy_gap"))
    return out.withColumn("verdict", F.when((F.col("same_decision") >= least) & (F.col("feature_parity") >= least) & (F.col("accuracy_gap") <= most_gap), "READY").otherwise("NOT_READY"))


def prefix_invariance(df: DataFrame, function: Callable[[DataFrame, tuple[str, ...]], DataFrame], cutoffs: list, columns: list[str], keys: tuple[str, ...] = ("symbol",), order: str = "time", rtol: float = 1e-9, atol: float = 1e-9) -> DataFrame:
    """Does the last row before each cutoff change when later rows are there?

    function(df, keys) computes the features; prefixes are tagged by their cutoff, which is one more key, so all run as one plan.
    """
    cuts = F.explode(F.array(*[F.lit(c).cast("timestamp_ntz") for c in cutoffs]))
    prefixes = df.withColumn("cutoff", cuts).filter(F.col(order) <= F.col("cutoff"))
    last = tail_n(function(prefixes, ("cutoff", *keys)), 1, ("cutoff", *keys), order)
    whole = function(df, keys)
    own = last.select(*keys, order, "cutoff", *columns)
    return feature_diff_long(own, whole.join(own.select(*keys, order, "cutoff"), [*keys, order]), columns, rtol, atol, (*keys, order, "cutoff"))


def tail_convergence(df: DataFrame, function: Callable[[DataFrame, tuple[str, ...]], DataFrame], cutoffs: list, lengths: list[int], columns: list[str], tol: float = 1e-6, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The shortest history whose last row is that of the whole history, per series and cutoff (null if none is).

    Cutoffs and lengths are keys of one plan instead of a search.
    """
    cuts = F.explode(F.array(*[F.lit(c).cast("timestamp_ntz") for c in cutoffs]))
    prefixes = df.withColumn("cutoff", cuts).filter(F.col(order) <= F.col("cutoff"))
    rank = F.row_number().over(Window.partitionBy(*keys, "cutoff").orderBy(F.col(order).desc()))
    tails = prefixes.withColumn("__r", rank).withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]))).filter(F.col("__r") <= F.col("length")).drop("__r")
    short = tail_n(function(tails, ("cutoff", "length", *keys)), 1, ("cutoff", "length", *keys), order)
    full = tail_n(function(prefixes, ("cutoff", *keys)), 1, ("cutoff", *keys), order)
    pack = lambda d, n, *more: d.select("cutoff", *more, *keys, F.struct(*[F.col(k).cast("double").alias(k) for k in columns]).alias(n))
    both = pack(short, "__a", "length").join(pack(full, "__b"), ["cutoff", *keys])
    same = F.lit(True)
    for k in columns:
        same = same & is_close(F.col(f"__a.{k}"), F.col(f"__b.{k}"), 0.0, tol)
    return both.withColumn("ok", same).groupBy("cutoff", *keys).agg(F.min(F.when(F.col("ok"), F.col("length"))).alias("length"))


def blacklist_from_summary(summary: DataFrame) -> DataFrame:
    return summary.filter("n_diff > 0").select("feature")


def focus_diff(long: DataFrame, at, pattern: str = ".*", order: str = "time") -> DataFrame:
    return long.filter((F.col(order) == F.lit(at).cast("timestamp_ntz")) & F.col("feature").rlike(pattern))


def warmup_batch_vs_single(df: DataFrame, function: Callable[[DataFrame], DataFrame], columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Each series' last row scored alone against the same row scored inside its batch."""
    alone = function(tail_n(df, 1, keys[:-1], keys[-1]))
    return feature_diff_long(alone, function(df), columns, 1e-9, 1e-9, keys)


# --- guards ---


def finite_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, nulls, nans, infinities: one pass."""
    v = F.col("value")
    return unpivot(df, [], columns).groupBy("feature").agg(F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinities"))


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = [r["feature"] for r in finite_report(df, columns).filter("nulls + nans + infinities > 0").collect()]
    if bad:
        raise ValueError(f"not finite: {', '.join(sorted(bad))}")
    return df


def warmup_report(df: DataFrame, need: dict[str, int]) -> DataFrame:
    """tf, have, need, ok for every timeframe that is needed."""
    wanted = df.sparkSession.createDataFrame(list(need.items()), "tf string, need int")
    have = df.groupBy("tf").agg(F.count(F.lit(1)).alias("have"))
    return wanted.join(have, "tf", "left").select("tf", F.coalesce("have", F.lit(0)).alias("have"), "need", (F.coalesce("have", F.lit(0)) >= F.col("need")).alias("ok"))


def assert_warmup(df: DataFrame, need: dict[str, int]) -> DataFrame:
    short = [r["tf"] for r in warmup_report(df, need).filter("NOT ok").collect()]
    if short:
        raise ValueError(f"too few rows: {', '.join(sorted(short))}")
    return df


def guard_for_predict(df: DataFrame, columns: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The training columns in their order as floats, if just these are there and all finite."""
    have = {k for k in df.columns if k not in keys}
    if have != set(columns):
        raise ValueError(f"missing: {sorted(set(columns) - have)}; extra: {sorted(have - set(columns))}")
    return assert_finite(df, columns).select(*keys, *[F.col(k).cast("float").alias(k) for k in columns])
