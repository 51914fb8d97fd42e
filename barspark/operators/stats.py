"""Aggregations, drift and feature selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.operators.ranges import prefix_scan
from barspark.operators.scan import with_halo
from barspark.storage import stored

div = F.try_divide


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(k).alias(name), F.col(k).cast("double").alias(value)) for k in columns])).alias("__p")).select(*ids, f"__p.{name}", f"__p.{value}")


def day_profile(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time", label: str = "y") -> DataFrame:
    """Per day: distinct labels, range and mean of the close."""
    return df.groupBy(*keys, F.to_date(order).alias("day")).agg(
        F.countDistinct(label).alias("n_labels"), (F.max("close") - F.min("close")).alias("close_range"), F.avg("close").alias("close_mean")
    )


def last_bar_flags(df: DataFrame, of: str = "day", keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds ``is_last``: the last bar of its day or of its ISO week."""
    part = [F.to_date(order)] if of == "day" else [F.extract(F.lit("YEAROFWEEK"), order), F.weekofyear(order)]
    return df.withColumn("is_last", F.col(order) == F.max(order).over(Window.partitionBy(*keys, *part)))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    count = F.countDistinct if exact else F.approx_count_distinct
    return unpivot(df, [], columns).groupBy("feature").agg(count("value").alias("n_distinct"))


def cumulative(rows: DataFrame, part: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds ``upto_c``, the running sum of each column in its part, and ``all_c``, the whole sum; (part, order) occurs once each.

    Rows are dealt by ranges of (part, order); sums inside a range and a window over the few sums of ranges make up the rest, so no task
    holds a whole part.
    """
    ranged = stored(rows.repartitionByRange(*part, order).withColumn("__p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("__p", *part).agg(*[F.sum(k).alias(f"__s_{k}") for k in columns])
    whole = Window.partitionBy(*part)
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__p", *part, *[e for k in columns for e in (F.coalesce(F.sum(f"__s_{k}").over(earlier), F.lit(0)).alias(f"__b_{k}"), F.sum(f"__s_{k}").over(whole).alias(f"all_{k}"))])
    own = Window.partitionBy("__p", *part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"__u_{k}": F.sum(k).over(own) for k in columns}).join(before, ["__p", *part])
    return out.withColumns({f"upto_{k}": F.col(f"__u_{k}") + F.col(f"__b_{k}") for k in columns}).drop("__p", *[f"__{x}_{k}" for x in "ub" for k in columns])


def exact_quantiles(long: DataFrame, ps: list[float]) -> DataFrame:
    """feature and ``q0, q1, ...``: exact quantiles of (feature, value), by counts of distinct values; what lies between two values is on the line."""
    counts = long.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = cumulative(counts, ["feature"], "value", ["n"])
    found = []
    for i, p in enumerate(ps):
        rank = (F.col("all_n") - 1) * F.lit(p)
        at = lambda r: F.max(F.when((F.col("upto_n") - F.col("n") <= r) & (F.col("upto_n") > r), F.col("value")))
        found += [at(F.floor(rank)).alias(f"__l{i}"), at(F.ceil(rank)).alias(f"__h{i}"), F.max(rank - F.floor(rank)).alias(f"__w{i}")]
    line = lambda i: F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__w{i}")
    return steps.groupBy("feature").agg(*found).select("feature", *[line(i).alias(f"q{i}") for i in range(len(ps))])


def quantiles(df: DataFrame, columns: list[str], ps: list[float], exact: bool = True) -> DataFrame:
    """One row per column and quantile; ``exact=False`` takes one pass."""
    long = unpivot(df, [], columns)
    wanted = F.array(*[F.lit(p) for p in ps])
    if exact:
        found = exact_quantiles(long, ps).select("feature", F.array(*[f"q{i}" for i in range(len(ps))]).alias("q"))
    else:
        found = long.groupBy("feature").agg(F.percentile_approx("value", wanted).alias("q"))
    return found.select("feature", F.explode(F.arrays_zip(wanted.alias("p"), F.col("q"))).alias("z")).select("feature", F.col("z.p").alias("p"), F.col("z.q").alias("value"))


def equal_edges(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """feature, bin, lo, hi: equal widths from the least to the greatest value."""
    spans = unpivot(df, [], columns).groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    i = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / bins
    return spans.select("*", i).select("feature", "bin", edge(F.col("bin")).alias("lo"), F.when(F.col("bin") == bins - 1, F.col("b")).otherwise(edge(F.col("bin") + 1)).alias("hi"))


def quantile_edges(df: DataFrame, columns: list[str], bins: int, exact: bool = True) -> DataFrame:
    """feature, bin, lo, hi: edges at equal shares of the values; edges that coincide are one."""
    edges = quantiles(df, columns, [i / bins for i in range(bins + 1)], exact).groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("e"))
    return edges.select("feature", F.posexplode(F.expr("transform(sequence(0, greatest(size(e) - 2, 0)), i -> struct(e[i] AS lo, e[least(i + 1, size(e) - 1)] AS hi))")).alias("bin", "p")).select("feature", "bin", "p.lo", "p.hi")


def binned(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the bin of each (feature, value): values outside are left out, the last bin holds its upper end.

    Each feature's edges are one array of a few numbers, and these arrays are broadcast; no row is multiplied.
    """
    arrays = edges.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "lo"))).alias("__e"), F.max("hi").alias("__hi"))
    rows = long.join(F.broadcast(arrays.select("feature", F.col("__e.lo").alias("__lo"), "__hi")), "feature").filter(F.col("value") <= F.col("__hi"))
    at = F.size(F.filter("__lo", lambda e: e <= F.col("value"))) - 1
    return rows.withColumn("bin", at).filter("bin >= 0").drop("__lo", "__hi")


def histogram(df: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies in the given bins: values outside are left out, the last bin holds its upper end, empty bins have frequency 0."""
    counts = binned(unpivot(df, [], columns), edges).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    filled = edges.join(counts, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return filled.withColumn("freq", F.coalesce(div(F.col("n"), total), F.lit(0.0))).select("feature", "bin", "lo", "hi", "n", "freq")


def psi(train: DataFrame, live: DataFrame, floor: float = 1e-9) -> DataFrame:
    """Population stability of two histograms over the same bins, per feature; zero frequencies count as ``floor``."""
    up = lambda k: F.when(F.col(k) <= 0, floor).otherwise(F.col(k))
    both = train.select("feature", "bin", up("freq").alias("p")).join(live.select("feature", "bin", up("freq").alias("q")), ["feature", "bin"])
    return both.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))


def psi_compare(train: DataFrame, live: DataFrame, columns: list[str], bins: int = 10, alarm: float = 0.05) -> DataFrame:
    """PSI of each column over the training data's equal bins, their mean, and whether that raises an alarm."""
    edges = equal_edges(train, columns, bins)
    scores = psi(histogram(train, edges, columns), histogram(live, edges, columns))
    whole = scores.agg(F.avg("psi").alias("psi")).select(F.lit("*").alias("feature"), "psi")
    return scores.unionByName(whole).withColumn("alarm", F.col("psi") > alarm)


def ks_statistic(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per column.

    Values are counted per distinct value first, so equal ones are one step; running sums are those of :func:`cumulative`.
    """
    both = unpivot(a, [], columns).withColumn("s", F.lit(0)).unionByName(unpivot(b, [], columns).withColumn("s", F.lit(1))).filter("value IS NOT NULL")
    steps = cumulative(both.groupBy("feature", "value").agg(F.sum(1 - F.col("s")).alias("x"), F.sum("s").alias("y")), ["feature"], "value", ["x", "y"])
    gap = F.abs(div(F.col("upto_x"), F.col("all_x")) - div(F.col("upto_y"), F.col("all_y")))
    return steps.withColumn("gap", gap).groupBy("feature").agg(F.max("gap").alias("ks"))


def suggest_start_date(df: DataFrame, columns: list[str], order: str = "time", step_days: int = 30, least_days: int = 90, limit: float = 0.35, least_rows: int = 1000) -> DataFrame:
    """Per candidate start: rows on either side, mean KS of the older against the newer ones, and whether it will do; and the newest that will.

    A row lies in the span between two starts.  Distinct values carry counts up to each span, so the plan grows with the number of starts.
    """
    last = df.agg(F.max(order).alias("last"), F.min(order).alias("first"))
    starts = last.select(F.explode(F.expr(f"sequence(last - INTERVAL {least_days} DAYS, least(first, last - INTERVAL {least_days} DAYS), INTERVAL -{step_days} DAYS)")).alias("start"), "first").filter("start >= first").select("start")
    starts = starts.orderBy("start")
    known = [r["start"] for r in starts.collect()]  # as many as steps in the time that the table covers
    if not known:
        return starts.select("start", *[F.lit(None).cast("double").alias("ks"), *[F.lit(None).cast("long").alias(k) for k in ("older", "newer")], F.lit(None).cast("boolean").alias("ok"), F.lit(False).alias("suggested")])
    kind = df.schema[order].dataType
    span = sum((F.when(F.col(order) >= F.lit(k).cast(kind), 1).otherwise(0) for k in known[1:]), F.when(F.col(order) >= F.lit(known[0]).cast(kind), 1).otherwise(0))
    long = unpivot(df.withColumn("__span", span), ["__span"], columns).filter("value IS NOT NULL")
    # a row in span i is older than the starts from i on, so what is newer is the rest of all rows
    names = [f"n{i}" for i in range(len(known))]
    counted = long.groupBy("feature", "value").agg(*[F.count_if(F.col("__span") <= i).alias(k) for i, k in enumerate(names)], F.count(F.lit(1)).alias("n"))
    steps = cumulative(counted, ["feature"], "value", [*names, "n"])
    one = []
    for i, k in enumerate(names):
        newer = lambda kind, k=k: F.col(f"{kind}_n") - F.col(f"{kind}_{k}")
        gap = F.abs(div(F.col(f"upto_{k}"), F.col(f"all_{k}")) - div(newer("upto"), newer("all")))
        one.append(F.struct(F.lit(i).alias("i"), gap.alias("gap"), F.col(f"all_{k}").alias("older"), newer("all").alias("newer")))
    ks = steps.select("feature", F.inline(F.array(*one))).groupBy("i", "feature").agg(F.max("gap").alias("ks"), F.max("older").alias("older"), F.max("newer").alias("newer"))
    at = F.element_at(F.array(*[F.lit(k).cast(kind) for k in known]), F.col("i") + 1)
    mean = ks.groupBy("i").agg(F.avg("ks").alias("ks"), F.min("older").alias("older"), F.min("newer").alias("newer")).select(at.alias("start"), "ks", "older", "newer")
    ok = mean.withColumn("ok", (F.col("ks") < limit) & (F.col("older") >= least_rows) & (F.col("newer") >= least_rows))
    return ok.withColumn("suggested", F.col("start").eqNullSafe(F.max(F.when(F.col("ok"), F.col("start"))).over(Window.partitionBy())))


def signal_counts(df: DataFrame, signal: str = "signal", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """BUY, SELL and NONE counts and the share of decided rows."""
    n = lambda k: F.count_if(F.col(signal) == k)
    return df.groupBy(*keys).agg(n("BUY").alias("n_buy"), n("SELL").alias("n_sell"), n("NONE").alias("n_none"), (100.0 * F.count_if(F.col(signal) != "NONE") / F.count(F.lit(1))).alias("coverage"))


def vote_count(df: DataFrame, name: str, least: int) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least)


def top_k(df: DataFrame, column: str, k: int, name: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), F.col(name)).limit(k)


def union_reports(reports: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Reports of several families under common names: family -> (rows, {own name: common name}); what one lacks is null."""
    out = None
    for family, (df, names) in reports.items():
        own = df.select(F.lit(family).alias("family"), *[F.col(a).alias(b) for a, b in names.items()])
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def variance_filter(df: DataFrame, columns: list[str], least: float = 0.01) -> DataFrame:
    """feature, variance (population), kept."""
    return unpivot(df, [], columns).groupBy("feature").agg(F.var_pop("value").alias("variance")).withColumn("kept", F.col("variance") > least)


def _grams(df: DataFrame, left: list[str], right: list[str], upper: bool) -> DataFrame:
    """i, j, n, sx, sy, sxx, syy, sxy of each pair of a left and a right column over the rows that have both; ``upper``: of pairs with i < j only.

    One pass: every task multiplies its rows as matrices (values, their squares, and which are there) and hands on one row for each pair.
    Values are taken from the column's least one on, so that a column's level costs no digits.  NaN and infinities count as null.
    """
    columns = list(dict.fromkeys([*left, *right]))
    value = lambda k: F.when(F.abs(F.col(k).cast("double")) < float("inf"), F.col(k).cast("double"))
    low = df.agg(*[F.min(value(k)).alias(str(i)) for i, k in enumerate(columns)]).first()
    base = [low[str(i)] or 0.0 for i in range(len(columns))]
    a, b = ([columns.index(k) for k in side] for side in (left, right))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(a), len(b)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - base if batch.num_rows else np.zeros((0, len(columns)))
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            p, q, mp, mq = x[:, a], x[:, b], m[:, a], m[:, b]
            sums += [mp.T @ mq, p.T @ mq, mp.T @ q, (p * p).T @ mq, mp.T @ (q * q), p.T @ q]
        i, j = np.triu_indices(len(a), 1) if upper else np.indices((len(a), len(b))).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(s[i, j]) for s in sums)], ["i", "j", *names])

    rows = df.select(*[value(k).alias(f"c{i}") for i, k in enumerate(columns)])
    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names))
    return parts.groupBy("i", "j").agg(*[F.sum(n).alias(n) for n in names])


def _gram_corr() -> Column:
    """Pearson's correlation from the sums of a pair; null where one is constant."""
    n = F.col("n")
    inner = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / n
    xx, yy = inner("sx", "sx", "sxx"), inner("sy", "sy", "syy")
    flat = (xx <= 1e-14 * F.col("sxx")) | (yy <= 1e-14 * F.col("syy"))
    return F.when((n > 0) & ~flat, F.greatest(F.least(inner("sx", "sy", "sxy") / F.sqrt(xx) / F.sqrt(yy), F.lit(1.0)), F.lit(-1.0)))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, i, j, r for every pair of columns, a standing before b, over the rows that have both; r is null where one is constant.

    The plan does not grow with the number of columns: a task's rows become products of matrices.
    """
    name = lambda k: F.get(F.array(*map(F.lit, columns)), F.col(k))
    return _grams(df, columns, columns, True).select(name("i").alias("a"), name("j").alias("b"), "i", "j", _gram_corr().alias("r"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation of the rows that have both; null where one is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.when((F.min(x) != F.max(x)) & (F.min(y) != F.max(y)), div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def corr_filter(df: DataFrame, columns: list[str], most: float = 0.9) -> DataFrame:
    """feature, dropped: the later column of every pair beyond the limit."""
    beyond = correlation_pairs(df, columns).filter(F.abs("r") > most).select(F.col("b").alias("feature")).distinct().withColumn("dropped", F.lit(True))
    names = df.sparkSession.createDataFrame([(k,) for k in columns], "feature string")
    return names.join(beyond, "feature", "left").fillna(False, ["dropped"])


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function of numbers from 1 on: the recurrence up to 8 more, then the asymptotic series."""
    z = x.cast("double") + 8
    back = sum((1 / (x + k) for k in range(1, 8)), 1 / x.cast("double"))
    return F.ln(z) - 1 / (2 * z) - F.pow(z, -2.0) / 12 + F.pow(z, -4.0) / 120 - F.pow(z, -6.0) / 252 + F.pow(z, -8.0) / 240 - F.pow(z, -10.0) / 132 - back


def mutual_information(df: DataFrame, columns: list[str], label: str, neighbors: int = 3, chunk: int = 4096) -> DataFrame:
    """feature, mi: mutual information (nats) of each column with a discrete label, by nearest neighbours.

    A row's distance to its k-th neighbour of the same label, k = ``neighbors`` or one less than the label's rows, spans an open interval, and
    m rows of any label lie in it (in one of width 0: rows of the same value); mi = psi(n) + mean psi(k) - mean psi(rows of the label)
    - mean psi(m), 0 at least.  Labels of one row are left out, and so are nulls, NaN and infinities.

    Neighbours come from windows over chunks of the sorted values with ``neighbors`` rows on either side, and the counts from one prefix
    scan over values and interval ends together, so no task holds a column.
    """
    long = unpivot(df.withColumn("__y", F.col(label).cast("string")), ["__y"], columns)
    long = long.filter((F.abs("value") < float("inf")) & F.col("__y").isNotNull()).withColumn("__one", F.lit(1))
    placed = prefix_scan(long, {"__row": ("__one", "count")}, ("feature", "__y"), "value")
    placed = placed.withColumn("value", F.col("value") + 0.0)  # -0 is 0
    counts = stored(placed.groupBy("feature", "__y").agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1"), "labels")
    rows = with_halo(placed, neighbors, chunk, ("feature", "__y"), "value", neighbors, "__row")
    w = Window.partitionBy("feature", "__y", "chunk").orderBy("__row")
    near = F.array(*[F.struct(F.abs(v - F.col("value")).alias("d"), v.alias("v")) for k in range(1, neighbors + 1) for v in (F.lag("value", k).over(w), F.lead("value", k).over(w))])
    rows = rows.withColumn("__near", near).filter("NOT halo").join(counts, ["feature", "__y"]).withColumn("__k", F.least(F.lit(neighbors).cast("long"), F.col("__c") - 1))
    found = F.element_at(F.array_sort(F.filter("__near", lambda p: p["d"].isNotNull())), F.col("__k").cast("int"))
    x, at = F.col("value"), F.col("__at")
    low = F.when(at["v"] < x, at["v"]).otherwise(x - at["d"])
    high = F.when(at["v"] > x, at["v"]).otherwise(x + at["d"])
    zero = at["d"] == 0
    rows = rows.withColumn("__at", found).select("feature", "__k", "__c", x.alias("v"), low.alias("lo"), high.alias("hi"), zero.alias("zero"))
    # values up to each end: an end that counts equal values comes after them, one that doesn't before; signs say what to add
    end = lambda v, after, sign: F.struct(v.alias("at"), F.when(after, 2).otherwise(0).alias("kind"), F.lit(sign).alias("sign"))
    value = F.struct(F.col("v").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("sign"))
    points = rows.withColumn("__id", F.monotonically_increasing_id())
    points = stored(points, "neighbours")
    marks = points.select("feature", "__id", F.inline(F.array(value, end(F.col("hi"), F.col("zero"), 1), end(F.col("lo"), ~F.col("zero"), -1))))
    marks = marks.withColumn("__one", F.when(F.col("kind") == 1, 1))
    upto = prefix_scan(marks, {"__upto": ("__one", "count")}, ("feature",), ("at", "kind")).filter("sign <> 0")
    inside = upto.groupBy("feature", "__id").agg(F.sum(F.col("sign") * F.col("__upto")).alias("__m"))
    each = points.join(inside, ["feature", "__id"])
    n = F.count(F.lit(1))
    mi = digamma(n) + F.avg(digamma(F.col("__k"))) - F.avg(digamma(F.col("__c"))) - F.avg(digamma(F.col("__m")))
    return each.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def filled_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, NaN and infinities of the columns become the column's median; of a column without a value they stay null."""
    df = df.withColumns({k: F.when(F.abs(F.col(k).cast("double")) < float("inf"), F.col(k).cast("double")) for k in columns})
    middle = {r["feature"]: r["q0"] for r in exact_quantiles(unpivot(df, [], columns), [0.5]).collect()}  # one row a column
    return df.fillna({k: v for k, v in middle.items() if v is not None})


def select_features(df: DataFrame, columns: list[str], label: str, fold: str, top_k_: int = 20, least_variance: float = 0.01, most_corr: float = 0.9) -> DataFrame:
    """feature, votes: the ``top_k_`` features that variance, correlation and mutual information choose in the training rows of every fold.

    Fold f (from 1) is trained on the rows of all folds before it, so the prefix of a series grows from fold to fold.  Gaps are filled by the
    prefix's median first.  Of features with all votes those with the most mutual information, all folds together, come first.
    """
    last = df.agg(F.max(fold)).first()[0] or 0
    votes = None
    for f in range(1, last + 1):
        part = stored(filled_median(df.filter(F.col(fold) < f), columns), "prefix")
        kept = {r["feature"] for r in variance_filter(part, columns, least_variance).filter("kept").collect()}
        kept = [k for k in columns if k in kept]
        gone = {r["feature"] for r in corr_filter(part, kept, most_corr).filter("dropped").collect()} if len(kept) > 1 else set()
        kept = [k for k in kept if k not in gone]
        if kept:
            chosen = top_k(mutual_information(part, kept, label), "mi", top_k_, "feature")
            votes = chosen if votes is None else votes.unionByName(chosen)
    if votes is None:
        return df.sparkSession.createDataFrame([], "feature string, votes long")
    whole = votes.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"), F.sum("mi").alias("mi")).filter(F.col("votes") >= last)
    return top_k(whole, "mi", top_k_, "feature").select("feature", "votes")


def rank_by_target_corr(df: DataFrame, columns: list[str], label: str, k: int) -> DataFrame:
    """feature, r: the columns most correlated with the label, either way."""
    name = F.get(F.array(*map(F.lit, columns)), F.col("i"))
    found = _grams(df, columns, [label], False).select(name.alias("feature"), F.abs(_gram_corr()).alias("r"))
    return top_k(found.filter("r IS NOT NULL"), "r", k, "feature")


def select_strong(df: DataFrame, columns: list[str], label: str, most: int = 300, trees: int = 256, seed: int = 7) -> DataFrame:
    """feature, importance of a random forest over the three times ``most`` columns best correlated with the label; those with any importance.

    Gaps are filled by the column's median, so that no row with a label is lost; a column without any value is left out.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    first = [r["feature"] for r in rank_by_target_corr(df, columns, label, 3 * most).collect()] or columns
    labelled = filled_median(df.filter(F.col(label).isNotNull()), first)
    rows = VectorAssembler(inputCols=first, outputCol="__x", handleInvalid="skip").transform(labelled)
    weights = rows.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("__w"))
    model = RandomForestClassifier(featuresCol="__x", labelCol=label, weightCol="__w", numTrees=trees, seed=seed).fit(rows.join(F.broadcast(weights), label))
    found = [(f, float(v)) for f, v in zip(first, model.featureImportances.toArray(), strict=True) if v > 0] or [(f, 0.0) for f in first]
    return top_k(df.sparkSession.createDataFrame(found, "feature string, importance double"), "importance", most, "feature")


def unstable_columns(df: DataFrame, columns: list[str], segments: int = 8, stride: int = 75, most_ratio: float = 0.12, most_fails: int = 8, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """feature, samples, fails, ratio, unstable: sampled windows (one in ``stride`` rows, in ``segments`` parts of a series) that end in zero or null."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumns({"__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    part = F.ceil(F.col("__n") / segments)
    sampled = rows.filter(((F.col("__r") - 1) % part % stride == stride - 1) | (F.col("__r") == F.col("__n")))
    v = F.col("value")
    out = unpivot(sampled, [], columns).groupBy("feature").agg(F.count(F.lit(1)).alias("samples"), F.count_if(v.isNull() | (v == 0)).alias("fails"))
    return out.withColumn("ratio", F.col("fails") / F.col("samples")).withColumn("unstable", (F.col("ratio") >= most_ratio) | (F.col("fails") >= most_fails))


def heavy_columns(df: DataFrame, columns: list[str], least: float = 10.0, k: int = 30) -> DataFrame:
    """feature, ratio: 99th percentile over the absolute median, where beyond the limit."""
    q = exact_quantiles(unpivot(df, [], columns), [0.99, 0.5]).withColumnsRenamed({"q0": "p99", "q1": "p50"})
    return top_k(q.withColumn("ratio", div(F.col("p99"), F.abs("p50"))).filter(F.col("ratio") > least).select("feature", "ratio"), "ratio", k, "feature")


def mean_shift_stability(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.agg(F.avg(column).alias("a")).join(b.agg(F.avg(column).alias("b"))).select((1 - F.abs(F.col("b") - F.col("a"))).alias("stability"))


def pearson_spearman_gap(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Mean absolute Pearson and Spearman correlation with the label, and their difference: how far relations are from lines.

    Average ranks come from counts per distinct value, not from a sort of all rows in one task's window.
    """
    long = unpivot(df, [label], columns).filter(F.col("value").isNotNull() & F.col(label).isNotNull())

    def ranks(column: str, name: str) -> DataFrame:
        counts = cumulative(long.groupBy("feature", column).agg(F.count(F.lit(1)).alias("n")), ["feature"], column, ["n"])
        return counts.select("feature", column, (F.col("upto_n") - (F.col("n") - 1) / 2).alias(name))

    both = long.join(ranks("value", "rx"), ["feature", "value"]).join(ranks(label, "ry"), ["feature", label])
    per = both.groupBy("feature").agg(F.abs(safe_corr(F.col("value"), F.col(label))).alias("p"), F.abs(safe_corr(F.col("rx"), F.col("ry"))).alias("s"))
    return per.agg(F.avg("p").alias("pearson"), F.avg("s").alias("spearman")).withColumn("gap", F.col("spearman") - F.col("pearson"))


def scaler_report(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and deviation of each column in both feeds, and the differences."""
    side = lambda df, s: unpivot(df, [], columns).groupBy("feature").agg(F.avg("value").alias(f"mean_{s}"), F.stddev_pop("value").alias(f"std_{s}"))
    return side(a, "a").join(side(b, "b"), "feature").withColumn("d_mean", F.col("mean_b") - F.col("mean_a")).withColumn("d_std", F.col("std_b") - F.col("std_a"))
