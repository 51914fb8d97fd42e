"""Recurrences inside long series (E19, E20), and the chunks that let one series use many tasks.

y = a * y_before + b with a constant a is a running sum inside a chunk of rows, plus what the chunk before carries in.  Each chunk is one pair (a, b)
that says what becomes of y in it; pairs of a bounded number of chunks are folded to one, level by level, and what is carried in is handed
down again.  So a series of any length is spread over tasks, all with built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.operators.ranges import same
from barspark.storage import stored

CHUNK = 128


def number_rows(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time", name: str = "row", span: str = "day") -> DataFrame:
    """Row numbers from 1 in each series: numbers inside a span of time, and a running count of the spans before.

    No task holds a whole series: the windows are over (series, span), and over the small table of spans.
    """
    at = F.date_trunc(span, F.col(order))
    df = df.withColumn("__span", at)
    counts = df.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "__span", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__span").orderBy(order))
    return df.withColumn("__own", own).join(offsets, [*keys, "__span"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__span", "__own", "__before")


def with_halo(df: DataFrame, lookback: int, chunk: int = 4096, keys: tuple[str, ...] = ("symbol",), order: str = "time", ahead: int = 0, row: str = "row") -> DataFrame:
    """Chunks of each series, each between the ``lookback`` rows before it and the ``ahead`` rows after it: window by (series, ``chunk``), then keep ``~halo``.

    Row numbers in a column ``row`` are used, else added.  No window and no task goes over a series: a row is copied to the chunks that reach it.
    """
    rows = df if row in df.columns else number_rows(df, keys, order, row)
    last = rows.groupBy(*keys).agg(F.floor((F.max(row) - 1) / chunk).alias("__last"))
    at = lambda by: F.floor((F.col(row) - 1 + by) / chunk)
    spread = same(rows, last, list(keys)).withColumn("chunk", F.explode(F.sequence(F.greatest(at(-ahead), F.lit(0).cast("long")), F.least(at(lookback), F.col("__last")))))
    return spread.withColumn("halo", F.col("chunk") != at(0)).drop("__last")


def affine_scan(df: DataFrame, scans: dict[str, tuple[str, float, float]], keys: tuple[str, ...] = ("symbol",), order: str = "time", chunk: int = CHUNK) -> DataFrame:
    """Adds y = a * y_before + b * x for each ``name: (x, a, b)``, started with y = x at the first x that is not null.

    Later nulls count as no change of y by x: y = a * y_before.  a lies in [0, 1].  Row numbers in a column ``__row`` are used and kept, so that a
    chain of scans numbers rows once.
    """
    have = [c for c in df.columns if c not in scans]
    if "__row" not in df.columns:
        df = number_rows(df, keys, order, "__row")
    # three branches read these rows; stored, a chain of scans grows by steps and not by powers of three
    rows = stored(df, "scan")
    last = ((rows.agg(F.max("__row").alias("n")).first()["n"] or 1) - 1) // chunk
    rows = rows.withColumn("__chunk", F.floor((F.col("__row") - 1) / chunk)).withColumn("__k", (F.col("__row") - 1) % chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__k")
    # the first value of each series: the one that starts y
    starts = rows.groupBy(*keys).agg(*[F.min(F.when(F.col(x).isNotNull(), F.col("__row"))).alias(f"__at_{n}") for n, (x, _, _) in scans.items()])
    rows = rows.join(starts, list(keys))
    add = {}
    for n, (x, a, b) in scans.items():
        value = F.coalesce(F.when(F.col("__row") == F.col(f"__at_{n}"), F.col(x)).when(F.col("__row") > F.col(f"__at_{n}"), F.col(x) * b), F.lit(0.0))
        add[f"__v_{n}"] = value
    rows, add = rows.withColumns(add), {}
    for n, (_, a, _) in scans.items():
        value = F.col(f"__v_{n}")
        if a ** chunk > 1e-280:
            add[f"__u_{n}"] = F.sum(value * F.pow(F.lit(1.0 / a), F.col("__k"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(a), F.col("__k"))
        else:  # the weights fall so fast that few of them show in a double
            near = [F.coalesce(F.lag(value, j).over(inside), F.lit(0.0)) * F.lit(a**j) for j in range(1, chunk) if a**j > 1e-40]
            add[f"__u_{n}"] = sum(near, value)
    rows = rows.withColumns(add)
    ends = rows.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"), *[F.max_by(f"__u_{n}", "__k").alias(f"__b_{n}") for n in scans])
    pairs = ends.select(*keys, "__chunk", *[F.pow(F.lit(a), F.col("__n")).alias(f"__a_{n}") for n, (_, a, _) in scans.items()], *[f"__b_{n}" for n in scans])
    carried = _carried(pairs, list(scans), keys, last)
    rows = rows.join(carried, [*keys, "__chunk"], "left")
    out = {}
    for n, (_, a, _) in scans.items():
        y = F.col(f"__u_{n}") + F.coalesce(F.col(f"__c_{n}"), F.lit(0.0)) * F.pow(F.lit(a), F.col("__k") + 1)
        out[n] = F.when(F.col("__row") >= F.col(f"__at_{n}"), y)
    return rows.withColumns(out).select(*have, *out)


#: Pairs that are folded to one at a time; a series with no more than so many chunks needs one level.
FOLD = 256


def _then(y: Column, a: Column, b: Column) -> Column:
    """a * y + b; where a is 0 y does not matter, whatever it is."""
    return F.when(a == 0, F.lit(0.0)).otherwise(a * y) + b


def _carried(pairs: DataFrame, names: list[str], keys: tuple[str, ...], last: int) -> DataFrame:
    """keys, __chunk and ``__c_name``: y at the end of the chunk before, 0 for the first; pairs: keys, __chunk, ``__a_name``, ``__b_name``; last: the largest chunk."""
    item = F.struct("__chunk", *[c for n in names for c in (f"__a_{n}", f"__b_{n}")])
    groups = pairs.groupBy(*keys, F.floor(F.col("__chunk") / FOLD).alias("__group")).agg(F.array_sort(F.collect_list(item)).alias("__items"))  # FOLD at most
    start = {f"__c_{n}": F.lit(0.0) for n in names}
    if last >= FOLD:
        groups = stored(groups, "scan")
        one = F.struct(*[F.lit(x).alias(f"{k}_{n}") for n in names for k, x in (("a", 1.0), ("b", 0.0))])

        def fold(p: Column, x: Column) -> Column:
            return F.struct(*[c for n in names for c in ((p[f"a_{n}"] * x[f"__a_{n}"]).alias(f"a_{n}"), _then(p[f"b_{n}"], x[f"__a_{n}"], x[f"__b_{n}"]).alias(f"b_{n}"))])

        folded = groups.select(*keys, F.col("__group").alias("__chunk"), F.aggregate("__items", one, fold).alias("p"))
        folded = folded.select(*keys, "__chunk", *[F.col(f"p.{k}_{n}").alias(f"__{k}_{n}") for n in names for k in "ab"])
        above = _carried(folded, names, keys, last // FOLD).withColumnRenamed("__chunk", "__group")
        groups = groups.join(above, [*keys, "__group"])
        start = {c: F.col(c) for c in start}
    begin = F.struct(*[x.cast("double").alias(c) for c, x in start.items()])
    state = F.struct(begin.alias("y"), F.array().cast("array<struct<__chunk: bigint, " + ", ".join(f"`{c}`: double" for c in start) + ">>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = F.struct(x["__chunk"].cast("long").alias("__chunk"), *[s["y"][c].alias(c) for c in start])
        return F.struct(F.struct(*[_then(s["y"][f"__c_{n}"], x[f"__a_{n}"], x[f"__b_{n}"]).alias(f"__c_{n}") for n in names]).alias("y"), F.array_append(s["out"], now).alias("out"))

    return groups.select(*keys, F.inline(F.aggregate("__items", state, step, lambda s: s["out"])))


def ema(df: DataFrame, columns: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Exponential means ``name: (column, alpha)``, seeded with the first value."""
    return affine_scan(df, {n: (x, 1 - a, a) for n, (x, a) in columns.items()}, keys, order)


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def rma_alpha(n: int) -> float:
    return 1.0 / n


def ewm_adjusted(df: DataFrame, columns: dict[str, tuple[str, int]], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Means weighted by (1 - alpha) ** age and divided by the weights' sum: a ratio of two scans."""
    scans, df = {}, df.withColumns({f"one_{n}": F.when(F.col(x).isNotNull(), 1.0) for n, (x, _) in columns.items()})
    for n, (x, span) in columns.items():
        a = 1 - span_alpha(span)
        scans |= {f"num_{n}": (x, a, 1.0), f"den_{n}": (f"one_{n}", a, 1.0)}
    df = affine_scan(df, scans, keys, order)
    df = df.withColumns({n: F.try_divide(F.col(f"num_{n}"), F.col(f"den_{n}")) for n in columns})
    return df.drop(*[f"{p}_{n}" for n in columns for p in ("num", "den", "one")])


def varying_scan(df: DataFrame, name: str, a: str, b: str, keys: tuple[str, ...] = ("symbol",), order: str = "time", chunk: int = CHUNK) -> DataFrame:
    """y = a * y_before + b with a column for a (zero allowed): rows where a is null start anew with y = b.

    Chunks are folded to one pair each, what they carry in comes from :func:`_carried`, and each chunk is gone through again from there.
    """
    rows = stored(number_rows(df, keys, order, "__row"), "scan").withColumn("__chunk", F.floor((F.col("__row") - 1) / chunk))
    item = F.struct("__row", F.coalesce(F.col(a), F.lit(0.0)).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    chunks = stored(rows.groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_list(item)).alias("__rows")), "scan")  # a chunk's rows at most
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    whole = F.aggregate("__rows", one, lambda p, x: F.struct((p["a"] * x["a"]).alias("a"), _then(p["b"], x["a"], x["b"]).alias("b")))
    pairs = chunks.select(*keys, "__chunk", whole.alias("p")).select(*keys, "__chunk", F.col("p.a").alias("__a_y"), F.col("p.b").alias("__b_y"))
    carried = _carried(pairs, ["y"], keys, chunks.agg(F.max("__chunk").alias("c")).first()["c"] or 0)
    state = F.struct(F.col("__c_y").alias("y"), F.array().cast("array<struct<__row: bigint, __y: double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        y = _then(s["y"], x["a"], x["b"])
        return F.struct(y.alias("y"), F.array_append(s["out"], F.struct(x["__row"].cast("long").alias("__row"), y.alias("__y"))).alias("out"))

    replayed = chunks.join(carried, [*keys, "__chunk"]).select(*keys, F.inline(F.aggregate("__rows", state, step, lambda s: s["out"])))
    return rows.join(replayed, [*keys, "__row"], "left").withColumn(name, F.when(F.col(b).isNotNull(), F.nanvl("__y", F.lit(None)))).drop("__row", "__chunk", "__y")
