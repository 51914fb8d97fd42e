"""Operator 3: mixing sources to target weights, with DataFrame operations only.

Weights are token shares raised to an exponent between 0 (all alike) and 1 (as they are) and normalised.  The exponent is the largest
that, by bisection, meets a target entropy, or the smallest that keeps every source within a number of epochs.  A source's weight is then
realised in blocks of documents: whole epochs take all blocks, the last one takes blocks in the order of its own permutation as far as the budget goes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.llm.storage import stored


@dataclass(frozen=True)
class Settings:
    """Give ``most_epochs``, or ``entropy`` (a fraction of the logarithm of the number of sources), or both: then both hold if they can.

    budget: tokens to draw, as a multiple of all tokens; None: as few as let every source be seen once.
    """

    most_epochs: float | None = 4.0
    entropy: float | None = None
    budget: float | None = None
    blocks: int = 256
    seed: str = "mix"
    most_broadcast: int = 200_000  # rows of the plan up to which it is broadcast


#: Halvings of the exponent's range, and how many are probed in one pass.
HALVINGS, AT_ONCE = 28, 4
WORD = r"[^\x20\x09-\x0D]+"


def _source(column: Column) -> Column:
    """A key that keeps null sources apart from every named one."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _number(*parts: Column) -> Column:
    """32 bits of the md5 of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def _block(s: Settings, id_col: str) -> Column:
    return (_number(F.lit(s.seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % s.blocks).cast("int")


def exponent(sources: DataFrame, s: Settings) -> float:
    """Bisects over the aggregated sources (source, tokens); every pass probes 2**AT_ONCE - 1 exponents in one aggregation."""
    real = sources.filter("tokens > 0")
    total = real.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"] or total["n"] == 1:
        return 1.0
    log_p = F.log(F.col("tokens") / F.lit(float(total["t"])))
    low, step = 0, 1 << HALVINGS

    def meets(r, k: int) -> bool:
        """Whether the mix is even enough at this exponent: its entropy does not fall as the exponent falls, nor does any source's repetition."""
        z, zl, rare = r[f"z{k}"], r[f"l{k}"], r[f"r{k}"]
        a = k_exponents[k]
        if s.entropy is not None:
            return math.log(z) - a * zl / z >= s.entropy * math.log(total["n"])
        return _epochs(z, rare, a, total, s) > s.most_epochs

    while step > 1:
        step >>= AT_ONCE
        k_exponents = [(low + step * (k + 1)) / (1 << HALVINGS) for k in range(2**AT_ONCE - 1)]
        sums = []
        for k, a in enumerate(k_exponents):
            power = F.exp(log_p * a)
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * log_p).alias(f"l{k}"), F.max(power / F.col("tokens")).alias(f"r{k}")]
        row = real.agg(*sums).first()
        low += step * sum(1 for k in range(len(k_exponents)) if meets(row, k))
    if s.entropy is not None:
        chosen = low / (1 << HALVINGS)
        if s.most_epochs is not None:
            chosen = max(chosen, exponent(sources, Settings(s.most_epochs, None, s.budget, s.blocks, s.seed)))
        return chosen
    return (low + 1) / (1 << HALVINGS)  # the smallest probed exponent within the limit


def _epochs(z: float, rare: float, a: float, total, s: Settings) -> float:
    """Epochs of the source that is repeated most: rare is the largest weight per token, before normalising."""
    share = math.exp(a * math.log(total["most"] / total["t"]))
    budget = total["most"] * z / share if s.budget is None else s.budget * total["t"]
    return rare / z * budget


def weigh(sources: DataFrame, a: float, s: Settings) -> DataFrame:
    """source, tokens, weight, epochs.  A source without tokens has weight 0 and one epoch."""
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.max("tokens").alias("most")).first()
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(total["t"] or 1))) * a)).otherwise(0.0)
    z = sources.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    if s.budget is None:
        share = math.exp(a * math.log(total["most"] / total["t"])) if total["most"] else 1.0
        budget = (total["most"] or 0) * z / share
    else:
        budget = s.budget * total["t"]
    weight = power / F.lit(z)
    return sources.select("source", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, F.round(weight * F.lit(float(budget)) / F.col("tokens"), 9)).otherwise(1.0).alias("epochs"))


def plan(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, block, epoch, place, tokens, weight: which blocks of which source are drawn in which epoch, and where in the epoch's order."""
    s = settings
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    blocks = stored(df.select(_source(F.col(source_col)).alias("source"), _block(s, id_col).alias("block"), words.alias("tokens")).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = stored(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    weighed = weigh(sources, exponent(sources, s), s).withColumnRenamed("tokens", "all_tokens")
    drawn = blocks.join(weighed, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs").cast("int") - 1, F.lit(0)))))
    order = [_number(F.lit(s.seed), F.col("source"), F.col("epoch").cast("string"), F.col("block").cast("string")), F.col("block")]
    one = Window.partitionBy("source", "epoch").orderBy(*order)
    before = F.coalesce(F.sum("tokens").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = drawn.withColumn("before", before).withColumn("place", F.row_number().over(one) - 1)
    fits = (F.col("epochs") >= F.col("epoch") + 1) | (F.col("before") * 2 + F.col("tokens") <= (F.col("epochs") - F.col("epoch")) * F.col("all_tokens") * 2)
    return placed.filter(fits).select("source", "block", "epoch", "place", "tokens", "weight")


def mix(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The drawn rows: all columns of ``df`` with ``epoch, block, place`` behind them, a row once for each epoch that draws it.

    A null source is a source; a null text has no tokens; repeated rows are drawn together; a source without tokens is drawn once.  A column
    of ``df`` named like one of the three is replaced.  An empty table gives an empty one.  What is drawn differs from the weights by half a block of
    a source at most.  The plan is broadcast if its rows are few enough, else rows are shuffled by source and block, so that a source that holds most
    rows is spread over its blocks.
    """
    s = settings
    drawn = stored(plan(df, s, id_col, text_col, source_col).select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.col("epoch").cast("int").alias("__epoch"), F.col("place").cast("int").alias("__place")), "plan")
    if drawn.count() <= s.most_broadcast:
        drawn = F.broadcast(drawn)
    keyed = df.withColumn("__source", _source(F.col(source_col))).withColumn("__block", _block(s, id_col))
    out = keyed.join(drawn, ["__source", "__block"])
    rest = [c for c in df.columns if c.lower() not in ("epoch", "block", "place")]
    return out.select(*rest, F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__place").alias("place"))
