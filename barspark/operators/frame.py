"""Supervised framing (H1-H8)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barspark.functions import windows as x
from barspark.operators.clean import numeric_columns
from barspark.operators.stats import day_profile


def label_next_up(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time", keep_last: bool = False) -> DataFrame:
    """Adds y: 1 where the next close is higher.  The last row has no y and goes, unless it is kept for prediction."""
    after = F.lead("close").over(x.series(*keys, order=order))
    out = df.withColumn("__n", after).withColumn("y", F.when(F.col("__n").isNotNull(), (F.col("__n") > F.col("close")).cast("int"))).drop("__n")
    return out if keep_last else out.filter("y IS NOT NULL")


def drop_last(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("__r > 1").drop("__r")


def drop_flat_days(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Without days of one label whose close hardly moves."""
    flat = day_profile(df, keys, order).filter((F.col("n_labels") <= 1) & (F.col("close_range") <= 1e-4 * F.greatest(F.lit(1.0), F.col("close_mean"))))
    return df.withColumn("day", F.to_date(order)).join(flat.select(*keys, "day"), [*keys, "day"], "left_anti").drop("day")


def stack_lags(df: DataFrame, columns: list[str], window: int, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Columns ``<name>_tminus<i>`` for the last ``window`` rows instead of the columns; rows without a full history go."""
    w = x.series(*keys, order=order)
    lags = {f"{k}_tminus{i}": F.lag(k, i).over(w) for k in columns for i in range(window)}
    out = df.withColumns(lags | {"__r": F.row_number().over(w)}).filter(F.col("__r") >= window)
    return out.drop("__r", *columns)


def chrono_split(df: DataFrame, shares: dict[str, float], keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds ``split``: the named shares of each series' rows, oldest first."""
    w = Window.partitionBy(*keys)
    place = (F.row_number().over(w.orderBy(order)) - 1) / F.count(F.lit(1)).over(w)
    split, upto = F, 0.0
    names = list(shares)
    for name in names[:-1]:
        upto += shares[name]
        split = split.when(F.col("__p") < round(upto, 12), name)
    return df.withColumn("__p", place).withColumn("split", split.otherwise(names[-1]) if len(names) > 1 else F.lit(names[0])).drop("__p")


def ts_folds(df: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Adds ``test_fold``: rows are tested in this fold (1 to n) and trained on in all later ones; 0 is only ever trained on."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__r": F.row_number().over(w.orderBy(order)), "__n": F.count(F.lit(1)).over(w)})
    size = F.floor(F.col("__n") / (n + 1))
    first = F.col("__n") - n * size
    return rows.withColumn("test_fold", F.when((F.col("__r") <= first) | (size == 0), 0).otherwise(F.ceil((F.col("__r") - first) / size)).cast("int")).drop("__r", "__n")


def feature_columns(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "time", blacklist: set[str] = frozenset()) -> list[str]:
    """Numeric columns but the close, keys, label, those with a time in their name, and blacklisted ones."""
    out = [k for k in numeric_columns(df) if k not in (*keys, order, "y") and not re.search(r"(?i)(^|_)(close|time)$", k)]
    return [k for k in out if k not in blacklist and re.sub(r"_tminus\d+$", "", k) not in blacklist]


def window_of(names: list[str]) -> int:
    """The window that lag names ask for: the largest lag and one."""
    lags = [int(m[1]) for n in names if (m := re.search(r"_tminus(\d+)$", n))]
    return max(lags, default=0) + 1


def ready(df: DataFrame, mode: str = "train", window: int = 1, features: list[str] | None = None, blacklist: set[str] = frozenset(), close: str = "close", drop_last_row: bool = False, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """series, time, close, y and the features, lagged if ``window`` > 1.

    ``train`` labels rows, leaves out the last and flat days; ``predict`` keeps all (or leaves out the newest).  Features may be base or lag names.
    """
    df = df.withColumnRenamed(close, "close") if close != "close" else df
    df = label_next_up(df, keys, order, keep_last=mode != "train")
    if mode == "train":
        df = drop_flat_days(df, keys, order)
    window = max(window, window_of(features or []))
    base = list(dict.fromkeys(re.sub(r"_tminus\d+$", "", f) for f in features)) if features else feature_columns(df, keys, order, blacklist)
    df = df.select(*keys, order, "close", "y", *[k for k in base if k not in blacklist])
    base = [k for k in base if k not in blacklist]
    if window > 1:
        df = stack_lags(df, base, window, keys, order)
        if features and any("_tminus" in f for f in features):
            df = df.select(*keys, order, "close", "y", *features)
    return drop_last(df, keys, order) if mode != "train" and drop_last_row else df
