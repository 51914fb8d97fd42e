"""The training frame (H9): every timeframe's features on the main timeframe's clock, as one lazy plan."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.indicators import build_indicators
from barspark.functions.stable import WINDOWS, add_stable_features
from barspark.operators.align import merge_timeframes, safe_resample
from barspark.operators.clean import add_calendar, finite_ffill, numeric_columns, repair_outliers, signed_log1p, trim_from
from barspark.operators.stats import unstable_columns
from barspark.sources.bars import duration
from barspark.storage import shared_folder, stored

PRICES = ("open", "high", "low", "close", "volume")


def timeframe_features(bars: DataFrame, tf: str, start=None, resample: bool = True, keys: tuple[str, ...] = ("symbol",), order: str = "time", only: tuple[str, ...] | None = None, stable: bool = True) -> DataFrame:
    """Bars of one timeframe, their closes repaired, with indicators, log volumes, stable features and the calendar; names without the timeframe's prefix.

    ``start`` is applied before any window.  Indicators that often end in zero or null are left out.  ``resample`` keeps closed rows only,
    all columns alike.  ``only`` names the indicators to build, all by default; stable features can be left out.
    """
    if start is not None:
        bars = trim_from(bars, start, order)
    bars = repair_outliers(bars, "close", keys=keys, order=order).withColumn("close", F.col("close_fixed"))
    built = build_indicators(bars.select(*keys, order, *PRICES), tf, keys, order, only=only)
    built = built.select(*keys, order, *[F.col(k).alias(k[len(tf) + 1 :]) for k in built.columns if k not in (*keys, order)])
    built = stored(built, "indicators")  # a wide plan is cut where it is cheapest: a row per bar
    built = finite_ffill(built, [k for k in numeric_columns(built) if k not in PRICES], False, keys, order)
    made = [k for k in numeric_columns(built) if k not in (*keys, *PRICES)]
    gone = {r["feature"] for r in unstable_columns(built, made, keys=keys, order=order).filter("unstable").collect()}  # column names
    built = built.drop(*gone)
    if resample:
        built = safe_resample(built, duration(tf), tuple(k for k in built.columns if k not in (*keys, order, *PRICES)), keys, order)
    built = signed_log1p(built)
    if stable:
        built = add_stable_features(built, tf, WINDOWS[tf], keys, order)
    return stored(add_calendar(built, 1, keys, order), "features")


def feature_frame(bars: dict[str, DataFrame], main: str = "30T", start=None, resample: bool = True, keys: tuple[str, ...] = ("symbol",), order: str = "time", only: tuple[str, ...] | None = None, stable: bool = True) -> DataFrame:
    """The features of every timeframe, named by it, on the main timeframe's rows.

    Timeframes do not depend on one another, so their jobs run side by side: one's plans are made while another's tasks run.
    """
    spark = bars[main].sparkSession
    shared_folder(spark)  # set before the threads start, so that all of them use one
    make = inheritable_thread_target(spark)(lambda tf: timeframe_features(bars[tf], tf, start, resample, keys, order, only, stable))
    with ThreadPoolExecutor(len(bars)) as pool:
        frames = dict(zip(bars, pool.map(make, bars), strict=True))
    return merge_timeframes(frames.pop(main), frames, main, keys, order)
