"""Stable windowed features (G1-G19): ratios, entropies and spectra of lagged inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barspark.functions import windows as x
from barspark.operators.scan import with_halo

c = F.col
#: Frame lengths of each timeframe: fixed values.
WINDOWS = {"5T": (8, 16, 32), "15T": (6, 12, 24), "30T": (5, 10, 20), "1H": (4, 8, 16)}
#: Decomposition high-pass filter of the Daubechies wavelet with two vanishing moments: fixed values.
DB2_HIGH = (-0.48296291314453416, 0.8365163037378079, -0.2241438680420134, -0.12940952255126037)


def add_inputs(df: DataFrame, w: WindowSpec, log_price: bool = True, row: Column | None = None) -> DataFrame:
    """The inputs look back on two rows.  row: the row number, if it is known."""
    price = F.ln("close") if log_price else c("close")
    df = df.withColumns({"c_lag": x.shift(c("close"), w), "v_lag": x.shift(c("volume"), w), "__p": price})
    df = df.withColumns({"p_lag": x.shift(c("__p"), w), "__d": x.diff(c("__p"), w), "row": F.row_number().over(w) if row is None else row})
    df = df.withColumns({"ret": x.shift(c("__d"), w), "d_close": x.diff(c("c_lag"), w), "d_volume": x.diff(c("v_lag"), w)})
    return df.withColumns(
        {
            "ret2": c("ret") * c("ret"),
            "up": F.when(c("ret") > 0, 1.0).otherwise(0.0),
            "down": F.when(c("ret") < 0, 1.0).otherwise(0.0),
            "up2": F.pow(F.greatest(c("ret"), F.lit(0.0)), 2.0),
            "down2": F.pow(F.least(c("ret"), F.lit(0.0)), 2.0),
            "tick_imbalance": F.signum("d_close"),
            "volume_imbalance": c("v_lag") * F.signum("d_volume"),
            "microprice": c("c_lag") + c("d_close") / 2,
            "signed_volume": F.signum("d_close") * c("v_lag"),
            "abs_d": F.abs("d_close"),
            "toxic": F.abs(F.signum("ret") * c("v_lag")),
        }
    ).drop("__p", "__d")


def _spectrum(values: Column, n: int) -> Column:
    """Power of the demeaned values at each frequency from 1 to half the length, by the definition of the transform."""
    size = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / size
    placed = F.transform(values, lambda v, i: F.struct((v - mean).alias("v"), i.cast("double").alias("i")))
    turn = 2 * math.pi

    def power(k: Column) -> Column:
        wave = lambda f: F.aggregate(placed, F.lit(0.0), lambda s, p: s + p["v"] * f(F.lit(turn) * k * p["i"] / size))
        return F.pow(wave(F.cos), 2.0) + F.pow(wave(F.sin), 2.0)

    return F.transform(F.sequence(F.lit(1), F.floor(size / 2).cast("int")), power)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def spectral(values: Column, n: int, power: Column | None = None) -> dict[str, Column]:
    """Share of the energy above a quarter of the sampling rate, dominant frequency and entropy of the spectrum; null below 4 values.

    power: the spectrum as a column of its own, so that it is computed once.
    """
    power, size = _spectrum(values, n) if power is None else power, F.size(values)
    total = _sum(power)
    high = _sum(F.transform(power, lambda p, i: F.when((i + 1) / size > 0.25, p).otherwise(0.0)))
    share = F.transform(power, lambda p: p / (total + 1e-12))
    enough = size >= 4
    return {
        "fft_energy_ratio": F.when(enough, high / (total + 1e-12)),
        "fft_dom_freq": F.when(enough, F.array_position(power, F.array_max(power)) / size),
        "spectral_entropy": F.when(enough, -_sum(F.transform(share, lambda p: p * F.ln(p + 1e-12))) / F.ln(F.size(power) + 1e-12)),
    }


def wavelet_energy(values: Column) -> Column:
    """Energy of one level of detail with mirrored ends; null below 8 values."""
    size = F.size(values)
    padded = F.concat(F.reverse(F.slice(values, 1, 3)), values, F.reverse(F.slice(values, -3, 3)))
    places = F.sequence(F.lit(0), F.floor((size + 3) / 2).cast("int") - 1)

    def detail(k: Column) -> Column:
        at = 2 * k + 4
        return F.pow(sum((F.lit(h) * F.get(padded, (at - j).cast("int")) for j, h in enumerate(DB2_HIGH)), F.lit(0.0)), 2.0)

    return F.when(size >= 8, _sum(F.transform(places, detail)))


def features(n: int, w: WindowSpec) -> tuple[dict[str, Column], ...]:
    """The features of one frame length over the inputs, level by level; one sort serves all of them."""
    up = x.over_frame(F.avg, c("up"), n, w)
    clipped = F.greatest(F.least(c(f"up_ratio_{n}"), F.lit(1 - 1e-6)), F.lit(1e-6))
    first = {
        f"trend_slope_{n}": x.rolling_slope(c("p_lag"), c("row"), n, w),
        f"realized_vol_{n}": F.sqrt(x.rolling_sum(c("ret2"), n, w)),
        f"up_ratio_{n}": up,
        f"ret_vol_corr_{n}": x.rolling_corr(c("ret"), c("v_lag"), n, w),
        f"pos_in_channel_{n}": x.pos_in_channel(c("c_lag"), n, w),
        f"zscore_close_{n}": x.zscore(c("c_lag"), n, w),
        f"zscore_volume_{n}": x.zscore(c("v_lag"), n, w),
        f"semi_up_vol_{n}": F.sqrt(x.rolling_sum(c("up2"), n, w)),
        f"semi_down_vol_{n}": F.sqrt(x.rolling_sum(c("down2"), n, w)),
        f"orderflow_imbalance_{n}": x.rolling_sum(c("signed_volume"), n, w) / (x.rolling_sum(c("v_lag"), n, w) + 1e-9),
        f"efficient_price_{n}": x.rolling_sum(c("d_close"), n, w) / (x.rolling_sum(c("abs_d"), n, w) + 1e-12),
        f"vpin_{n}": x.rolling_sum(c("toxic"), n, w) / (x.rolling_sum(c("v_lag"), n, w) + 1e-9),
        f"signal_consistency_{n}": F.coalesce(up - x.over_frame(F.avg, c("down"), n, w), F.lit(0.0)),
        f"vol_norm_disagreement_{n}": F.coalesce(x.rolling_std(c("ret"), n, w) / (F.abs(x.rolling_mean(c("ret"), n, w)) + 1e-12), F.lit(0.0)),
        f"stability_confidence_{n}": 1 / (1 + F.abs(x.rolling_slope(c("c_lag"), c("row"), n, w))),
        f"__frame_{n}": F.collect_list(F.col("ret")).over(x.frame(w, n)),
    }
    second = {f"dir_entropy_{n}": -(clipped * F.log2(clipped) + (1 - clipped) * F.log2(1 - clipped))}
    second |= {f"__power_{n}": _spectrum(c(f"__frame_{n}"), n), f"wavelet_energy_{n}": wavelet_energy(c(f"__frame_{n}"))}
    third = {f"{k}_{n}": v for k, v in spectral(c(f"__frame_{n}"), n, c(f"__power_{n}")).items()}
    return first, second, third


NAMES = (
    "trend_slope realized_vol up_ratio dir_entropy ret_vol_corr pos_in_channel zscore_close zscore_volume semi_up_vol semi_down_vol orderflow_imbalance efficient_price vpin "
    "fft_energy_ratio fft_dom_freq spectral_entropy wavelet_energy signal_consistency vol_norm_disagreement stability_confidence"
).split()
PROTOTYPE = ("trend_slope", "realized_vol", "up_ratio", "dir_entropy", "ret_vol_corr")


def add_stable_features(df: DataFrame, tf: str | None = None, lengths: tuple[int, ...] | None = None, keys: tuple[str, ...] = ("symbol",), order: str = "time", log_price: bool = True, names: tuple[str, ...] | list[str] = NAMES, chunk: int | None = None) -> DataFrame:
    """Adds ``<name>_<length>`` for each frame length, and the three imbalances; a timeframe gives its usual lengths.

    With ``chunk``, long series are cut into chunks of so many rows, led by the rows that the features look back on.
    """
    w = x.series(*keys, order=order)
    have = df.columns
    lengths = lengths or WINDOWS[tf]
    if chunk:
        df = with_halo(df, max(lengths) + 1, chunk, keys, order, row="__row").withColumnsRenamed({"chunk": "__chunk", "halo": "__halo"})
        w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    df = add_inputs(df, w, log_price, c("__row") if chunk else None)
    for level in zip(*[features(n, w) for n in lengths], strict=True):
        df = df.withColumns({k: v for part in level for k, v in part.items()})
    df = df.filter("NOT __halo") if chunk else df
    imbalances = ["tick_imbalance", "volume_imbalance", "microprice"] if "vpin" in names else []
    return df.select(*have, *imbalances, *[f"{k}_{n}" for n in lengths for k in names])


def add_prototype_features(df: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    return add_stable_features(df, tf, keys=keys, order=order, names=PROTOTYPE)
