"""Technical indicators (F1-F56) as named expressions over the window primitives.

Inputs are the bars' columns.  Names without a suffix are values at their own row; :func:`add_indicators` can shift a set by a bar, as the
training frame does.  Division guards follow each formula: an epsilon where it has one, else null for a zero divisor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barspark.functions import windows as x
from barspark.functions.registry import USER, Feature, Registry
from barspark.operators.ranges import same
from barspark.operators.scan import number_rows, rma_alpha, span_alpha
from barspark.storage import stored

R = Registry()
c = F.col
div = F.try_divide
EPS = 1e-9


def lag(name: str, k: int = 1):
    return lambda w: x.shift(c(name), w, k)


def mean(name: str, n: int, least: int | None = None):
    return lambda w: x.rolling_mean(c(name), n, w, least)


# shared inputs
R.add("one", "", lambda w: F.lit(1))
R.running("row", "one", "count")
R.add("prev_close", "close", lag("close"))
R.add("prev_high", "high", lag("high"))
R.add("prev_low", "low", lag("low"))
R.add("tp", "", lambda w: (c("high") + c("low") + c("close")) / 3)
R.add("prev_tp", "tp", lag("tp"))
R.add("mid", "", lambda w: (c("high") + c("low")) / 2)
R.add("hl", "", lambda w: c("high") - c("low"))
R.add("delta", "prev_close", lambda w: c("close") - c("prev_close"))
R.add("ret", "prev_close", lambda w: div(c("close"), c("prev_close")) - 1)
R.add("log_ret", "prev_close", lambda w: x.ln(c("close")) - x.ln(c("prev_close")))
R.add("clv", "", lambda w: div((c("close") - c("low")) - (c("high") - c("close")), c("hl_")))
R.add("hl_", "", lambda w: F.nullif(c("high") - c("low"), F.lit(0.0)))
R.add("clv", "hl_", lambda w: F.coalesce(((c("close") - c("low")) - (c("high") - c("close"))) / c("hl_"), F.lit(0.0)))
R.add("clv_volume", "clv", lambda w: c("clv") * c("volume"))
R.add("true_range", "prev_close", lambda w: F.greatest(c("high") - c("low"), F.abs(c("high") - c("prev_close")), F.abs(c("low") - c("prev_close"))))

# volume
R.add("flow_up", "tp prev_tp", lambda w: F.when(c("tp") > c("prev_tp"), c("tp") * c("volume")).otherwise(0.0))
R.add("flow_down", "tp prev_tp", lambda w: F.when(c("tp") < c("prev_tp"), c("tp") * c("volume")).otherwise(0.0))
R.add("mfi", "flow_up flow_down", lambda w: 100 - 100 / (1 + div(x.rolling_sum(c("flow_up"), 14, w), x.rolling_sum(c("flow_down"), 14, w))))
R.running("adi", "clv_volume", "sum")
R.add("obv_step", "delta", lambda w: F.when(c("delta") >= 0, c("volume")).when(c("delta") < 0, -c("volume")))
R.running("obv_sum", "obv_step", "sum")
R.add("obv", "obv_step obv_sum", lambda w: F.when(c("obv_step").isNotNull(), c("obv_sum")))
R.add("cmf", "clv_volume", lambda w: div(x.rolling_sum(c("clv_volume"), 20, w), x.rolling_sum(c("volume"), 20, w)))
R.add("force_index", "delta", lambda w: c("delta") * c("volume"))
R.add("mid_delta", "mid", lambda w: x.diff(c("mid"), w))
R.add("eom_step", "mid_delta hl", lambda w: div(c("mid_delta") * c("hl"), c("volume")))
R.add("eom", "eom_step", mean("eom_step", 14))
R.add("vpt_step", "ret", lambda w: c("volume") * c("ret"))
R.running("vpt_sum", "vpt_step", "sum")
R.add("vpt", "vpt_step vpt_sum", lambda w: F.when(c("vpt_step").isNotNull(), c("vpt_sum")))
R.add("prev_volume", "volume", lag("volume"))
R.add("nvi", "ret prev_volume", lambda w: F.when(c("volume") < c("prev_volume"), 1000.0 * (1 + c("ret"))).otherwise(1000.0))
R.add("tp_volume", "tp", lambda w: c("tp") * c("volume"))
R.running("tp_volume_sum", "tp_volume", "sum")
R.running("volume_sum", "volume", "sum")
R.add("vwap", "tp_volume_sum volume_sum", lambda w: div(c("tp_volume_sum"), c("volume_sum")))
R.add("close_volume", "", lambda w: c("close") * c("volume"))
R.running("close_volume_sum", "close_volume", "sum")
R.add("vwap_close", "close_volume_sum volume_sum", lambda w: div(c("close_volume_sum"), c("volume_sum")))
R.add("vroc", "volume", lambda w: (c("volume") - x.shift(c("volume"), w, 20)) / (x.shift(c("volume"), w, 20) + EPS) * 100)
R.add("volume_ratio", "volume", lambda w: div(c("volume"), x.rolling_mean(c("volume"), 10, w)))

# bands and channels
R.add("atr", "true_range", mean("true_range", 14))
R.add("sma20", "close", mean("close", 20))
R.add("std20", "close", lambda w: x.rolling_std(c("close"), 20, w))
R.add("bb_high", "sma20 std20", lambda w: c("sma20") + 2 * c("std20"))
R.add("bb_low", "sma20 std20", lambda w: c("sma20") - 2 * c("std20"))
R.add("bb_width", "bb_high bb_low", lambda w: c("bb_high") - c("bb_low"))
R.add("bb_width_ratio", "bb_width sma20", lambda w: div(c("bb_width"), c("sma20")))
R.mean("ema20", "close", span_alpha(20))
R.add("keltner_high", "ema20 atr", lambda w: c("ema20") + 2 * c("atr"))
R.add("keltner_low", "ema20 atr", lambda w: c("ema20") - 2 * c("atr"))
R.add("donchian_high", "high", lambda w: x.rolling_max(c("high"), 20, w))
R.add("donchian_low", "low", lambda w: x.rolling_min(c("low"), 20, w))
R.running("peak", "close", "max")
R.add("drawdown2", "peak", lambda w: F.pow(100 * (c("close") - c("peak")) / c("peak"), 2.0))
R.add("ulcer", "drawdown2", lambda w: F.sqrt(x.rolling_mean(c("drawdown2"), 14, w)))

# trend
for n in (10, 50):
    R.add(f"sma{n}", "close", mean("close", n))
for n in (10, 50, 12, 26):
    R.mean(f"ema{n}", "close", span_alpha(n))
R.add("sma_diff", "sma10 sma50", lambda w: c("sma10") - c("sma50"))
R.add("ema_diff", "ema10 ema50", lambda w: c("ema10") - c("ema50"))
R.add("wma20", "row", lambda w: x.wma(c("close"), c("row"), 20, w))
R.add("macd", "ema12 ema26", lambda w: c("ema12") - c("ema26"))
R.mean("macd_signal", "macd", span_alpha(9))
R.add("macd_hist", "macd macd_signal", lambda w: c("macd") - c("macd_signal"))
R.add("up_move", "high", lambda w: x.diff(c("high"), w))
R.add("down_move", "low", lambda w: x.shift(c("low"), w, -1) - c("low"))
R.add("plus_dm", "up_move down_move", lambda w: F.when((c("up_move") > c("down_move")) & (c("up_move") > 0), c("up_move")).otherwise(0.0))
R.add("minus_dm", "up_move down_move", lambda w: F.when((c("down_move") > c("up_move")) & (c("down_move") > 0), c("down_move")).otherwise(0.0))
for name in ("plus_dm", "minus_dm", "true_range"):
    R.mean(f"{name}_rma", name, rma_alpha(14))
R.add("plus_di", "plus_dm_rma true_range_rma", lambda w: 100 * div(c("plus_dm_rma"), c("true_range_rma")))
R.add("minus_di", "minus_dm_rma true_range_rma", lambda w: 100 * div(c("minus_dm_rma"), c("true_range_rma")))
R.add("dx", "plus_di minus_di", lambda w: 100 * div(F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")))
R.mean("adx", "dx", rma_alpha(14))
R.add("vm_plus", "prev_low", lambda w: F.abs(c("high") - c("prev_low")))
R.add("vm_minus", "prev_high", lambda w: F.abs(c("low") - c("prev_high")))
for s in ("plus", "minus"):
    R.add(f"vortex_{s}", f"vm_{s} true_range", lambda w, s=s: F.coalesce(x.rolling_sum(c(f"vm_{s}"), 14, w, 1) / (x.rolling_sum(c("true_range"), 14, w, 1) + EPS), F.lit(0.0)))
R.mean("trix1", "close", span_alpha(15))
R.mean("trix2", "trix1", span_alpha(15))
R.mean("trix3", "trix2", span_alpha(15))
R.add("trix", "trix3", lambda w: 100 * x.pct_change(c("trix3"), w))
R.mean("range_ema", "hl", span_alpha(9))
R.mean("range_ema2", "range_ema", span_alpha(9))
R.add("mass_step", "range_ema range_ema2", lambda w: div(c("range_ema"), c("range_ema2")))
R.add("mass_index", "mass_step", lambda w: x.rolling_sum(c("mass_step"), 25, w))
R.add("tp_sma20", "tp", mean("tp", 20))
R.add("tp_off", "tp tp_sma20", lambda w: F.abs(c("tp") - c("tp_sma20")))
R.add("cci", "tp tp_sma20 tp_off", lambda w: div(c("tp") - c("tp_sma20"), 0.015 * x.rolling_mean(c("tp_off"), 20, w)))
R.add("dpo", "sma20", lambda w: x.shift(c("close"), w, 11) - c("sma20"))
#: Rate-of-change spans, smoothing spans and weights of the know-sure-thing: fixed values.
KST = ((10, 10, 1), (15, 10, 2), (20, 10, 3), (30, 15, 4))
for n, _, _ in KST:
    R.add(f"roc_{n}", "close", lambda w, n=n: x.pct_change(c("close"), w, n))
R.add("kst", " ".join(f"roc_{n}" for n, _, _ in KST), lambda w: 100 * sum((k * x.rolling_mean(c(f"roc_{n}"), m, w) for n, m, k in KST), F.lit(0.0)))
R.add("kst_signal", "kst", mean("kst", 9))
R.add("kst_main", " ".join(f"roc_{n}" for n, _, _ in KST), lambda w: sum((k * x.rolling_mean(100 * c(f"roc_{n}"), m, w, 1) for n, m, k in KST), F.lit(0.0)))
R.add("kst_main_signal", "kst_main", mean("kst_main", 9, 1))
R.add("kst_main_diff", "kst_main kst_main_signal", lambda w: c("kst_main") - c("kst_main_signal"))

# momentum
R.add("gain", "delta", lambda w: F.when(c("delta").isNotNull(), F.greatest(c("delta"), F.lit(0.0))))
R.add("loss", "delta", lambda w: F.when(c("delta").isNotNull(), F.greatest(-c("delta"), F.lit(0.0))))
R.mean("gain_rma", "gain", rma_alpha(14))
R.mean("loss_rma", "loss", rma_alpha(14))


def _rsi(up: Column, down: Column) -> Column:
    return 100 - 100 / (1 + div(up, down))


R.add("rsi", "gain_rma loss_rma", lambda w: _rsi(c("gain_rma"), c("loss_rma")))
R.add("rsi_sma", "gain loss", lambda w: _rsi(x.rolling_mean(c("gain"), 14, w), x.rolling_mean(c("loss"), 14, w)))
for name in ("rsi", "rsi_sma"):
    R.add(
        f"stoch_{name}",
        name,
        lambda w, n=name: div(c(n) - x.rolling_min(c(n), 14, w), x.rolling_max(c(n), 14, w) - x.rolling_min(c(n), 14, w)),
    )
R.add("abs_delta", "delta", lambda w: F.abs("delta"))
for name in ("delta", "abs_delta"):
    R.mean(f"{name}_25", name, span_alpha(25))
    R.mean(f"{name}_25_13", f"{name}_25", span_alpha(13))
R.add("tsi", "delta_25_13 abs_delta_25_13", lambda w: 100 * div(c("delta_25_13"), c("abs_delta_25_13")))
R.add("buying", "prev_close", lambda w: c("close") - F.least(c("low"), c("prev_close")))
R.add("reach", "prev_close", lambda w: F.greatest(c("high"), c("prev_close")) - F.least(c("low"), c("prev_close")))
R.add(
    "ultimate_osc",
    "buying reach",
    lambda w: sum((k * div(x.rolling_sum(c("buying"), n, w), x.rolling_sum(c("reach"), n, w)) for n, k in ((7, 4), (14, 2), (28, 1))), F.lit(0.0)) * 100 / 7,
)
R.add("low14", "low", lambda w: x.rolling_min(c("low"), 14, w))
R.add("high14", "high", lambda w: x.rolling_max(c("high"), 14, w))
R.add("stoch_k", "low14 high14", lambda w: 100 * div(c("close") - c("low14"), c("high14") - c("low14")))
R.add("stoch_d", "stoch_k", mean("stoch_k", 3))
R.add("williams_r", "low14 high14", lambda w: -100 * (c("high14") - c("close")) / (c("high14") - c("low14") + EPS))
R.add("ao", "mid", lambda w: x.rolling_mean(c("mid"), 5, w) - x.rolling_mean(c("mid"), 34, w))
R.add("roc10", "close", lambda w: 100 * x.pct_change(c("close"), w, 10))
R.add("roc1", "ret", lambda w: 100 * c("ret"))
for name, source in (("ppo", "close"), ("pvo", "volume")):
    for n in (12, 26):
        R.mean(f"{source}_ema{n}", source, span_alpha(n))
    R.add(name, f"{source}_ema12 {source}_ema26", lambda w, s=source: 100 * div(c(f"{s}_ema12") - c(f"{s}_ema26"), c(f"{s}_ema26")))
    R.mean(f"{name}_signal", name, span_alpha(9))
    R.add(f"{name}_hist", f"{name} {name}_signal", lambda w, n=name: c(n) - c(f"{n}_signal"))
R.add("momentum", "close", lambda w: x.diff(c("close"), w, 14))

# returns and volatility
R.add("daily_ret", "ret", lambda w: 100 * c("ret"))
R.add("daily_logret", "log_ret", lambda w: 100 * c("log_ret"))
R.add("growth", "ret", lambda w: 1 + F.coalesce(c("ret"), F.lit(0.0)))
R.add("growth_log", "growth", lambda w: x.ln(c("growth")))
R.running("growth_sum", "growth_log", "sum")
R.add("cum_ret", "growth_sum", lambda w: 100 * (F.exp("growth_sum") - 1))
R.add("daily_range", "hl", lambda w: c("hl"))
R.add("hv", "log_ret", lambda w: x.rolling_std(c("log_ret"), 20, w) * math.sqrt(24 * 365))
R.add("gk_step", "", lambda w: 0.5 * F.pow(x.ln(x.ratio(c("high"), c("low"))), 2.0) - (2 * math.log(2) - 1) * F.pow(x.ln(x.ratio(c("close"), c("open"))), 2.0))
R.add("garman_klass", "gk_step", mean("gk_step", 20))
R.add("park_step", "", lambda w: F.pow(x.ln(x.ratio(c("high"), c("low"))), 2.0))
R.add("parkinson", "park_step", lambda w: F.sqrt(x.rolling_sum(c("park_step"), 20, w) / (4 * math.log(2) * 20)))

# lagged positions and copies
R.add("kc_percent", "prev_close keltner_low keltner_high", lambda w: div(c("prev_close") - x.shift(c("keltner_low"), w), x.shift(c("keltner_high"), w) - x.shift(c("keltner_low"), w)))
R.add("dc_percent", "prev_close donchian_low donchian_high", lambda w: div(c("prev_close") - x.shift(c("donchian_low"), w), x.shift(c("donchian_high"), w) - x.shift(c("donchian_low"), w)))
R.add("bb_percent", "prev_close bb_low bb_high", lambda w: div(c("prev_close") - x.shift(c("bb_low"), w), x.shift(c("bb_high"), w) - x.shift(c("bb_low"), w)))
R.add("trend_cci_raw", "tp tp_sma20 tp_off", lambda w: (c("tp") - c("tp_sma20")) / (0.015 * x.rolling_mean(c("tp_off"), 20, w) + EPS))
R.add("trend_cci", "trend_cci_raw", lag("trend_cci_raw"))
for name in ("force_index", "obv", "adi"):
    R.add({"force_index": "volume_fi"}.get(name, f"volume_{name}"), name, lag(name))
R.add("pivot", "tp", mean("tp", 1))
R.add("pivot_lag5", "tp", lag("tp", 5))
R.add("ma20_lag", "sma20", lag("sma20"))
R.add("return_difference", "ret", lambda w: c("ret") - x.shift(c("ret"), w))
R.add("momentum_roc", "roc10", lag("roc10"))
for n in (5, 10, 20):
    for kind, make in (("sma", x.rolling_mean), ("std", x.rolling_std), ("min", x.rolling_min), ("max", x.rolling_max)):
        R.add(f"lag_{kind}_{n}", "prev_close", lambda w, n=n, make=make: make(c("prev_close"), n, w))
    R.add(f"lag_volume_sma_{n}", "prev_volume", lambda w, n=n: x.rolling_mean(c("prev_volume"), n, w))
    R.add(f"lag_volume_ratio_{n}", f"prev_volume lag_volume_sma_{n}", lambda w, n=n: div(c("prev_volume"), c(f"lag_volume_sma_{n}")))

# patterns and shapes
R.add("pivot_p", "tp", lambda w: c("tp"))
R.add("pivot_s1", "tp", lambda w: 2 * c("tp") - c("high"))
R.add("pivot_r1", "tp", lambda w: 2 * c("tp") - c("low"))
R.add("pivot_s2", "tp hl", lambda w: c("tp") - c("hl"))
R.add("pivot_r2", "tp hl", lambda w: c("tp") + c("hl"))
for name, n in (("conv", 9), ("base", 26), ("span_b", 52)):
    R.add(f"ichimoku_{name}", "", lambda w, n=n: (x.rolling_max(c("high"), n, w) + x.rolling_min(c("low"), n, w)) / 2)
R.add("ichimoku_span_a", "ichimoku_conv ichimoku_base", lambda w: (c("ichimoku_conv") + c("ichimoku_base")) / 2)
for s in ("a", "b"):
    R.add(f"ichimoku_span_{s}_26", f"ichimoku_span_{s}", lag(f"ichimoku_span_{s}", 26))
R.add("prev_open", "open", lag("open"))
R.add(
    "engulfing",
    "prev_open prev_close",
    lambda w: F.when((c("close") > c("open")) & (c("prev_close") < c("prev_open")) & (c("close") > c("prev_open")) & (c("open") < c("prev_close")), 1)
    .when((c("close") < c("open")) & (c("prev_close") > c("prev_open")) & (c("close") < c("prev_open")) & (c("open") > c("prev_close")), -1)
    .otherwise(0),
)
R.add("doji", "", lambda w: F.when(F.abs(c("close") - c("open")) / (c("high") - c("low") + EPS) < 0.1, 1).otherwise(0))
R.add("ha_close", "", lambda w: (c("open") + c("high") + c("low") + c("close")) / 4)
R.add("ha_open", "ha_close", lambda w: x.shift(c("ha_close"), w))
R.add("range_close_ratio", "hl", lambda w: div(c("hl"), c("close")))
R.mean("ema13", "close", span_alpha(13))
R.add("bull_power", "ema13", lambda w: c("high") - c("ema13"))
R.add("rsi_macd", "rsi macd", lambda w: c("rsi") * c("macd"))
R.add("ma_ratio", "sma10 sma50", lambda w: div(c("sma10"), c("sma50")))
R.add("candle_height", "hl", lambda w: c("hl"))
R.add("candle_body", "", lambda w: F.abs(c("close") - c("open")))
R.add("upper_shadow", "", lambda w: c("high") - F.greatest("open", "close"))
R.add("lower_shadow", "", lambda w: F.least("open", "close") - c("low"))
R.add("price_to_ma", "sma20", lambda w: div(c("close"), c("sma20")))
R.add("pct_change", "ret", lambda w: 100 * c("ret"))
R.add("rise", "delta", lambda w: F.when(c("delta") > 0, 1).when(c("delta").isNotNull(), 0))

#: The training frame's three builders (their outputs are shifted by a bar) and the block that is not: names in order of precedence.
BUILDER = (
    "mfi adi obv cmf force_index eom vpt nvi vwap atr sma20 bb_high bb_low bb_width bb_width_ratio ema20 keltner_high keltner_low donchian_high donchian_low ulcer "
    "sma10 sma50 ema10 ema50 sma_diff ema_diff wma20 macd macd_signal macd_hist adx vortex_plus vortex_minus trix mass_index cci dpo kst kst_signal "
    "rsi stoch_rsi tsi ultimate_osc stoch_k stoch_d williams_r ao roc10 ppo ppo_signal pvo pvo_signal daily_ret daily_logret cum_ret momentum hv garman_klass parkinson"
).split()
LAGGED = "kc_percent dc_percent bb_percent trend_cci volume_fi volume_obv volume_adi pivot_lag5 ma20_lag return_difference momentum_roc".split()
CUSTOM = (
    "kst_main kst_main_signal kst_main_diff vortex_plus vortex_minus ichimoku_conv ichimoku_base ichimoku_span_a ichimoku_span_b williams_r vroc engulfing doji ha_open ha_close "
    "range_close_ratio bull_power pivot_p pivot_s1 pivot_s2 pivot_r1 pivot_r2"
).split()


def add_indicators(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("symbol",), order: str = "time", shifted: bool = False, chunk: int | None = None) -> DataFrame:
    """Adds the named indicators, users' own ones included; ``shifted`` moves them one bar back, so that a row only knows closed bars.

    Without it ``adx`` looks at the next bar's low, as its formula does.  With ``chunk``, long series are cut into chunks of so many rows that
    start with the rows that they look back on; the values are the same.
    """
    own = Registry()
    own.features = {**R.features, **USER.features}
    if not shifted:
        return own.build(df, names, keys, order, chunk=chunk)
    later = {f"__later_{n}": Feature(f"__later_{n}", (n,), lag(n)) for n in names}
    own.features |= later
    out = own.build(df, list(later), keys, order, chunk=chunk)
    return out.drop(*[n for n in names if n in df.columns]).withColumnsRenamed({f"__later_{n}": n for n in names})


def build_indicators(df: DataFrame, tf: str, keys: tuple[str, ...] = ("symbol",), order: str = "time", chunk: int | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """The whole set with the timeframe as prefix: builders shifted, the lagged and custom blocks as they are; a name of both is the custom one.

    ``only`` names the indicators to build, such as those that a model was trained on; their values are those of the whole set.
    """
    wanted = lambda names: [n for n in names if only is None or n in only]
    builder, others = wanted(n for n in BUILDER if n not in CUSTOM), wanted([*LAGGED, *CUSTOM])
    if unknown := set(only or ()) - {*builder, *others}:
        raise KeyError(f"no indicators {sorted(unknown)}")
    out = add_indicators(df, builder, keys, order, shifted=True, chunk=chunk)
    if others:
        # the other blocks start from the bars again, so that they do not build on shifted columns
        out = out.join(add_indicators(df, others, keys, order, chunk=chunk).select(*keys, order, *others), [*keys, order])
    return out.select(*keys, order, *[F.col(n).alias(f"{tf}_{n}") for n in ("open", "high", "low", "close", "volume", *builder, *others)])


def kama(df: DataFrame, name: str = "kama", n: int = 10, fast: int = 2, slow: int = 30, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """Kaufman's adaptive mean, seeded with the close at the first efficiency ratio."""
    from barspark.operators.scan import varying_scan

    w = x.series(*keys, order=order)
    df = df.withColumns({"__step": F.abs(x.diff(c("close"), w)), "__way": F.abs(x.diff(c("close"), w, n))})
    ratio = div(c("__way"), x.rolling_sum(c("__step"), n, w))
    speed = F.pow(ratio * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1), 2.0)
    df = df.withColumn("__sc", speed)
    df = df.withColumn("__first", F.min(F.when(c("__sc").isNotNull(), c(order))).over(x.running(w)))
    df = df.withColumns(
        {
            "__a": F.when(c(order) > c("__first"), 1 - F.coalesce("__sc", F.lit(0.0))),
            "__b": F.when(c(order) == c("__first"), c("close")).when(c(order) > c("__first"), F.coalesce(c("__sc") * c("close"), F.lit(0.0))),
        }
    )
    df = df.withColumn("__start", c("__b").isNotNull()).fillna(0.0, ["__b"])
    out = varying_scan(df, name, "__a", "__b", keys, order)
    return out.withColumn(name, F.when(c("__start"), c(name))).drop("__step", "__way", "__sc", "__first", "__a", "__b", "__start")


def _stops(highs, lows, state: tuple, step: float, most: float) -> tuple[list[float], tuple]:
    """The stops of rows that follow on a state (rising, rate, extreme, stop), and the state after them; a stop of None starts a series."""
    rising, rate, extreme, stop = state
    out = []
    for high, low in zip(highs, lows, strict=True):
        if stop is None:
            stop, extreme = low, high
        else:
            stop += rate * (extreme - stop)
            if low < stop if rising else high > stop:
                rising, stop, rate = not rising, extreme, step
                extreme = high if rising else low
            elif (high > extreme) if rising else (low < extreme):
                extreme, rate = (high if rising else low), min(rate + step, most)
        out.append(stop)
    return out, (rising, rate, extreme, stop)


def parabolic_sar(df: DataFrame, step: float = 0.018, most: float = 0.2, keys: tuple[str, ...] = ("symbol",), order: str = "time", name: str = "psar", chunk: int = 2048) -> DataFrame:
    """Stop-and-reverse, a branching state machine, by speculation on chunks of a series.

    Every chunk runs from a guess, as if the series began there, rising.  After a reversal or two the path no longer knows where it began, so
    the state at a chunk's end is mostly right at once.  Chunks are then linked: a chunk whose state before was another than it had run from
    runs again, until no state changes; the first chunks of a series are right from the start, so this ends.  Only keys, row number, high
    and low reach Python, a chunk at a time.
    """
    import pandas as pd

    kinds = dict(df.dtypes)
    by = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    state = "rising boolean, rate double, extreme double, stop double"
    rows = stored(number_rows(df, keys, order, "__row").withColumn("__chunk", F.floor((F.col("__row") - 1) / chunk)), "psar")
    bars = rows.select(*keys, "__chunk", "__row", "high", "low")
    names = ["rising", "rate", "extreme", "stop"]

    def run(part: pd.DataFrame) -> tuple[pd.DataFrame, list[float], tuple]:
        part = part.sort_values("__row")
        first = part.iloc[0]
        begin = (True, step, None, None) if pd.isna(first["stop"]) else (bool(first["rising"]), first["rate"], first["extreme"], first["stop"])
        return part, *_stops(part["high"].tolist(), part["low"].tolist(), begin, step, most)

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        part, _, end = run(part)
        return pd.DataFrame([[*part.iloc[0][[*keys, "__chunk"]], *end]], columns=[*keys, "__chunk", *names])

    def stops(part: pd.DataFrame) -> pd.DataFrame:
        part, out, _ = run(part)
        part[name] = out
        return part[[*keys, "__row", name]]

    def following(found: DataFrame) -> DataFrame:
        """The states before chunks, from those after the chunks before."""
        return found.select(*keys, (F.col("__chunk") + 1).alias("__chunk"), *names)

    chunks = [*keys, "__chunk"]
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(names, ("boolean", "double", "double", "double"), strict=True)]
    found = stored(bars.select("*", *none).groupBy(*chunks).applyInPandas(ends, f"{by}, __chunk long, {state}"), "psar-ends")
    ran = found.select(*chunks, *none)  # what each chunk has run from
    while True:
        before = same(found.select(*chunks), following(found), chunks)
        now = stored(before, "psar-starts")
        old = ran.select(*chunks, F.struct(*names).alias("__old"))
        wrong = same(now, old, chunks).filter(~F.struct(*names).eqNullSafe(F.col("__old"))).drop("__old")
        again = stored(wrong, "psar-again")
        if again.isEmpty():
            break
        rerun = same(bars, again, chunks, "inner").groupBy(*chunks).applyInPandas(ends, f"{by}, __chunk long, {state}")
        found = stored(same(found, again.select(*chunks), chunks, "left_anti").unionByName(rerun), "psar-ends")
        ran = now
    out = same(bars, now, chunks).groupBy(*chunks).applyInPandas(stops, f"{by}, __row long, `{name}` double")
    return same(rows, out, [*keys, "__row"]).drop("__row", "__chunk")
