"""Queries of the window primitives, indicators and stable features, and SQL that says the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barspark.functions import indicators, stable, windows as x
from barspark.operators import ranges, scan
from barspark.plans import fixtures as fx

c = F.col

# --- SQL pieces ---

BARS = """bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL {m} MINUTE, ts) AS time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(value) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
)"""
W = "(PARTITION BY symbol ORDER BY time)"
RUN = "(PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"


def fr(n):
    return f"(PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def over(f, e, n, least=None):
    return f"CASE WHEN count({e}) OVER {fr(n)} >= {n if least is None else least} THEN {f}({e}) OVER {fr(n)} END"


def mean(e, n, least=None):
    return over("avg", e, n, least)


def total(e, n, least=None):
    return over("sum", e, n, least)


def top(e, n, least=None):
    return over("max", e, n, least)


def low(e, n, least=None):
    return over("min", e, n, least)


def std(e, n, least=None, f="stddev_samp"):
    return over(f, e, n, least)


def lag(e, k=1):
    return f"lag({e}, {k}) OVER {W}"


def run(f, e):
    return f"{f}({e}) OVER {RUN}"


def div(a, b):
    return f"(({a}) / nullif({b}, 0))"


def ema(e, a):
    return f"list_reduce(list({e}) FILTER (WHERE {e} IS NOT NULL) OVER {RUN}, lambda y, v: y + {a} * (v - y))"


def span(e, n):
    return ema(e, f"(2.0 / {n + 1})")


def rma(e, n):
    return ema(e, f"(1.0 / {n})")


def written(names, digits=6):
    return ", ".join(f"round(CAST({n} AS DOUBLE) * (1 + 1e-12), {digits}) + 0 AS {n}" for n in names)


def digits_for(layers):
    """Chunked recurrences differ from plain ones in the last bits, so fewer digits are compared."""
    return 4 if "list_reduce" in str(layers) else 6


def layered(layers, names, minutes=30, start="bars", digits=None):
    """CTEs that each add the columns of one layer, and the rounded result; with 0 digits, the result as it is."""
    parts, before = [BARS.format(m=minutes)], start
    for i, layer in enumerate(layers):
        parts.append(f"l{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {before})")
        before = f"l{i}"
    if digits == 0:
        return f"WITH {', '.join(parts)} SELECT symbol, time, {', '.join(names)} FROM {before}"
    return f"WITH {', '.join(parts)} SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {written(names, digits_for(layers))} FROM {before}"


PREV = {"pc": lag("close"), "ph": lag("high"), "pl": lag("low"), "po": lag("open"), "pv": lag("volume"), "tp": "(high + low + close) / 3", "mid": "(high + low) / 2", "hl": "high - low", "rn": f"row_number() OVER {W}"}
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
CLV = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
D, RET = "close - pc", "close / nullif(pc, 0) - 1"
ROC = {f"roc_{n}": f"close / nullif({lag('close', n)}, 0) - 1" for n in (10, 15, 20, 30)}
GAIN = {"gain": f"CASE WHEN {D} IS NOT NULL THEN greatest({D}, 0) END", "loss": f"CASE WHEN {D} IS NOT NULL THEN greatest(-({D}), 0) END"}
RSI = "100 - 100 / (1 + {})"

#: query -> (indicators, layers of SQL)
INDICATORS = {
    "f01_mfi": ("mfi", [PREV, {"ptp": lag("tp")}, {"u": "CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "d": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"}, {"mfi": f"100 - 100 / (1 + {div(total('u', 14), total('d', 14))})"}]),
    "f02_adi": ("adi", [{"s": f"{CLV} * volume"}, {"adi": run("sum", "s")}]),
    "f03_obv": ("obv", [PREV, {"s": f"CASE WHEN {D} >= 0 THEN volume WHEN {D} < 0 THEN -volume END"}, {"obv": f"CASE WHEN s IS NOT NULL THEN {run('sum', 's')} END"}]),
    "f04_cmf": ("cmf", [{"s": f"{CLV} * volume"}, {"cmf": div(total("s", 20), total("volume", 20))}]),
    "f05_force_index": ("force_index", [PREV, {"force_index": f"({D}) * volume"}]),
    "f06_eom": ("eom", [PREV, {"s": div(f"(mid - {lag('mid')}) * hl", "volume")}, {"eom": mean("s", 14)}]),
    "f07_vpt": ("vpt", [PREV, {"s": f"volume * ({RET})"}, {"vpt": f"CASE WHEN s IS NOT NULL THEN {run('sum', 's')} END"}]),
    "f08_nvi": ("nvi", [PREV, {"nvi": f"CASE WHEN volume < pv THEN 1000 * (1 + ({RET})) ELSE 1000.0 END"}]),
    "f09_vwap": ("vwap vwap_close", [PREV, {"a": "tp * volume", "b": "close * volume"}, {"vwap": div(run("sum", "a"), run("sum", "volume")), "vwap_close": div(run("sum", "b"), run("sum", "volume"))}]),
    "f10_atr": ("true_range atr", [PREV, {"true_range": TR}, {"atr": mean("true_range", 14)}]),
    "f11_bollinger": ("sma20 bb_high bb_low bb_width bb_width_ratio", [{"sma20": mean("close", 20), "s": std("close", 20)}, {"bb_high": "sma20 + 2 * s", "bb_low": "sma20 - 2 * s"}, {"bb_width": "bb_high - bb_low"}, {"bb_width_ratio": div("bb_width", "sma20")}]),
    "f12_keltner": ("ema20 keltner_high keltner_low", [PREV, {"t": TR, "ema20": span("close", 20)}, {"a": mean("t", 14)}, {"keltner_high": "ema20 + 2 * a", "keltner_low": "ema20 - 2 * a"}]),
    "f13_donchian": ("donchian_high donchian_low", [{"donchian_high": top("high", 20), "donchian_low": low("low", 20)}]),
    "f14_ulcer": ("ulcer", [{"k": run("max", "close")}, {"s": "pow(100 * (close - k) / k, 2)"}, {"ulcer": f"sqrt({mean('s', 14)})"}]),
    "f15_averages": ("sma10 sma50 sma_diff ema10 ema50 ema_diff wma20", [{"rn": f"row_number() OVER {W}", "sma10": mean("close", 10), "sma50": mean("close", 50), "ema10": span("close", 10), "ema50": span("close", 50)}, {"sma_diff": "sma10 - sma50", "ema_diff": "ema10 - ema50", "wma20": f"CASE WHEN count(close) OVER {fr(20)} >= 20 THEN (sum(close * rn) OVER {fr(20)} - (min(rn) OVER {fr(20)} - 1) * sum(close) OVER {fr(20)}) / 210 END"}]),
    "f16_macd": ("macd macd_signal macd_hist", [{"a": span("close", 12), "b": span("close", 26)}, {"macd": "a - b"}, {"macd_signal": span("macd", 9)}, {"macd_hist": "macd - macd_signal"}]),
    "f17_adx": ("plus_di minus_di adx", [PREV, {"um": f"high - {lag('high')}", "dm": f"lead(low) OVER {W} - low", "t": TR}, {"p": "CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END", "m": "CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END"}, {"pr": rma("p", 14), "mr": rma("m", 14), "r": rma("t", 14)}, {"plus_di": f"100 * {div('pr', 'r')}", "minus_di": f"100 * {div('mr', 'r')}"}, {"dx": f"100 * {div('abs(plus_di - minus_di)', 'plus_di + minus_di')}"}, {"adx": rma("dx", 14)}]),
    "f18_vortex": ("vortex_plus vortex_minus", [PREV, {"p": "abs(high - pl)", "m": "abs(low - ph)", "t": TR}, {"vortex_plus": f"coalesce(({total('p', 14, 1)}) / (({total('t', 14, 1)}) + 1e-9), 0)", "vortex_minus": f"coalesce(({total('m', 14, 1)}) / (({total('t', 14, 1)}) + 1e-9), 0)"}]),
    "f19_trix": ("trix", [{"a": span("close", 15)}, {"b": span("a", 15)}, {"d": span("b", 15)}, {"trix": f"100 * (d / nullif({lag('d')}, 0) - 1)"}]),
    "f20_mass_index": ("mass_index", [PREV, {"a": span("hl", 9)}, {"b": span("a", 9)}, {"s": div("a", "b")}, {"mass_index": total("s", 25)}]),
    "f21_cci": ("cci", [PREV, {"a": mean("tp", 20)}, {"o": "abs(tp - a)"}, {"cci": div("tp - a", f"0.015 * ({mean('o', 20)})")}]),
    "f22_dpo": ("dpo", [{"dpo": f"{lag('close', 11)} - ({mean('close', 20)})"}]),
    "f23_kst": ("kst kst_signal", [ROC, {"kst": f"100 * (({mean('roc_10', 10)}) + 2 * ({mean('roc_15', 10)}) + 3 * ({mean('roc_20', 10)}) + 4 * ({mean('roc_30', 15)}))"}, {"kst_signal": mean("kst", 9)}]),
    "f24_kst_custom": ("kst_main kst_main_signal kst_main_diff", [ROC, {f"h{n}": f"100 * roc_{n}" for n in (10, 15, 20, 30)}, {"kst_main": f"(({mean('h10', 10, 1)}) + 2 * ({mean('h15', 10, 1)}) + 3 * ({mean('h20', 10, 1)}) + 4 * ({mean('h30', 15, 1)}))"}, {"kst_main_signal": mean("kst_main", 9, 1)}, {"kst_main_diff": "kst_main - kst_main_signal"}]),
    "f25_rsi": ("rsi", [PREV, GAIN, {"u": rma("gain", 14), "d": rma("loss", 14)}, {"rsi": RSI.format(div("u", "d"))}]),
    "f26_rsi_sma": ("rsi_sma", [PREV, GAIN, {"rsi_sma": RSI.format(div(mean("gain", 14), mean("loss", 14)))}]),
    "f27_stoch_rsi": ("stoch_rsi stoch_rsi_sma", [PREV, GAIN, {"u": rma("gain", 14), "d": rma("loss", 14), "r2": RSI.format(div(mean("gain", 14), mean("loss", 14)))}, {"r1": RSI.format(div("u", "d"))}, {"stoch_rsi": div(f"r1 - ({low('r1', 14)})", f"({top('r1', 14)}) - ({low('r1', 14)})"), "stoch_rsi_sma": div(f"r2 - ({low('r2', 14)})", f"({top('r2', 14)}) - ({low('r2', 14)})")}]),
    "f28_tsi": ("tsi", [PREV, {"d": D, "m": f"abs({D})"}, {"d1": span("d", 25), "m1": span("m", 25)}, {"d2": span("d1", 13), "m2": span("m1", 13)}, {"tsi": f"100 * {div('d2', 'm2')}"}]),
    "f29_ultimate_osc": ("ultimate_osc", [PREV, {"b": "close - least(low, pc)", "r": "greatest(high, pc) - least(low, pc)"}, {"ultimate_osc": f"100.0 / 7 * (4 * {div(total('b', 7), total('r', 7))} + 2 * {div(total('b', 14), total('r', 14))} + {div(total('b', 28), total('r', 28))})"}]),
    "f30_stochastic": ("stoch_k stoch_d", [{"a": low("low", 14), "b": top("high", 14)}, {"stoch_k": f"100 * {div('close - a', 'b - a')}"}, {"stoch_d": mean("stoch_k", 3)}]),
    "f31_williams_r": ("williams_r", [{"a": low("low", 14), "b": top("high", 14)}, {"williams_r": "-100 * (b - close) / (b - a + 1e-9)"}]),
    "f32_ao": ("ao", [PREV, {"ao": f"({mean('mid', 5)}) - ({mean('mid', 34)})"}]),
    "f34_roc": ("roc10 roc1", [PREV, {"roc10": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)", "roc1": f"100 * ({RET})"}]),
    "f35_ppo_pvo": ("ppo ppo_signal ppo_hist pvo pvo_signal pvo_hist", [{"a": span("close", 12), "b": span("close", 26), "e": span("volume", 12), "f": span("volume", 26)}, {"ppo": f"100 * {div('a - b', 'b')}", "pvo": f"100 * {div('e - f', 'f')}"}, {"ppo_signal": span("ppo", 9), "pvo_signal": span("pvo", 9)}, {"ppo_hist": "ppo - ppo_signal", "pvo_hist": "pvo - pvo_signal"}]),
    "f36_returns": ("daily_ret daily_logret cum_ret", [PREV, {"daily_ret": f"100 * ({RET})", "daily_logret": "100 * (ln(close) - ln(pc))", "g": f"ln(1 + coalesce({RET}, 0))"}, {"cum_ret": f"100 * (exp({run('sum', 'g')}) - 1)"}]),
    "f38_momentum": ("momentum daily_range", [PREV, {"momentum": f"close - {lag('close', 14)}", "daily_range": "hl"}]),
    "f40_hv": ("hv", [PREV, {"s": "ln(close) - ln(pc)"}, {"hv": f"({std('s', 20)}) * sqrt(24 * 365)"}]),
    "f41_garman_klass": ("garman_klass", [{"s": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"}, {"garman_klass": mean("s", 20)}]),
    "f42_parkinson": ("parkinson", [{"s": "pow(ln(high / low), 2)"}, {"parkinson": f"sqrt(({total('s', 20)}) / (4 * ln(2) * 20))"}]),
    "f43_channel_percents": ("kc_percent dc_percent bb_percent", [PREV, {"t": TR, "e": span("close", 20), "a": mean("close", 20), "s": std("close", 20), "dl": low("low", 20), "dh": top("high", 20)}, {"r": mean("t", 14)}, {"kl": "e - 2 * r", "kh": "e + 2 * r", "bl": "a - 2 * s", "bh": "a + 2 * s"}, {f"{p}_percent": div(f"pc - {lag(f'{q}l')}", f"{lag(f'{q}h')} - {lag(f'{q}l')}") for p, q in (("kc", "k"), ("dc", "d"), ("bb", "b"))}]),
    "f44_trend_cci": ("trend_cci", [PREV, {"a": mean("tp", 20)}, {"o": "abs(tp - a)"}, {"r": f"(tp - a) / (0.015 * ({mean('o', 20)}) + 1e-9)"}, {"trend_cci": lag("r")}]),
    "f45_lagged_volume": ("volume_fi volume_obv volume_adi", [PREV, {"f": f"({D}) * volume", "s": f"CASE WHEN {D} >= 0 THEN volume WHEN {D} < 0 THEN -volume END", "k": f"{CLV} * volume"}, {"o": f"CASE WHEN s IS NOT NULL THEN {run('sum', 's')} END", "i": run("sum", "k")}, {"volume_fi": lag("f"), "volume_obv": lag("o"), "volume_adi": lag("i")}]),
    "f46_lagged_price": ("pivot_lag5 ma20_lag return_difference momentum_roc", [PREV, {"m": mean("close", 20), "r": RET, "k": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)"}, {"pivot_lag5": lag("tp", 5), "ma20_lag": lag("m"), "return_difference": f"r - {lag('r')}", "momentum_roc": lag("k")}]),
    "f47_pivots": ("pivot_p pivot_s1 pivot_s2 pivot_r1 pivot_r2", [PREV, {"pivot_p": "tp", "pivot_s1": "2 * tp - high", "pivot_s2": "tp - hl", "pivot_r1": "2 * tp - low", "pivot_r2": "tp + hl"}]),
    "f48_ichimoku": ("ichimoku_conv ichimoku_base ichimoku_span_a ichimoku_span_b ichimoku_span_a_26 ichimoku_span_b_26", [{f"ichimoku_{k}": f"(({top('high', n)}) + ({low('low', n)})) / 2" for k, n in (("conv", 9), ("base", 26), ("span_b", 52))}, {"ichimoku_span_a": "(ichimoku_conv + ichimoku_base) / 2"}, {"ichimoku_span_a_26": lag("ichimoku_span_a", 26), "ichimoku_span_b_26": lag("ichimoku_span_b", 26)}]),
    "f49_vroc": ("vroc", [{"b": lag("volume", 20)}, {"vroc": "(volume - b) / (b + 1e-9) * 100"}]),
    "f50_engulfing": ("engulfing doji", [PREV, {"engulfing": "CASE WHEN close > open AND pc < po AND close > po AND open < pc THEN 1 WHEN close < open AND pc > po AND close < po AND open > pc THEN -1 ELSE 0 END", "doji": "CASE WHEN abs(close - open) / (high - low + 1e-9) < 0.1 THEN 1 ELSE 0 END"}]),
    "f52_heikin_ashi": ("ha_close ha_open", [{"ha_close": "(open + high + low + close) / 4"}, {"ha_open": lag("ha_close")}]),
    "f53_ratios": ("range_close_ratio bull_power rsi_macd ma_ratio", [PREV, GAIN, {"u": rma("gain", 14), "d": rma("loss", 14), "a": span("close", 12), "b": span("close", 26), "e": span("close", 13), "s1": mean("close", 10), "s2": mean("close", 50)}, {"range_close_ratio": div("hl", "close"), "bull_power": "high - e", "rsi_macd": f"({RSI.format(div('u', 'd'))}) * (a - b)", "ma_ratio": div("s1", "s2")}]),
    "f54_candles": ("candle_height candle_body upper_shadow lower_shadow", [{"candle_height": "high - low", "candle_body": "abs(close - open)", "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low"}]),
    "f55_ratios": ("volume_ratio price_to_ma pct_change", [PREV, {"volume_ratio": div("volume", mean("volume", 10)), "price_to_ma": div("close", mean("close", 20)), "pct_change": f"100 * ({RET})"}]),
    "f56_lagged_stats": (" ".join(f"lag_{k}_{n}" for n in (5, 10, 20) for k in ("sma", "std", "min", "max", "volume_sma", "volume_ratio")), [PREV, {f"lag_{k}_{n}": over(f, "pc", n) for n in (5, 10, 20) for k, f in (("sma", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))} | {f"lag_volume_sma_{n}": mean("pv", n) for n in (5, 10, 20)}, {f"lag_volume_ratio_{n}": div("pv", f"lag_volume_sma_{n}") for n in (5, 10, 20)}]),
}


def _indicator(names, digits):
    return lambda spark, d: fx.rounded(indicators.add_indicators(fx.bars(spark, d), names), "symbol", "time", *names, digits=digits)


def _primitive(make):
    def query(spark, d):
        w = x.series()
        df = fx.bars(spark, d).withColumns({"row": F.row_number().over(w), "rise": F.when(c("close") > F.lag("close").over(w), 1).when(F.lag("close").over(w).isNotNull(), 0)})
        added = make(w)
        return fx.rounded(df.withColumns(added), "symbol", "time", *added)

    return query


LIST = f"list_sort(list(close) OVER {fr(9)})"
#: query -> (columns of a window, layers of SQL)
PRIMITIVES = {
    "e01_shift_diff": (lambda w: {"lag3": x.shift(c("close"), w, 3), "diff2": x.diff(c("close"), w, 2), "pct3": x.pct_change(c("close"), w, 3), "logret": x.log_return(c("close"), w)}, [{"lag3": lag("close", 3), "diff2": f"close - {lag('close', 2)}", "pct3": f"close / nullif({lag('close', 3)}, 0) - 1", "logret": f"ln(close) - ln({lag('close')})"}]),
    "e05_rolling": (lambda w: {"sum7": x.rolling_sum(c("close"), 7, w), "mean7": x.rolling_mean(c("close"), 7, w, 1), "min7": x.rolling_min(c("close"), 7, w), "max7": x.rolling_max(c("close"), 7, w, 3)}, [{"sum7": total("close", 7), "mean7": mean("close", 7, 1), "min7": low("close", 7), "max7": top("close", 7, 3)}]),
    "e06_rolling_std": (lambda w: {"s1": x.rolling_std(c("close"), 20, w), "s0": x.rolling_std(c("close"), 20, w, None, 0)}, [{"s1": std("close", 20), "s0": std("close", 20, None, "stddev_pop")}]),
    "e07_moments": (
        lambda w: {"skew": x.rolling_skew(c("close"), 20, w), "kurt": x.rolling_kurt(c("close"), 20, w)},
        [{"m": mean("close", 20), "v": std("close", 20, None, "var_pop"), "q": f"list(close) OVER {fr(20)}"}, {"skew": "list_avg([pow(z - m, 3) FOR z IN q]) / pow(v, 1.5)", "kurt": "list_avg([pow(z - m, 4) FOR z IN q]) / pow(v, 2) - 3"}],
    ),
    "e09_rolling_median": (lambda w: {"median9": x.rolling_median(c("close"), 9, w), "q20": x.rolling_quantile(c("close"), 0.2, 9, w)}, [{"median9": f"CASE WHEN count(close) OVER {fr(9)} >= 9 THEN quantile_cont(close, 0.5) OVER {fr(9)} END", "q20": f"CASE WHEN count(close) OVER {fr(9)} >= 9 THEN quantile_cont(close, 0.2) OVER {fr(9)} END"}]),
    "e09_rolling_apply": (lambda w: {"spread": x.rolling_apply(c("close"), 9, lambda v: F.array_max(v) - F.array_min(v), w)}, [{"spread": f"CASE WHEN count(close) OVER {fr(9)} >= 9 THEN max(close) OVER {fr(9)} - min(close) OVER {fr(9)} END"}]),
    "e10_up_count": (lambda w:{"ups": x.rolling_up_count(c("rise"), 10, w).cast("double")}, [{"r": f"CASE WHEN close > {lag('close')} THEN 1 WHEN {lag('close')} IS NOT NULL THEN 0 END"}, {"ups": f"CASE WHEN count(*) OVER {fr(10)} >= 10 THEN CAST(sum(r) OVER {fr(9)} AS BIGINT) END"}]),
    "e11_bars_since": (lambda w: {"since_max": x.bars_since_max(c("close"), c("row"), 10, w).cast("double"), "since_min": x.bars_since_min(c("close"), c("row"), 10, w).cast("double")}, [{"q": f"list(close) OVER {fr(10)}"}, {"since_max": "CASE WHEN len(q) >= 10 THEN 10 - list_position(q, list_max(q)) END", "since_min": "CASE WHEN len(q) >= 10 THEN 10 - list_position(q, list_min(q)) END"}]),
    "e12_slope": (lambda w: {"slope": x.rolling_slope(c("close"), c("row"), 8, w)}, [{"rn": f"CAST(row_number() OVER {W} AS DOUBLE)"}, {"slope": f"CASE WHEN count(close) OVER {fr(8)} >= 2 THEN {div(f'covar_pop(close, rn) OVER {fr(8)}', f'var_pop(rn) OVER {fr(8)}')} END"}]),
    "e13_corr": (lambda w: {"corr": x.rolling_corr(c("close"), c("volume"), 12, w)}, [{"corr": f"CASE WHEN count(close) OVER {fr(12)} >= 2 AND min(close) OVER {fr(12)} <> max(close) OVER {fr(12)} AND min(volume) OVER {fr(12)} <> max(volume) OVER {fr(12)} THEN corr(close, volume) OVER {fr(12)} END"}]),
    "e14_zscore": (lambda w: {"z": x.zscore(c("close"), 10, w), "pos": x.pos_in_channel(c("close"), 10, w)}, [{"m": mean("close", 10), "s": std("close", 10, None, "stddev_pop"), "a": low("close", 10), "b": top("close", 10)}, {"z": "(close - m) / (s + 1e-12)", "pos": "(close - a) / (nullif(b - a, 0) + 1e-12)"}]),
    "e16_wma_fir": (lambda w: {"wma": x.wma(c("close"), c("row"), 6, w), "fir": x.fir_mean(c("close"), 5, w)}, [{"rn": f"row_number() OVER {W}"}, {"wma": f"CASE WHEN count(close) OVER {fr(6)} >= 6 THEN (sum(close * rn) OVER {fr(6)} - (min(rn) OVER {fr(6)} - 1) * sum(close) OVER {fr(6)}) / 21 END", "fir": f"sum(close) OVER {fr(5)} / 5"}]),
    "e18_running": (lambda w: {"csum": x.cumsum(c("close"), w), "cmax": x.cummax(c("close"), w), "cprod": x.cumprod(1 + c("close") / 1e5, w)}, [{"g": "ln(1 + close / 1e5)"}, {"csum": run("sum", "close"), "cmax": run("max", "close"), "cprod": f"exp({run('sum', 'g')})"}]),
}


def _bank(spark, d):
    df = x.moving_average_bank(fx.bars(spark, d), {"close": "ma", "volume": "ma_volume"}, range(3, 150))
    return fx.rounded(df, "symbol", "time", *[f"{p}{n}" for p in ("ma", "ma_volume") for n in range(3, 150)])


def _long_ema(spark, d):
    return fx.rounded(scan.ema(fx.bars(spark, d), {f"ema{n}": ("close", scan.span_alpha(n)) for n in (2, 200, 2000)}), "symbol", "time", "ema2", "ema200", "ema2000", digits=4)


def _ema(spark, d):
    df = scan.ema(fx.bars(spark, d), {"ema9": ("close", scan.span_alpha(9)), "ema50": ("close", scan.span_alpha(50)), "rma14": ("close", scan.rma_alpha(14))})
    return fx.rounded(df, "symbol", "time", "ema9", "ema50", "rma14", digits=4)


def _adjusted(spark, d):
    return fx.rounded(scan.ewm_adjusted(fx.bars(spark, d), {"ewm20": ("close", 20)}), "symbol", "time", "ewm20")


def _halo(spark, d):
    rows = scan.with_halo(fx.bars(spark, d), 19, 256)
    w = x.series("symbol", "chunk")
    return fx.rounded(rows.withColumns({"mean20": x.rolling_mean(c("close"), 20, w), "max20": x.rolling_max(c("high"), 20, w)}).filter("NOT halo"), "symbol", "time", "mean20", "max20")


def _kama(spark, d):
    return fx.rounded(indicators.kama(fx.bars(spark, d)), "symbol", "time", "kama", digits=4)


def _psar(spark, d):
    return fx.rounded(indicators.parabolic_sar(fx.bars(spark, d)), "symbol", "time", "psar")


def _set(spark, d):
    return fx.rounded(indicators.build_indicators(fx.bars(spark, d), "30T", chunk=512), digits=4)


def _set_sql():
    """All indicators from the SQL of their own queries: builders a bar later, the other blocks as they are."""
    late = [n for n in indicators.BUILDER if n not in indicators.CUSTOM]
    names = [*late, *indicators.LAGGED, *indicators.CUSTOM]
    source = {n: k for k, (wanted, _) in reversed(INDICATORS.items()) for n in wanted.split()}
    parts = {k: [n for n in names if source[n] == k] for k in dict.fromkeys(source[n] for n in names)}
    tables = [f"{k} AS ({layered(INDICATORS[k][1], own, digits=0)})" for k, own in parts.items()]
    value = lambda n: f"lag({n}) OVER {W}" if n in late else n
    columns = [f"{n} AS \"30T_{n}\"" for n in ("open", "high", "low", "close", "volume")] + [f"{value(n)} AS \"30T_{n}\"" for n in names]
    joined = "bars " + " ".join(f"JOIN {k} USING (symbol, time)" for k in parts)
    out = [f"\"30T_{n}\"" for n in ("open", "high", "low", "close", "volume", *names)]
    rounded = ", ".join(f"CAST({n} AS BIGINT) AS {n}" if n in ('"30T_engulfing"', '"30T_doji"') else f"round(CAST({n} AS DOUBLE) * (1 + 1e-12), 4) + 0 AS {n}" for n in out)
    return f"WITH {BARS.format(m=30)}, {', '.join(tables)}, s AS (SELECT symbol, time, {', '.join(columns)} FROM {joined}) SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {rounded} FROM s"


def _running(spark, d):
    bars = fx.bars(spark, d).withColumn("odd", F.when(F.hour("time") % 2 == 1, c("close"))).withColumn("g", 1 + c("close") / 1e5)
    scans = {"csum": ("close", "sum"), "n_odd": ("odd", "count"), "cmax": ("close", "max"), "cmin": ("odd", "min"), "cprod": ("g", "product"), "clast": ("odd", "last")}
    return fx.rounded(ranges.prefix_scan(bars, scans, ranges=16), "symbol", "time", *scans)


N = 10
STABLE_IN = [
    {"c_lag": lag("close"), "v_lag": lag("volume"), "lp": "ln(close)", "rn": f"CAST(row_number() OVER {W} AS DOUBLE)"},
    {"p_lag": lag("lp"), "d": f"lp - {lag('lp')}", "dc": f"c_lag - {lag('c_lag')}", "dv": f"v_lag - {lag('v_lag')}"},
    {"ret": lag("d")},
    {"r2": "ret * ret", "up": "CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END", "dn": "CASE WHEN ret < 0 THEN 1.0 ELSE 0.0 END", "u2": "pow(greatest(ret, 0), 2)", "d2": "pow(least(ret, 0), 2)", "sv": "sign(dc) * v_lag", "ad": "abs(dc)", "tx": "abs(sign(ret) * v_lag)"},
]
_SL = lambda e: f"CASE WHEN count({e}) OVER {fr(N)} >= 2 THEN {div(f'covar_pop({e}, CASE WHEN {e} IS NOT NULL THEN rn END) OVER {fr(N)}', f'var_pop(CASE WHEN {e} IS NOT NULL THEN rn END) OVER {fr(N)}')} END"
#: feature -> SQL over the inputs, for frames of 10
STABLE = {
    "g01_trend_slope": {"trend_slope_10": _SL("p_lag")},
    "g02_realized_vol": {"realized_vol_10": f"sqrt({total('r2', N)})"},
    "g03_up_ratio": {"up_ratio_10": over("avg", "up", N)},
    "g05_ret_vol_corr": {"ret_vol_corr_10": f"CASE WHEN count(ret) OVER {fr(N)} >= 2 AND min(CASE WHEN v_lag IS NOT NULL THEN ret END) OVER {fr(N)} <> max(ret) OVER {fr(N)} AND min(CASE WHEN ret IS NOT NULL THEN v_lag END) OVER {fr(N)} <> max(CASE WHEN ret IS NOT NULL THEN v_lag END) OVER {fr(N)} THEN corr(ret, v_lag) OVER {fr(N)} END"},
    "g06_pos_in_channel": {"pos_in_channel_10": f"(c_lag - ({low('c_lag', N)})) / (nullif(({top('c_lag', N)}) - ({low('c_lag', N)}), 0) + 1e-12)"},
    "g07_zscores": {"zscore_close_10": f"(c_lag - ({mean('c_lag', N)})) / (({std('c_lag', N, None, 'stddev_pop')}) + 1e-12)"},
    "g08_semi_vol": {"semi_up_vol_10": f"sqrt({total('u2', N)})", "semi_down_vol_10": f"sqrt({total('d2', N)})"},
    "g10_orderflow": {"orderflow_imbalance_10": f"({total('sv', N)}) / (({total('v_lag', N)}) + 1e-9)"},
    "g11_efficient_price": {"efficient_price_10": f"({total('dc', N)}) / (({total('ad', N)}) + 1e-12)"},
    "g12_vpin": {"vpin_10": f"({total('tx', N)}) / (({total('v_lag', N)}) + 1e-9)"},
    "g15_signal_consistency": {"signal_consistency_10": f"coalesce(({over('avg', 'up', N)}) - ({over('avg', 'dn', N)}), 0)"},
    "g16_vol_norm": {"vol_norm_disagreement_10": f"coalesce(({std('ret', N)}) / (abs({mean('ret', N)}) + 1e-12), 0)"},
    "g17_stability_confidence": {"stability_confidence_10": f"1 / (1 + abs({_SL('c_lag')}))"},
}


def _stable(names, rounding=6):
    base = tuple(dict.fromkeys(n[: -len("_10")] for n in names))
    return lambda spark, d: fx.rounded(stable.add_stable_features(fx.bars(spark, d), lengths=(N,), names=base), "symbol", "time", *names, digits=rounding)


def _imbalances(spark, d):
    return fx.rounded(stable.add_stable_features(fx.bars(spark, d), lengths=(N,), names=("vpin",)), "symbol", "time", "tick_imbalance", "volume_imbalance", "microprice")


def _all_stable(spark, d):
    return fx.rounded(stable.add_stable_features(fx.bars(spark, d), "30T"))


def _prototype(spark, d):
    return fx.rounded(stable.add_prototype_features(fx.bars(spark, d), "30T"), "symbol", "time", *[f"{k}_{n}" for n in stable.WINDOWS["30T"] for k in stable.PROTOTYPE if k != "ret_vol_corr"])


def _prototype_sql():
    out = {}
    for n in stable.WINDOWS["30T"]:
        for sql in ("g01_trend_slope", "g02_realized_vol", "g03_up_ratio"):
            for k, e in STABLE[sql].items():
                out[k.replace("_10", f"_{n}")] = e.replace(fr(N), fr(n)).replace(">= 10", f">= {n}")
    h = {f"dir_entropy_{n}": f"-(greatest(least(up_ratio_{n}, 1 - 1e-6), 1e-6) * log2(greatest(least(up_ratio_{n}, 1 - 1e-6), 1e-6)) + (1 - greatest(least(up_ratio_{n}, 1 - 1e-6), 1e-6)) * log2(1 - greatest(least(up_ratio_{n}, 1 - 1e-6), 1e-6)))" for n in stable.WINDOWS["30T"]}
    return layered([*STABLE_IN, out, h], [*out, *h])


QUERIES, ORACLES = {}, {}
for name, (wanted, layers) in INDICATORS.items():
    QUERIES[name], ORACLES[name] = _indicator(wanted.split(), digits_for(layers)), layered(layers, wanted.split())
for name, (make, layers) in PRIMITIVES.items():
    QUERIES[name], ORACLES[name] = _primitive(make), layered(layers, list(layers[-1]))
for name, sql in STABLE.items():
    QUERIES[name], ORACLES[name] = _stable(list(sql)), layered([*STABLE_IN, sql], list(sql))
QUERIES |= {"e19_ewm_adjusted": _adjusted, "e20_affine_scan": _ema, "e20_ema_200": _long_ema, "e20_halo_chunks": _halo, "e21_ma_bank": _bank, "f33_kama": _kama, "f37_parabolic_sar": _psar, "f57_build_indicators": _set, "e18_prefix_scan": _running}
QUERIES |= {"g09_imbalances": _imbalances, "g18_stable_features": _all_stable, "g19_prototype": _prototype}
QUERIES |= {"g13_spectrum": _stable(["fft_energy_ratio_10", "fft_dom_freq_10", "spectral_entropy_10"]), "g14_wavelet": _stable(["wavelet_energy_10"])}
ORACLES |= {
    "e20_affine_scan": layered([{"ema9": span("close", 9), "ema50": span("close", 50), "rma14": rma("close", 14)}], ["ema9", "ema50", "rma14"]),
    "e20_ema_200": layered([{"ema2": span("close", 2), "ema200": span("close", 200), "ema2000": span("close", 2000)}], ["ema2", "ema200", "ema2000"]),
    "e20_halo_chunks": layered([{"mean20": mean("close", 20), "max20": top("high", 20)}], ["mean20", "max20"]),
    "e19_ewm_adjusted": layered([{"q": f"list(close) OVER {RUN}"}, {"ewm20": "list_sum([q[i] * pow(19.0 / 21, len(q) - i) FOR i IN range(1, len(q) + 1)]) / list_sum([pow(19.0 / 21, len(q) - i) FOR i IN range(1, len(q) + 1)])"}], ["ewm20"]),
    "e21_ma_bank": layered([{f"{p}{n}": mean(e, n) for p, e in (("ma", "close"), ("ma_volume", "volume")) for n in range(3, 150)}], [f"{p}{n}" for p in ("ma", "ma_volume") for n in range(3, 150)]),
    "f33_kama": layered(
        [
            {"st": f"abs(close - {lag('close')})", "wy": f"abs(close - {lag('close', 10)})", "rn": f"row_number() OVER {W}"},
            {"sc": f"pow({div('wy', total('st', 10))} * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"},
            {"fi": f"min(CASE WHEN sc IS NOT NULL THEN rn END) OVER {RUN}"},
            {"e": "CASE WHEN rn = fi THEN {'a': 0.0::DOUBLE, 'b': close} WHEN rn > fi THEN {'a': 1 - coalesce(sc, 0), 'b': coalesce(sc * close, 0)} END"},
            {"kama": f"list_reduce(list(e) FILTER (WHERE e IS NOT NULL) OVER {RUN}, lambda s, t: {{'a': s.a * t.a, 'b': t.a * s.b + t.b}}).b"},
        ],
        ["kama"],
    ),
    "g09_imbalances": layered([*STABLE_IN, {"tick_imbalance": "CAST(sign(dc) AS DOUBLE)", "volume_imbalance": "v_lag * sign(dv)", "microprice": "c_lag + dc / 2"}], ["tick_imbalance", "volume_imbalance", "microprice"]),
    "g14_wavelet": layered(
        [*STABLE_IN, {"q": f"list(ret) FILTER (WHERE ret IS NOT NULL) OVER {fr(N)}"}, {"pd": "list_concat(list_concat(list_reverse(q[1:3]), q), list_reverse(q[-3:]))"},
         {"wavelet_energy_10": "CASE WHEN len(q) >= 8 THEN list_sum([pow(-0.48296291314453416 * pd[2 * k + 5] + 0.8365163037378079 * pd[2 * k + 4] - 0.2241438680420134 * pd[2 * k + 3] - 0.12940952255126037 * pd[2 * k + 2], 2) FOR k IN range(0, CAST(floor((len(q) + 3) / 2) AS BIGINT))]) END"}],
        ["wavelet_energy_10"],
    ),
    "g19_prototype": _prototype_sql(),
    "f57_build_indicators": _set_sql(),
    "e18_prefix_scan": layered(
        [{"odd": "CASE WHEN hour(time) % 2 = 1 THEN close END"}, {"csum": run("sum", "close"), "n_odd": run("count", "odd"), "cmax": run("max", "close"), "cmin": run("min", "odd"), "cprod": f"product(1 + close / 1e5) OVER {RUN}", "clast": f"last_value(odd IGNORE NULLS) OVER {RUN}"}],
        ["csum", "n_odd", "cmax", "cmin", "cprod", "clast"],
    ).replace("round(CAST(n_odd AS DOUBLE) * (1 + 1e-12), 6) + 0 AS n_odd", "n_odd"),
    # bar by bar: stop carried on, then either a reversal or a new extreme
    "f37_parabolic_sar": f"""WITH RECURSIVE {BARS.format(m=30)}, b AS (SELECT symbol, time, high, low, row_number() OVER {W} AS n FROM bars),
s AS (
  SELECT symbol, time, n, true AS rising, CAST(0.018 AS DOUBLE) AS rate, high AS extreme, low AS stop FROM b WHERE n = 1
  UNION ALL
  SELECT symbol, time, n, rising <> crossed, CASE WHEN crossed THEN 0.018 WHEN further THEN least(rate + 0.018, 0.2) ELSE rate END,
    CASE WHEN crossed THEN CASE WHEN rising THEN low ELSE high END WHEN further THEN CASE WHEN rising THEN high ELSE low END ELSE extreme END, CASE WHEN crossed THEN extreme ELSE moved END
  FROM (
    SELECT b.symbol, b.time, b.n, b.high, b.low, s.rising, s.rate, s.extreme, s.stop + s.rate * (s.extreme - s.stop) AS moved,
      CASE WHEN s.rising THEN b.low < s.stop + s.rate * (s.extreme - s.stop) ELSE b.high > s.stop + s.rate * (s.extreme - s.stop) END AS crossed,
      CASE WHEN s.rising THEN b.high > s.extreme ELSE b.low < s.extreme END AS further
    FROM s JOIN b ON b.symbol = s.symbol AND b.n = s.n + 1
  )
) SELECT symbol, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, {written(['stop']).replace('AS stop', 'AS psar')} FROM s""",
}

#: Spectrum of the frame's returns by the definition of the transform, then what is read from it.
_WAVE = "pow(list_sum([(q[i + 1] - list_avg(q)) * {f}(2 * pi() * k * i / len(q)) FOR i IN range(0, len(q))]), 2)"
SPECTRUM = [
    {"q": f"list(ret) FILTER (WHERE ret IS NOT NULL) OVER {fr(N)}"},
    {"pw": f"CASE WHEN len(q) >= 4 THEN [{_WAVE.format(f='cos')} + {_WAVE.format(f='sin')} FOR k IN range(1, len(q) // 2 + 1)] END"},
    {"whole": "list_sum(pw) + 1e-12"},
    {
        "fft_energy_ratio_10": "coalesce(list_sum([pw[k] FOR k IN range(1, len(pw) + 1) IF k > 0.25 * len(q)]), 0) / whole + 0 * len(pw)",
        "fft_dom_freq_10": "list_position(pw, list_max(pw)) / len(q)",
        "spectral_entropy_10": "-list_sum([p / whole * ln(p / whole + 1e-12) FOR p IN pw]) / ln(len(pw) + 1e-12)",
    },
]
ORACLES["g13_spectrum"] = layered([*STABLE_IN, *SPECTRUM], list(SPECTRUM[-1]))


def _all_stable_sql():
    """All stable features of the timeframe from the SQL of their own queries, with other frame lengths."""
    layers, out = [*STABLE_IN], []
    for n in stable.WINDOWS["30T"]:
        of = lambda e, n=n: re.sub(r"\b(pw|q|whole)\b", rf"\g<1>{n}", e.replace(fr(N), fr(n)).replace(f">= {N}", f">= {n}").replace("_10", f"_{n}"))
        first = {of(k): of(e) for sql in STABLE.values() for k, e in sql.items()} | {f"zscore_volume_{n}": of(STABLE["g07_zscores"]["zscore_close_10"].replace("c_lag", "v_lag"))}
        clipped = f"greatest(least(up_ratio_{n}, 1 - 1e-6), 1e-6)"
        wavelet = f"CASE WHEN len(q{n}) >= 8 THEN list_sum([pow(-0.48296291314453416 * pd{n}[2 * k + 5] + 0.8365163037378079 * pd{n}[2 * k + 4] - 0.2241438680420134 * pd{n}[2 * k + 3] - 0.12940952255126037 * pd{n}[2 * k + 2], 2) FOR k IN range(0, CAST(floor((len(q{n}) + 3) / 2) AS BIGINT))]) END"
        spectrum = [{of(k): of(e) for k, e in layer.items()} for layer in SPECTRUM]
        layers += [first, {f"dir_entropy_{n}": f"-({clipped} * log2({clipped}) + (1 - {clipped}) * log2(1 - {clipped}))"}, *spectrum]
        layers += [{f"pd{n}": f"list_concat(list_concat(list_reverse(q{n}[1:3]), q{n}), list_reverse(q{n}[-3:]))"}, {f"wavelet_energy_{n}": wavelet}]
        out += [f"{k}_{n}" for k in stable.NAMES]
    layers.append({"tick_imbalance": "CAST(sign(dc) AS DOUBLE)", "volume_imbalance": "v_lag * sign(dv)", "microprice": "c_lag + dc / 2"})
    return layered(layers, ["open", "high", "low", "close", "volume", "tick_imbalance", "volume_imbalance", "microprice", *out])


ORACLES["g18_stable_features"] = _all_stable_sql()

