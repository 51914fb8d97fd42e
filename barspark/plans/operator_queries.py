"""Queries of sources, cleaning, alignment, statistics, framing, decisions, parity and guards, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import windows as x
from barspark.operators import align, clean, decide, frame, parity, scan, stats
from barspark.plans import fixtures as fx
from barspark.plans.features import feature_frame
from barspark.plans.indicator_queries import BARS, W, fr
from barspark.sources import bars as src

c = F.col
QUERIES, ORACLES = {}, {}
B30 = BARS.format(m=30)
T = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"


def r(*names, digits=6):
    """Rounded columns: ``name`` or ``name=expression``."""
    out = []
    for n in names:
        name, _, e = n.partition("=")
        out.append(f"round(CAST({e or name} AS DOUBLE) * (1 + 1e-12), {digits}) + 0 AS {name}")
    return ", ".join(out)


def named_bars(minutes, name):
    return BARS.format(m=minutes).replace("bars AS", f"{name} AS", 1)


DIRTY = f"""{B30}, dirty AS (
  SELECT symbol, time, open, high, low, volume, n, CASE WHEN n % 17 = 0 THEN NULL WHEN n % 23 = 0 THEN 0 ELSE close END AS close
  FROM (SELECT *, row_number() OVER {W} AS n FROM bars))"""
SCORED = f"""{B30}, z AS (
  SELECT *, CASE WHEN lead(close) OVER {W} IS NOT NULL THEN CAST(lead(close) OVER {W} > close AS INT) END AS y,
    CASE WHEN count(close) OVER {fr(10)} >= 10 THEN (close - avg(close) OVER {fr(10)}) / (stddev_pop(close) OVER {fr(10)} + 1e-12) END AS z FROM bars
), q AS (SELECT *, round(1 / (1 + exp(-z)), 6) AS p FROM z WHERE z IS NOT NULL),
scored AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN 0 ELSE -1 END AS decision FROM q)"""
SECOND = f"""{SCORED}, feed AS (SELECT * REPLACE (CASE WHEN k % 50 = 0 THEN p + 1e-3 ELSE p END AS p) FROM (SELECT *, row_number() OVER {W} AS k FROM scored))"""
METRICS = """{keys}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(decided AS BIGINT) AS decided, CAST(n AS BIGINT) AS n, """ + r(
    "accuracy=coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)", "balanced_accuracy=(coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2", "f1=coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coverage=100 * decided / n"
)
COUNTS = "count(*) FILTER (WHERE decision = 1 AND y = 1) AS tp, count(*) FILTER (WHERE decision = 1 AND y = 0) AS fp, count(*) FILTER (WHERE decision = 0 AND y = 0) AS tn, count(*) FILTER (WHERE decision = 0 AND y = 1) AS fn, count(*) FILTER (WHERE decision <> -1) AS decided, count(*) AS n"
OHLCV = "open high low close volume".split()
HALF = "TIMESTAMP '2024-01-15 00:00:00'"


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def rows(*names):
    """A query that returns the named columns of what its function makes of the 30-minute bars."""
    return lambda make: lambda spark, d: fx.rounded(make(fx.bars(spark, d)), *names)


def on_scored(*names, digits=6):
    return lambda make: lambda spark, d: fx.rounded(make(fx.scored(spark, d)), *names, digits=digits)


# --- flagship ---


def up_rate(spark, d):
    """Thirty-minute bars, their channel position and true range, and how often the next bar rises, per symbol."""
    w = x.series()
    df = frame.label_next_up(fx.bars(spark, d))
    df = df.withColumns({"sma": x.rolling_mean(c("close"), 20, w), "sd": x.rolling_std(c("close"), 20, w), "range": c("high") - c("low")})
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(c("y").cast("double")).alias("up_rate"), F.avg("range").alias("mean_range"), F.avg((c("close") > c("sma") + 2 * c("sd")).cast("double")).alias("above_band"))
    return fx.rounded(out)


add("entry_up_rate", up_rate, f"""WITH {B30}, l AS (SELECT *, lead(close) OVER {W} AS nx, CASE WHEN count(close) OVER {fr(20)} >= 20 THEN avg(close) OVER {fr(20)} END AS sma, CASE WHEN count(close) OVER {fr(20)} >= 20 THEN stddev_samp(close) OVER {fr(20)} END AS sd, row_number() OVER {W} AS rn FROM bars),
l2 AS (SELECT * FROM l WHERE nx IS NOT NULL)
SELECT symbol, count(*) AS n, {r('up_rate=avg(CASE WHEN nx > close THEN 1.0 ELSE 0.0 END)', 'mean_range=avg(high - low)', 'above_band=avg(CASE WHEN close > sma + 2 * sd THEN 1.0 WHEN sma IS NOT NULL AND sd IS NOT NULL THEN 0.0 END)')} FROM l2 GROUP BY symbol""")

# --- A ---
for m in (5, 15, 30, 60):
    add(f"a05_bars_{m}m", lambda spark, d, m=m: fx.rounded(fx.bars(spark, d, f"{m} minutes")), f"WITH {BARS.format(m=m)} SELECT symbol, {T}, {r(*OHLCV)} FROM bars")
add("a05_daily_bars", lambda spark, d: fx.rounded(src.daily_bars(fx.table(spark, d, "orders"), F.lit("ALL"), "o_totalprice", "o_orderdate", "o_orderkey")),
    f"SELECT 'ALL' AS symbol, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS time, {r('open=first(o_totalprice ORDER BY o_orderkey)', 'high=max(o_totalprice)', 'low=min(o_totalprice)', 'close=last(o_totalprice ORDER BY o_orderkey)', 'volume=count(*)')} FROM orders GROUP BY o_orderdate")
add("a03_normalize", lambda spark, d: fx.rounded(src.normalize_bars(fx.bars(spark, d).select("symbol", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("Date"), c("close").alias("Close")))), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars")
add("a10_slice_tail", lambda spark, d: fx.rounded(src.slice_tail(fx.bars(spark, d, "15 minutes").withColumn("tf", F.lit("15T")).unionByName(fx.bars(spark, d).withColumn("tf", F.lit("30T"))), 50, {"15T": 120}), "symbol", "tf", "time", "close"),
    f"WITH {named_bars(15, 'b15')}, {B30}, u AS (SELECT '15T' AS tf, * FROM b15 UNION ALL SELECT '30T', * FROM bars), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY time DESC) AS k FROM u) SELECT symbol, tf, {T}, {r('close')} FROM k WHERE k <= CASE tf WHEN '15T' THEN 120 ELSE 50 END")
add("a11_tail", rows("symbol", "time", "close")(lambda b: src.tail_n(b, 20)), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 20")
add("a11_cut_asof", rows("symbol", "time", "close")(lambda b: src.cut_asof(b, F.lit("2024-01-15").cast("timestamp_ntz"), 30)), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars WHERE time <= {HALF} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 30")

# --- B ---
add("b01_coerce", lambda spark, d: fx.rounded(clean.coerce_numeric(fx.dirty_bars(spark, d).withColumn("close", F.when(c("n") % 5 == 0, "n/a").otherwise(c("close").cast("string")))), "symbol", "time", "close"), f"WITH {DIRTY} SELECT symbol, {T}, {r('close')} FROM dirty WHERE close IS NOT NULL AND n % 5 <> 0")
add("b02_trim", rows("symbol", "time", "close")(lambda b: clean.trim_from(b, "2024-01-20")), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars WHERE time >= TIMESTAMP '2024-01-20'")
add("b03_common_start", rows("symbol", "time", "close")(lambda b: clean.common_start(b, "2024-01-01 00:10:00", "symbol")), f"WITH {B30}, f AS (SELECT greatest(max(m), TIMESTAMP '2024-01-01 00:10:00') AS s FROM (SELECT min(time) AS m FROM bars GROUP BY symbol)) SELECT symbol, {T}, {r('close')} FROM bars, f WHERE time >= s")
add("b04_repair_outliers", lambda spark, d: fx.rounded(clean.repair_outliers(fx.dirty_bars(spark, d)), "symbol", "time", "bad", "close_fixed", digits=4),
    f"""WITH {DIRTY}, s AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS s FROM dirty GROUP BY 1),
k AS (SELECT d.*, close IS NULL OR close = 0 OR coalesce(abs(close - m) > 3 * s, false) AS bad, lead(close) OVER w AS nx, row_number() OVER w = 1 AS fst, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1 AS lst FROM dirty d JOIN s USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY time)),
e AS (SELECT *, {{'a': CASE WHEN bad AND NOT fst THEN CASE WHEN lst THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END, 'b': CASE WHEN NOT bad THEN close WHEN fst THEN coalesce(nx, 'nan'::DOUBLE) WHEN lst THEN 0 ELSE coalesce(nx / 2, 'nan'::DOUBLE) END}} AS e FROM k),
o AS (SELECT symbol, time, bad, list_reduce(list(e) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), lambda s, t: {{'a': s.a * t.a, 'b': CASE WHEN t.a = 0 THEN t.b ELSE t.a * s.b + t.b END}}).b AS v FROM e)
SELECT symbol, {T}, bad, {r('close_fixed=CASE WHEN isnan(v) THEN NULL ELSE v END', digits=4)} FROM o""")
add("b05_basic_clean", lambda spark, d: fx.rounded(clean.basic_clean(fx.dirty_bars(spark, d).select("symbol", "time", "close").union(fx.dirty_bars(spark, d).select("symbol", "time", "close"))), "symbol", "time", "close"),
    f"WITH {DIRTY}, k AS (SELECT DISTINCT symbol, time, close FROM dirty) SELECT symbol, {T}, {r('close=coalesce(close, (SELECT avg(close) FROM k))')} FROM k")
add("b06_ffill", lambda spark, d: fx.rounded(clean.finite_ffill(fx.dirty_bars(spark, d), ["close"], True), "symbol", "time", "close"), f"WITH {DIRTY}, f AS (SELECT symbol, time, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS close FROM dirty) SELECT symbol, {T}, {r('close')} FROM f WHERE close IS NOT NULL")
add("b07_seconds", rows("symbol", "time", "gap")(lambda b: clean.intervals_to_seconds(b.withColumn("before", F.lag("time").over(x.series())), "before", "time", "gap")), f"WITH {B30} SELECT symbol, {T}, {r(f'gap=(epoch_us(time) - epoch_us(lag(time) OVER {W})) / 1e6')} FROM bars")
add("b08_weekends", rows("symbol", "time", "close")(clean.drop_weekends), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars WHERE isodow(time) < 6")
add("b08_weekend_now", rows()(clean.is_weekend_now), f"WITH {B30} SELECT symbol, isodow(max(time)) >= 6 AS weekend FROM bars GROUP BY symbol")
add("b09_dedup_last", lambda spark, d: fx.rounded(clean.dedup_last(fx.table(spark, d, "events").withColumn("day", F.to_date("ts")), ("event_type", "day"), "ts", "event_id"), "event_type", "day", "event_id", "value"),
    f"SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id, {r('value')} FROM events QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
add("b10_signed_log1p", rows("symbol", "time", "volume")(clean.signed_log1p), f"WITH {B30} SELECT symbol, {T}, {r('volume=sign(volume) * ln(1 + abs(volume))')} FROM bars")
add("b12_calendar", rows("symbol", "time", "hour", "day_of_week", "is_weekend")(lambda b: clean.add_calendar(b).filter("hour IS NOT NULL")),
    f"WITH {B30}, k AS (SELECT *, lag(time) OVER {W} AS t FROM bars) SELECT symbol, {T}, CAST(hour(t) AS BIGINT) AS hour, CAST(isodow(t) - 1 AS BIGINT) AS day_of_week, CAST(isodow(t) >= 6 AS BIGINT) AS is_weekend FROM k WHERE t IS NOT NULL")
add("b14_column_profile", lambda spark, d: fx.rounded(clean.column_profile(fx.bars(spark, d).withColumns({"flag": (c("close") > 50).cast("int"), "nothing": F.lit(0.0)}), ["close", "flag", "nothing"])),
    f"WITH {B30}, u AS (SELECT 'close' AS feature, close AS v FROM bars UNION ALL SELECT 'flag', CAST(close > 50 AS INT) FROM bars UNION ALL SELECT 'nothing', 0 FROM bars) SELECT feature, count(DISTINCT v) AS n_distinct, {r('max_abs=max(abs(v))')}, bool_and(v IN (0, 1)) AS is_binary FROM u GROUP BY 1")
add("b14_drop_constant", rows()(lambda b: clean.drop_constant(b.withColumns({"flag": (c("close") > 50).cast("int"), "nothing": F.lit(0.0)}), [*OHLCV, "flag", "nothing"])), f"WITH {B30} SELECT symbol, {T}, {r(*OHLCV)}, CAST(close > 50 AS BIGINT) AS flag FROM bars")
add("b15_zeros_ffill",lambda spark, d: fx.rounded(clean.zeros_to_ffill(fx.dirty_bars(spark, d), ["close"]), "symbol", "time", "close"), f"WITH {DIRTY}, f AS (SELECT symbol, time, last_value(nullif(close, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS close FROM dirty) SELECT symbol, {T}, {r('close')} FROM f")
for k, e in (("median", "quantile_cont(close, 0.5)"), ("mean", "avg(close)")):
    add(f"b16_impute_{k}", lambda spark, d, k=k: fx.rounded(clean.impute(fx.dirty_bars(spark, d), ["close"], k), "symbol", "time", "close"), f"WITH {DIRTY} SELECT symbol, {T}, {r(f'close=coalesce(close, (SELECT {e} FROM dirty))')} FROM dirty")
add("b17_conform", lambda spark, d: fx.rounded(clean.conform(fx.dirty_bars(spark, d), ["volume", "close", "extra"], {"close": 7.0})), f"WITH {DIRTY} SELECT symbol, {T}, {r('volume', 'close=coalesce(close, 7)', 'extra=0')} FROM dirty")
add("b18_drop_warmup", rows("symbol", "time", "close")(clean.drop_warmup), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars QUALIFY row_number() OVER {W} > 151")
add("b19_diff_features", rows("symbol", "time", "close", "volume")(lambda b: clean.diff_features(b, ["close", "volume"])), f"WITH {B30} SELECT symbol, {T}, {r(f'close=lag(close) OVER {W} - lag(close, 2) OVER {W}', f'volume=lag(volume) OVER {W} - lag(volume, 2) OVER {W}')} FROM bars")

# --- C ---
_R = "WITH {b}, o AS (SELECT symbol, time_bucket(INTERVAL 60 MINUTE, time) AS t, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(volume) AS volume FROM b5 GROUP BY 1, 2) SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, {c} FROM o"
add("c01_resample", lambda spark, d: fx.rounded(align.resample(fx.bars(spark, d, "5 minutes"), "60 minutes")), _R.format(b=named_bars(5, "b5"), c=r(*OHLCV)))
_SAFE = f"""k AS (SELECT *, time_bucket(INTERVAL 240 MINUTE, time) AS t, row_number() OVER (PARTITION BY symbol, time_bucket(INTERVAL 240 MINUTE, time) ORDER BY time) AS i, count(*) OVER (PARTITION BY symbol, time_bucket(INTERVAL 240 MINUTE, time)) AS n FROM bars),
s AS (SELECT symbol, t, first(open ORDER BY time) AS open, max(high) FILTER (WHERE n = 1 OR i <= n - 2) AS high, min(low) FILTER (WHERE n = 1 OR i <= n - 2) AS low, last(close ORDER BY time) FILTER (WHERE n = 1 OR i <= n - 2) AS close, coalesce(sum(volume) FILTER (WHERE n = 1 OR i <= n - 2), 0) AS volume FROM k GROUP BY 1, 2)"""
add("c02_safe_resample", lambda spark, d: fx.rounded(align.safe_resample(fx.bars(spark, d), "240 minutes")), f"WITH {B30}, {_SAFE} SELECT symbol, strftime(t, '%Y-%m-%d %H:%M:%S') AS time, {r(*OHLCV)} FROM s")
add("c03_merge_timeframes", lambda spark, d: fx.rounded(align.merge_timeframes(fx.bars(spark, d).select("symbol", "time", "close"), {"1H": fx.bars(spark, d, "60 minutes").select("symbol", "time", "close"), "15T": fx.bars(spark, d, "15 minutes").select("symbol", "time", "close")}), "symbol", "time", "30T_close", "1H_close", "15T_close"),
    f"""WITH {B30}, {named_bars(60, 'b60')}, {named_bars(15, 'b15')}, j AS (SELECT symbol, time, bars.close AS a, b60.close AS b, b15.close AS e FROM bars FULL JOIN b60 USING (symbol, time) FULL JOIN b15 USING (symbol, time)),
f AS (SELECT symbol, time, {', '.join(f'last_value({k} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS {k}' for k in 'abe')} FROM j)
SELECT symbol, {T}, {r('"30T_close"=a', '"1H_close"=b', '"15T_close"=e')} FROM f WHERE isodow(time) < 6""")
add("c04_join_exact", lambda spark, d: fx.rounded(align.join_exact({"a": fx.bars(spark, d).select("symbol", "time", "close"), "b": fx.bars(spark, d, "60 minutes").select("symbol", "time", "close"), "c": fx.bars(spark, d, "15 minutes").select("symbol", "time", "close")})),
    f"WITH {B30}, {named_bars(60, 'b60')}, {named_bars(15, 'b15')} SELECT symbol, {T}, {r('close_a=bars.close', 'close_b=b60.close', 'close_c=b15.close')} FROM bars JOIN b60 USING (symbol, time) JOIN b15 USING (symbol, time)")
add("c05_keep_common", lambda spark, d: fx.rounded(align.keep_common(fx.bars(spark, d), fx.bars(spark, d, "60 minutes"), 40), "symbol", "time", "close"), f"WITH {B30}, {named_bars(60, 'b60')} SELECT symbol, {T}, {r('close')} FROM bars SEMI JOIN b60 USING (symbol, time) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 40")
add("c06_asof", lambda spark, d: fx.rounded(align.asof_value(fx.bars(spark, d, "15 minutes"), fx.bars(spark, d, "60 minutes"), ["close", "volume"])), f"WITH {named_bars(15, 'b15')}, {named_bars(60, 'b60')} SELECT symbol, {T}, {r('close=b.close', 'volume=b.volume')} FROM b15 a ASOF LEFT JOIN b60 b USING (symbol, time)")
add("c07_label_at", lambda spark, d: fx.rounded(align.label_at(fx.bars(spark, d, "15 minutes").select("symbol", "time"), fx.bars(spark, d)).withColumn("y", c("y").cast("double"))), f"WITH {named_bars(15, 'b15')}, {B30}, k AS (SELECT symbol, time, CASE WHEN lead(close) OVER {W} IS NOT NULL THEN CAST(lead(close) OVER {W} > close AS INT) END AS y FROM bars) SELECT symbol, {T}, {r('y')} FROM b15 LEFT JOIN k USING (symbol, time)")
add("c08_latest_common", lambda spark, d: fx.rounded(align.latest_common_time({m: fx.bars(spark, d, f"{m} minutes") for m in ("5", "15", "60")})), f"WITH {named_bars(5, 'b5')}, {named_bars(15, 'b15')}, {named_bars(60, 'b60')} SELECT symbol, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS time FROM b5 JOIN b15 USING (symbol, time) JOIN b60 USING (symbol, time) GROUP BY symbol")


def _trimmed(spark, d):
    out = None
    for tf, df in align.trim_to_common({m: fx.bars(spark, d, f"{m} minutes") for m in ("5", "15", "60")}).items():
        own = df.select("symbol", F.lit(tf).alias("tf"), "time", "close")
        out = own if out is None else out.unionByName(own)
    return fx.rounded(out)


add("c08_trim_to_common", _trimmed, f"WITH {named_bars(5, 'b5')}, {named_bars(15, 'b15')}, {named_bars(60, 'b60')}, z AS (SELECT symbol, max(time) AS z FROM b5 JOIN b15 USING (symbol, time) JOIN b60 USING (symbol, time) GROUP BY symbol), u AS (SELECT '5' AS tf, * FROM b5 UNION ALL SELECT '15', * FROM b15 UNION ALL SELECT '60', * FROM b60) SELECT symbol, tf, {T}, {r('close')} FROM u JOIN z USING (symbol) WHERE time <= z")
add("c09_bar_at",lambda spark, d: fx.rounded(align.bar_at(fx.bars(spark, d, "5 minutes").select("symbol", "time"), fx.bars(spark, d).select("symbol", "time", "close"), "30T")), f"WITH {named_bars(5, 'b5')}, {B30} SELECT b5.symbol, strftime(b5.time, '%Y-%m-%d %H:%M:%S') AS time, strftime(bars.time, '%Y-%m-%d %H:%M:%S') AS bar_time, {r('close=bars.close')} FROM b5 JOIN bars ON b5.symbol = bars.symbol AND time_bucket(INTERVAL 30 MINUTE, b5.time) = bars.time")
add("c10_alignment", lambda spark, d: fx.rounded(align.check_alignment(align.merge_timeframes(fx.bars(spark, d).select("symbol", "time", "close"), {"1H": fx.bars(spark, d, "60 minutes").select("symbol", "time", "close")}), "30T")),
    f"""WITH {B30}, {named_bars(60, 'b60')}, m AS (SELECT symbol, max(time) AS a FROM bars GROUP BY 1), h AS (SELECT symbol, max(time) AS b FROM b60 GROUP BY 1), lim AS (SELECT symbol, max(time) AS z FROM (SELECT symbol, time FROM bars UNION SELECT symbol, time FROM b60) WHERE isodow(time) < 6 GROUP BY 1),
u AS (SELECT symbol, '30T' AS tf, (SELECT max(time) FROM bars x WHERE x.symbol = lim.symbol AND time <= z) AS l, 0 AS al FROM lim UNION ALL SELECT symbol, '1H', (SELECT max(time) FROM b60 x WHERE x.symbol = lim.symbol AND time <= z), 30 FROM lim),
v AS (SELECT u.*, (SELECT max(time) FROM bars x, lim WHERE x.symbol = u.symbol AND lim.symbol = u.symbol AND time <= z) AS mm FROM u)
SELECT symbol, tf, strftime(l, '%Y-%m-%d %H:%M:%S') AS last, {r('late_minutes=abs(epoch_us(mm) - epoch_us(l)) / 6e7')}, abs(epoch_us(mm) - epoch_us(l)) / 6e7 <= al AS aligned FROM v""")
add("c11_concat_history", lambda spark, d: fx.rounded(align.concat_history(fx.bars(spark, d).filter("time < '2024-01-20'"), fx.bars(spark, d).filter("time >= '2024-01-19'").withColumn("close", c("close") + 1), 200), "symbol", "time", "close"),
    f"WITH {B30} SELECT symbol, {T}, {r('close=CASE WHEN time >= TIMESTAMP' + chr(39) + '2024-01-19' + chr(39) + ' THEN close + 1 ELSE close END')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 200")

# --- D ---
LAB = f"lab AS (SELECT *, CASE WHEN lead(close) OVER {W} IS NOT NULL THEN CAST(lead(close) OVER {W} > close AS INT) END AS y FROM bars)"
add("d01_day_profile", rows()(lambda b: stats.day_profile(frame.label_next_up(b))), f"WITH {B30}, {LAB} SELECT symbol, CAST(CAST(time AS DATE) AS VARCHAR) AS day, count(DISTINCT y) AS n_labels, {r('close_range=max(close) - min(close)', 'close_mean=avg(close)')} FROM lab WHERE y IS NOT NULL GROUP BY 1, 2")
for k, e in (("day", "CAST(time AS DATE)"), ("week", "isoyear(time), weekofyear(time)")):
    add(f"d02_last_of_{k}", rows("symbol", "time", "is_last")(lambda b, k=k: stats.last_bar_flags(b, k)), f"WITH {B30} SELECT symbol, {T}, time = max(time) OVER (PARTITION BY symbol, {e}) AS is_last FROM bars")
LONG = "u AS (SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS feature, unnest([open, high, low, close, volume]) AS value, * FROM bars)"
add("d03_distinct_counts", rows()(lambda b: stats.distinct_counts(b, OHLCV)), f"WITH {B30}, {LONG} SELECT feature, count(DISTINCT value) AS n_distinct FROM u GROUP BY 1")
add("d04_quantiles", rows()(lambda b: stats.quantiles(b, OHLCV, [0.1, 0.5, 0.99])), f"WITH {B30}, {LONG}, q AS (SELECT feature, unnest([0.1, 0.5, 0.99]) AS p, unnest([quantile_cont(value, 0.1), quantile_cont(value, 0.5), quantile_cont(value, 0.99)]) AS value FROM u GROUP BY 1) SELECT feature, {r('p', 'value')} FROM q")
EDGES = "s AS (SELECT feature, min(value) AS a, max(value) AS b FROM {u} GROUP BY 1), g AS (SELECT feature, a, b, unnest(range(0, 10)) AS bin FROM s), e AS (SELECT feature, bin, a + (b - a) * bin / 10 AS lo, CASE WHEN bin = 9 THEN b ELSE a + (b - a) * (bin + 1) / 10 END AS hi FROM g)"
HIST = "{h} AS (SELECT e.feature, e.bin, any_value(lo) AS lo, any_value(hi) AS hi, count(value) AS n FROM e LEFT JOIN {u} k ON k.feature = e.feature AND value >= lo AND (value < hi OR (bin = 9 AND value <= hi)) GROUP BY 1, 2)"
add("d05_histogram", rows()(lambda b: stats.histogram(b, stats.equal_edges(b, OHLCV, 10), OHLCV)), f"WITH {B30}, {LONG}, {EDGES.format(u='u')}, {HIST.format(h='h', u='u')} SELECT feature, bin, {r('lo', 'hi')}, n, {r('freq=n / sum(n) OVER (PARTITION BY feature)')} FROM h")
add("d06_signal_counts", on_scored()(lambda s: stats.signal_counts(s.withColumn("signal", decide.signal(c("decision"))))), f"WITH {SCORED} SELECT symbol, count(*) FILTER (WHERE decision = 1) AS n_buy, count(*) FILTER (WHERE decision = 0) AS n_sell, count(*) FILTER (WHERE decision = -1) AS n_none, {r('coverage=100 * count(*) FILTER (WHERE decision <> -1) / count(*)')} FROM scored GROUP BY 1")
add("d07_vote_count", lambda spark, d: fx.rounded(stats.vote_count(fx.table(spark, d, "events"), "user_id", 60)), "SELECT user_id, count(*) AS votes FROM events GROUP BY 1 HAVING count(*) >= 60")
add("d08_top_k", rows("symbol", "time", "close")(lambda b: stats.top_k(b.withColumn("k", F.concat_ws("|", "symbol", c("time").cast("string"))), "close", 25, "k")), f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM (SELECT * FROM bars ORDER BY close DESC, symbol, time LIMIT 25)")
add("d09_union_reports", lambda spark, d: fx.rounded(stats.union_reports({"ml": (decide.classification_metrics(fx.scored(spark, d)), {"symbol": "model", "accuracy": "acc", "f1": "f1"}), "deep": (decide.classification_metrics(fx.second_feed(fx.scored(spark, d))), {"symbol": "model", "accuracy": "acc"})})),
    f"WITH {SCORED}, k AS (SELECT symbol, {COUNTS} FROM scored GROUP BY 1) SELECT 'ml' AS family, symbol AS model, {r('acc=coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)', 'f1=coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} FROM k UNION ALL SELECT 'deep', symbol, {r('acc=coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0)')}, NULL FROM k")

# --- H ---
add("h01_label", rows("symbol", "time", "close", "y")(frame.label_next_up), f"WITH {B30}, {LAB} SELECT symbol, {T}, {r('close')}, CAST(y AS BIGINT) AS y FROM lab WHERE y IS NOT NULL")
add("h03_drop_last", rows("symbol", "time")(frame.drop_last), f"WITH {B30} SELECT symbol, {T} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) > 1")
add("h04_flat_days", lambda spark, d: fx.rounded(frame.drop_flat_days(frame.label_next_up(fx.bars(spark, d).withColumn("close", F.when(F.dayofmonth("time") % 3 == 0, 50.0).otherwise(c("close"))))), "symbol", "time", "close"),
    f"""WITH {B30}, b AS (SELECT symbol, time, CASE WHEN day(time) % 3 = 0 THEN 50.0 ELSE close END AS close FROM bars), l AS (SELECT *, CAST(lead(close) OVER {W} > close AS INT) AS y, lead(close) OVER {W} AS nx FROM b), m AS (SELECT * FROM l WHERE nx IS NOT NULL),
f AS (SELECT symbol, CAST(time AS DATE) AS day FROM m GROUP BY 1, 2 HAVING count(DISTINCT y) <= 1 AND max(close) - min(close) <= 1e-4 * greatest(1.0, avg(close)))
SELECT symbol, {T}, {r('close')} FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol = m.symbol AND f.day = CAST(m.time AS DATE))""")
LAGS = [f"{k}_tminus{i}" for k in ("close", "volume") for i in range(4)]
add("h05_stack_lags", rows("symbol", "time", *LAGS)(lambda b: frame.stack_lags(b, ["close", "volume"], 4)), f"WITH {B30} SELECT symbol, {T}, {r(*[f'{n}=lag({n[:-8]}, {n[-1]}) OVER {W}' for n in LAGS])} FROM bars QUALIFY row_number() OVER {W} >= 4")
add("h07_chrono_split", rows("symbol", "time", "split")(lambda b: frame.chrono_split(b, {"train": 0.85, "threshold": 0.05, "test": 0.1})), f"WITH {B30}, k AS (SELECT *, (row_number() OVER {W} - 1) / count(*) OVER (PARTITION BY symbol) AS p FROM bars) SELECT symbol, {T}, CASE WHEN p < 0.85 THEN 'train' WHEN p < 0.9 THEN 'threshold' ELSE 'test' END AS split FROM k")
add("h08_folds", rows("symbol", "time", "test_fold")(lambda b: frame.ts_folds(b, 3)), f"WITH {B30}, k AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), j AS (SELECT *, n // 4 AS s, n - 3 * (n // 4) AS f FROM k) SELECT symbol, {T}, CAST(CASE WHEN i <= f OR s = 0 THEN 0 ELSE ceil((i - f) / s) END AS BIGINT) AS test_fold FROM j")
add("h02_ready", lambda spark, d: fx.rounded(frame.ready(fx.bars(spark, d), features=["volume_tminus2", "high_tminus0"])),
    f"""WITH {B30}, {LAB}, m AS (SELECT * FROM lab WHERE y IS NOT NULL), f AS (SELECT symbol, CAST(time AS DATE) AS day FROM m GROUP BY 1, 2 HAVING count(DISTINCT y) <= 1 AND max(close) - min(close) <= 1e-4 * greatest(1.0, avg(close))),
k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.symbol = m.symbol AND f.day = CAST(m.time AS DATE)))
SELECT symbol, {T}, {r('close')}, CAST(y AS BIGINT) AS y, {r(f'volume_tminus2=lag(volume, 2) OVER {W}', 'high_tminus0=high')} FROM k QUALIFY row_number() OVER {W} >= 3""")
EVERY = {"30T": "30 minutes", "1H": "60 minutes", "15T": "15 minutes", "5T": "5 minutes"}
add("h09_feature_frame", lambda spark, d: fx.rounded(feature_frame({tf: fx.bars(spark, d, every) for tf, every in EVERY.items()}, "30T")))
CHOSEN = ("sma10", "momentum", "bb_percent")
_PART = ["open", "high", "low", "close", "volume", *CHOSEN, "hour", "day_of_week", "is_weekend"]


def _frame_parts(m):
    """CTEs of one timeframe, from bars over repaired closes and indicators to the calendar, up to ``c{m}``."""
    filled = lambda k: f"last_value({k} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)"
    full = lambda f, e="close", n=10: f"CASE WHEN count({e}) OVER {fr(n)} >= {n} THEN {f}({e}) OVER {fr(n)} END"
    return f"""{named_bars(m, f'b{m}')}, s{m} AS (SELECT symbol, avg(close) AS m, stddev_samp(close) AS s FROM b{m} GROUP BY 1),
k{m} AS (SELECT d.*, close IS NULL OR close = 0 OR coalesce(abs(close - m) > 3 * s, false) AS bad, lead(close) OVER w AS nx, row_number() OVER w = 1 AS fst, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1 AS lst FROM b{m} d JOIN s{m} USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY time)),
e{m} AS (SELECT *, {{'a': CASE WHEN bad AND NOT fst THEN CASE WHEN lst THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0::DOUBLE END, 'b': CASE WHEN NOT bad THEN close WHEN fst THEN coalesce(nx, 'nan'::DOUBLE) WHEN lst THEN 0 ELSE coalesce(nx / 2, 'nan'::DOUBLE) END}} AS e FROM k{m}),
o{m} AS (SELECT symbol, time, open, high, low, volume, list_reduce(list(e) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), lambda s, t: {{'a': s.a * t.a, 'b': CASE WHEN t.a = 0 THEN t.b ELSE t.a * s.b + t.b END}}).b AS v FROM e{m}),
r{m} AS (SELECT symbol, time, open, high, low, CASE WHEN isnan(v) THEN NULL ELSE v END AS close, volume FROM o{m}),
x{m} AS (SELECT *, {full('avg')} AS sma, close - lag(close, 14) OVER {W} AS mo, {full('avg', n=20)} AS mid, {full('stddev_samp', n=20)} AS dev FROM r{m}),
i{m} AS (SELECT *, lag(sma) OVER {W} AS sma10, lag(mo) OVER {W} AS momentum, (lag(close) OVER {W} - lag(mid - 2 * dev) OVER {W}) / nullif(lag(mid + 2 * dev) OVER {W} - lag(mid - 2 * dev) OVER {W}, 0) AS bb_percent FROM x{m}),
f{m} AS (SELECT * REPLACE ({', '.join(f"{filled(f'CASE WHEN isfinite({k}) THEN {k} END')} AS {k}" for k in CHOSEN)}) FROM i{m}),
g{m} AS (SELECT *, lag(time) OVER {W} AS t FROM f{m} WHERE {' OR '.join(f'{k} IS NOT NULL' for k in CHOSEN)}),
c{m} AS (SELECT symbol, time, {', '.join(f'{e} AS {k}_{m}' for k, e in {**{k: k for k in _PART}, 'volume': 'ln(1 + volume)', 'hour': 'hour(t)', 'day_of_week': 'isodow(t) - 1', 'is_weekend': 'CAST(isodow(t) >= 6 AS INT)'}.items())} FROM g{m})"""


_MINUTES = {"30T": 30, "1H": 60, "15T": 15, "5T": 5}
_ALL_PARTS = [(tf, k, f"{k}_{m}") for tf, m in _MINUTES.items() for k in _PART]
add("h09_chosen_features", lambda spark, d: fx.rounded(feature_frame({tf: fx.bars(spark, d, every) for tf, every in EVERY.items()}, "30T", only=CHOSEN, stable=False).drop(*[f"{tf}_time" for tf in EVERY]), digits=4),
    f"""WITH {', '.join(_frame_parts(m) for m in _MINUTES.values())}, j AS (SELECT * FROM c30 FULL JOIN c60 USING (symbol, time) FULL JOIN c15 USING (symbol, time) FULL JOIN c5 USING (symbol, time)),
z AS (SELECT symbol, time, {', '.join(f'last_value({n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS {n}' for _, _, n in _ALL_PARTS)} FROM j)
SELECT symbol, {T}, {r(*[f'"{tf}_{k}"={n}' for tf, k, n in _ALL_PARTS if k not in _PART[-3:]], digits=4)}, {', '.join(f'CAST({n} AS BIGINT) AS "{tf}_{k}"' for tf, k, n in _ALL_PARTS if k in _PART[-3:])} FROM z WHERE isodow(time) < 6""")

# --- I ---
OLD, NEW = (lambda b: b.filter("time < '2024-01-15'")), (lambda b: b.filter("time >= '2024-01-15'"))
COLS = ["close", "high", "volume"]
SUB = "u AS (SELECT unnest(['close', 'high', 'volume']) AS feature, unnest([close, high, volume]) AS value, time FROM bars)"
add("i01_variance", rows()(lambda b: stats.variance_filter(b, COLS, 3.0)), f"WITH {B30}, {SUB} SELECT feature, {r('variance=var_pop(value)')}, var_pop(value) > 3 AS kept FROM u GROUP BY 1")
add("i02_corr_pairs", rows("a", "b", "r")(lambda b: stats.correlation_pairs(b, COLS)), f"WITH {B30} SELECT 'close' AS a, 'high' AS b, {r('r=corr(close, high)')} FROM bars UNION ALL SELECT 'close', 'volume', {r('r=corr(close, volume)')} FROM bars UNION ALL SELECT 'high', 'volume', {r('r=corr(high, volume)')} FROM bars")
add("i02_corr_filter", rows()(lambda b: stats.corr_filter(b, COLS, 0.3)), f"WITH {B30}, k AS (SELECT corr(close, high) AS ch, corr(close, volume) AS cv, corr(high, volume) AS hv FROM bars) SELECT 'close' AS feature, false AS dropped UNION ALL SELECT 'high', abs(ch) > 0.3 FROM k UNION ALL SELECT 'volume', abs(cv) > 0.3 OR abs(hv) > 0.3 FROM k")
_PSI = "(ln({0} + 8.0) - 1 / (2 * ({0} + 8.0)) - pow({0} + 8.0, -2) / 12 + pow({0} + 8.0, -4) / 120 - pow({0} + 8.0, -6) / 252 + pow({0} + 8.0, -8) / 240 - pow({0} + 8.0, -10) / 132 - list_sum([1 / ({0} + step) FOR step IN range(0, 8)]))"


def neighbour_information(source):
    """CTEs up to ``mi`` (f, feature, mi): nearest-neighbour information of (f, feature, value, y), whose rows are counted one by one."""
    lag = lambda k: f"lead(value, {k}) OVER p" if k > 0 else f"lag(value, {-k}) OVER p"
    near = ", ".join(f"{{'d': abs({lag(k)} - value), 'v': {lag(k)}}}" for k in (-3, -2, -1, 1, 2, 3))
    return f"""nn AS (SELECT *, count(*) OVER (PARTITION BY f, feature, y) AS c, list_sort(list_filter([{near}], lambda z: z.d IS NOT NULL)) AS near FROM {source} WINDOW p AS (PARTITION BY f, feature, y ORDER BY value)),
nk AS (SELECT f, feature, value, c, least(3, c - 1) AS k, near[least(3, c - 1)] AS e FROM nn WHERE c > 1),
ends AS (SELECT *, CASE WHEN e.v < value THEN e.v ELSE value - e.d END AS lo, CASE WHEN e.v > value THEN e.v ELSE value + e.d END AS hi, row_number() OVER () AS id FROM nk),
inside AS (SELECT a.id, count(*) AS m FROM ends a JOIN nk b ON b.f = a.f AND b.feature = a.feature AND ((a.e.d > 0 AND b.value > a.lo AND b.value < a.hi) OR (a.e.d = 0 AND b.value = a.value)) GROUP BY 1),
mi AS (SELECT f, feature, greatest({_PSI.format('count(*)')} + avg({_PSI.format('k')}) - avg({_PSI.format('c')}) - avg({_PSI.format('m')}), 0) AS mi FROM ends JOIN inside USING (id) GROUP BY 1, 2)"""


add("i03_mutual_information", lambda spark, d: fx.rounded(stats.mutual_information(frame.label_next_up(fx.bars(spark, d)), ["close", "high"], "y")),
    f"WITH {B30}, {LAB}, u AS (SELECT 0 AS f, unnest(['close', 'high']) AS feature, unnest([close, high]) AS value, y FROM lab WHERE y IS NOT NULL), {neighbour_information('u')} SELECT feature, {r('mi')} FROM mi")
_PAIRS = [(a, b) for i, a in enumerate(OHLCV) for b in OHLCV[i + 1 :]]
add("i04_select_features", lambda spark, d: fx.rounded(stats.select_features(frame.label_next_up(frame.ts_folds(fx.bars(spark, d), 2)), OHLCV, "y", "test_fold", 3)),
    f"""WITH {B30}, {LAB}, n AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS m FROM bars),
fd AS (SELECT *, CASE WHEN i <= m - 2 * (m // 3) OR m < 3 THEN 0 ELSE ceil((i - (m - 2 * (m // 3))) / (m // 3)) END AS fold FROM n),
x AS (SELECT g.f, fd.*, lab.y FROM fd JOIN lab USING (symbol, time), (VALUES (1), (2)) g(f) WHERE fold < g.f AND lab.y IS NOT NULL),
cr AS (SELECT f, {', '.join(f"corr({a}, {b}) AS {a}_{b}" for a, b in _PAIRS)} FROM x GROUP BY f),
va AS (SELECT f, {', '.join(f"var_pop({k}) > 0.01 AS {k}" for k in OHLCV)} FROM x GROUP BY f),
gone AS ({' UNION '.join(f"SELECT f, '{b}' AS feature FROM cr JOIN va USING (f) WHERE va.{a} AND va.{b} AND abs({a}_{b}) > 0.9" for a, b in _PAIRS)} UNION {' UNION '.join(f"SELECT f, '{k}' FROM va WHERE NOT {k}" for k in OHLCV)}),
u AS (SELECT f, unnest([{', '.join(f"'{k}'" for k in OHLCV)}]) AS feature, unnest([{', '.join(OHLCV)}]) AS value, y FROM x),
v AS (SELECT u.* FROM u ANTI JOIN gone USING (f, feature)), {neighbour_information('v')},
best AS (SELECT * FROM mi QUALIFY row_number() OVER (PARTITION BY f ORDER BY mi DESC, feature) <= 3)
SELECT feature, count(*) AS votes FROM best GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(mi) DESC, 1 LIMIT 3""")
add("i05_rank_by_corr", lambda spark, d: fx.rounded(stats.rank_by_target_corr(frame.label_next_up(fx.bars(spark, d)), OHLCV, "y", 3)),
    f"WITH {B30}, {LAB}, u AS (SELECT unnest(['open', 'high', 'low', 'close', 'volume']) AS feature, unnest([open, high, low, close, volume]) AS v, y FROM lab WHERE y IS NOT NULL), k AS (SELECT feature, abs(corr(v, y)) AS r FROM u GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT feature, {r('r')} FROM k")
add("i06_select_strong", lambda spark, d: stats.select_strong(frame.label_next_up(fx.bars(spark, d)), OHLCV, "y", 3).select("feature"))
add("i07_unstable", lambda spark, d: fx.rounded(stats.unstable_columns(fx.dirty_bars(spark, d), ["close", "high"], 8, 5)),
    f"WITH {DIRTY}, k AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY symbol) AS m FROM dirty), s AS (SELECT * FROM k WHERE (i - 1) % CAST(ceil(m / 8) AS BIGINT) % 5 = 4 OR i = m), u AS (SELECT unnest(['close', 'high']) AS feature, unnest([close, high]) AS v FROM s), a AS (SELECT feature, count(*) AS samples, count(*) FILTER (WHERE v IS NULL OR v = 0) AS fails FROM u GROUP BY 1) SELECT feature, samples, fails, {r('ratio=fails / samples')}, fails / samples >= 0.12 OR fails >= 8 AS unstable FROM a")
add("i08_heavy", rows()(lambda b: stats.heavy_columns(b, OHLCV, 1.5)), f"WITH {B30}, {LONG}, k AS (SELECT feature, quantile_cont(value, 0.99) / nullif(abs(quantile_cont(value, 0.5)), 0) AS ratio FROM u GROUP BY 1) SELECT feature, {r('ratio')} FROM k WHERE ratio > 1.5")
KS = "st AS (SELECT {g}feature, value, count(*) FILTER (WHERE s = 0) AS a, count(*) FILTER (WHERE s = 1) AS b FROM {u} GROUP BY ALL), gp AS (SELECT {g}feature, abs(sum(a) OVER w / nullif(sum(a) OVER (PARTITION BY {g}feature), 0) - sum(b) OVER w / nullif(sum(b) OVER (PARTITION BY {g}feature), 0)) AS gap, a, b FROM st WINDOW w AS (PARTITION BY {g}feature ORDER BY value ROWS UNBOUNDED PRECEDING))"
add("i09_ks", rows()(lambda b: stats.ks_statistic(OLD(b), NEW(b), COLS)), f"WITH {B30}, {SUB}, v AS (SELECT feature, value, CAST(time >= {HALF} AS INT) AS s FROM u), {KS.format(g='', u='v')} SELECT feature, {r('ks=max(gap)')} FROM gp GROUP BY 1")
add("i10_start_date", lambda spark, d: fx.rounded(stats.suggest_start_date(fx.bars(spark, d), ["close"], "time", 5, 5, 0.35, 100)),
    f"""WITH {B30}, l AS (SELECT min(time) AS f, max(time) AS t FROM bars), n AS (SELECT f, t, unnest(range(0, 400)) AS i FROM l), cand AS (SELECT t - INTERVAL 5 DAY - to_days(CAST(5 * i AS INTEGER)) AS start FROM n WHERE t - INTERVAL 5 DAY - to_days(CAST(5 * i AS INTEGER)) >= f),
v AS (SELECT start, 'close' AS feature, close AS value, CAST(time >= start AS INT) AS s FROM bars, cand), {KS.format(g='start, ', u='v')},
k AS (SELECT start, max(gap) AS ks, CAST(sum(a) AS BIGINT) AS older, CAST(sum(b) AS BIGINT) AS newer FROM gp GROUP BY 1), o AS (SELECT *, ks < 0.35 AND older >= 100 AND newer >= 100 AS ok FROM k)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, {r('ks')}, older, newer, ok, start IS NOT DISTINCT FROM (SELECT max(start) FROM o WHERE ok) AS suggested FROM o""")
add("i11_psi", rows()(lambda b: stats.psi_compare(OLD(b), NEW(b), COLS)),
    f"""WITH {B30}, {SUB}, ua AS (SELECT * FROM u WHERE time < {HALF}), ub AS (SELECT * FROM u WHERE time >= {HALF}), {EDGES.format(u='ua')}, {HIST.format(h='ha', u='ua')}, {HIST.format(h='hb', u='ub')},
f AS (SELECT ha.feature, CASE WHEN ha.n = 0 THEN 1e-9 ELSE ha.n / sum(ha.n) OVER (PARTITION BY ha.feature) END AS p, CASE WHEN hb.n = 0 THEN 1e-9 ELSE hb.n / sum(hb.n) OVER (PARTITION BY ha.feature) END AS q FROM ha JOIN hb USING (feature, bin)),
ps AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM f GROUP BY 1), t AS (SELECT * FROM ps UNION ALL SELECT '*', avg(psi) FROM ps) SELECT feature, {r('psi')}, psi > 0.05 AS alarm FROM t""")
add("i12_mean_shift", rows()(lambda b: stats.mean_shift_stability(OLD(b), NEW(b), "close")), f"WITH {B30} SELECT {r(f'stability=1 - abs(avg(close) FILTER (WHERE time >= {HALF}) - avg(close) FILTER (WHERE time < {HALF}))')} FROM bars")
add("i13_correlation_gap", lambda spark, d: fx.rounded(stats.pearson_spearman_gap(frame.label_next_up(fx.bars(spark, d)), COLS, "y")),
    f"""WITH {B30}, {LAB}, u AS (SELECT unnest(['close', 'high', 'volume']) AS feature, unnest([close, high, volume]) AS v, y FROM lab WHERE y IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM u),
g AS (SELECT feature, abs(corr(v, y)) AS p, abs(corr(rx, ry)) AS s FROM k GROUP BY 1) SELECT {r('pearson=avg(p)', 'spearman=avg(s)', 'gap=avg(s) - avg(p)')} FROM g""")
add("i16_scaler_report", rows()(lambda b: stats.scaler_report(OLD(b), NEW(b), COLS)),
    f"WITH {B30}, {SUB}, k AS (SELECT feature, avg(value) FILTER (WHERE time < {HALF}) AS mean_a, stddev_pop(value) FILTER (WHERE time < {HALF}) AS std_a, avg(value) FILTER (WHERE time >= {HALF}) AS mean_b, stddev_pop(value) FILTER (WHERE time >= {HALF}) AS std_b FROM u GROUP BY 1) SELECT feature, {r('mean_a', 'std_a', 'mean_b', 'std_b', 'd_mean=mean_b - mean_a', 'd_std=std_b - std_a')} FROM k")
