"""Queries of files and streams: inputs are derived from the given tables, written to the shared folder, and read back or streamed to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators import models, stats
from barspark.plans import fixtures as fx
from barspark.plans.indicator_queries import fr, span
from barspark.plans.operator_queries import B30, EDGES, HALF, HIST, SCORED, T, named_bars, r
from barspark.sources import bars as src
from barspark.sources import store
from barspark.storage import shared_folder
from barspark.streaming import live

c = F.col
QUERIES, ORACLES = {}, {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/barspark/stream-{uuid.uuid4().hex}"


def streamed(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as a stream of files, times as timestamps; and a folder for what follows."""
    f = folder(df.sparkSession)
    df = df.withColumn("time", c("time").cast("timestamp"))
    df.write.parquet(f"{f}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{f}/in"), f


def report(spark, d):
    path = f"{folder(spark)}/report"
    store.write_report(fx.bars(spark, d).select("symbol", "time", "close"), path, "csv")
    return fx.rounded(spark.read.option("header", True).schema("symbol string, time timestamp_ntz, close double").csv(path))


add("a06_report", report, f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars")
_CLOSE = "u AS (SELECT 'close' AS feature, close AS value, time FROM bars)"


def candle_file(df: DataFrame, path: str) -> str:
    """Bars of one series as a CSV file under other column names."""
    df.select(c("time").alias("Date"), "open", "high", "low", c("close").alias("Close"), "volume").write.option("header", True).csv(path)
    return path


def read_daily(spark, d):
    days = src.daily_bars(fx.table(spark, d, "orders"), F.lit("ALL"), "o_totalprice", "o_orderdate", "o_orderkey")
    return fx.rounded(src.read_bars(spark, candle_file(days, f"{folder(spark)}/daily"), "1D", "ALL"))


add("a01_read_bars", read_daily, f"SELECT 'ALL' AS symbol, '1D' AS tf, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS time, {r('open=first(o_totalprice ORDER BY o_orderkey)', 'high=max(o_totalprice)', 'low=min(o_totalprice)', 'close=last(o_totalprice ORDER BY o_orderkey)', 'volume=count(*)')} FROM orders GROUP BY o_orderdate")


def read_several(spark, d):
    """Bars of all events together at two timeframes; a third has no file."""
    f = folder(spark)
    file = lambda every, tf: candle_file(src.bars_from_events(fx.table(spark, d, "events"), every, F.lit("ALL")), f"{f}/{tf}")
    return fx.rounded(src.read_timeframes(spark, {"30T": [f"{f}/none", file("30 minutes", "30T")], "1H": file("60 minutes", "1H"), "5T": f"{f}/none"}, "30T", "ALL"))


_ALL = f"WITH {B30}, {named_bars(60, 'b60')}".replace("event_type", "'ALL'")
add("a02_read_timeframes", read_several, f"{_ALL}, u AS (SELECT '30T' AS tf, * FROM bars UNION ALL SELECT '1H', * FROM b60) SELECT symbol, tf, {T}, {r('open', 'high', 'low', 'close', 'volume')} FROM u")


def kept_model(spark, d):
    """Predictions of a line that was fitted, saved and loaded again; a line has a closed form."""
    path, bars = f"{folder(spark)}/model", fx.bars(spark, d)
    meta = {"window_size": 1, "neg_thr": 0.4, "pos_thr": 0.6, "feats": ["open"], "train_window_cols": ["open"], "schema_version": 1}
    store.save_model(models.fit_regressor(bars, ["open"], "close"), meta, path)
    model, meta = store.load_model(spark, path)
    return fx.rounded(model.transform(bars.select("symbol", "time", *meta["train_window_cols"])), "symbol", "time", "prediction", digits=4)


add("a09_model", kept_model, f"WITH {B30}, l AS (SELECT regr_intercept(close, open) AS a, regr_slope(close, open) AS b FROM bars) SELECT symbol, {T}, {r('prediction=a + b * open', digits=4)} FROM bars, l")


def distribution(spark, d):
    path, bars = f"{folder(spark)}/distribution", fx.bars(spark, d)
    store.save_distribution(stats.histogram(bars, stats.equal_edges(bars, ["close"], 10), ["close"]), path)
    return fx.rounded(store.load_distribution(spark, path))


add("a07_distribution", distribution, f"WITH {B30}, {_CLOSE}, {EDGES.format(u='u')}, {HIST.format(h='h', u='u')} SELECT feature, bin, {r('lo', 'hi', 'freq=n / sum(n) OVER (PARTITION BY feature)')} FROM h")


def blacklist(spark, d):
    """Users with many events, as names in a text file and in a summary."""
    f = folder(spark)
    counts = fx.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    counts.filter("n >= 80").select(F.concat(F.lit("u"), "user_id", F.lit("_tminus2"))).write.text(f"{f}/names")
    counts.select(F.concat(F.lit("u"), "user_id").alias("feature"), F.when(c("n") >= 75, c("n")).otherwise(0).alias("mismatch_cnt")).write.option("header", True).csv(f"{f}/summary")
    return store.load_blacklist(spark, (f"{f}/names",), (), (f"{f}/summary",))


add("a08_blacklist", blacklist, "SELECT 'u' || user_id AS feature FROM events GROUP BY user_id HAVING count(*) >= 75")


def waited(spark, d):
    one = lambda m, tf: fx.bars(spark, d, m).select("symbol", F.lit(tf).alias("tf"), "time", "close")
    stream, f = streamed(one("30 minutes", "30T").unionByName(one("60 minutes", "1H")).unionByName(one("15 minutes", "15T")))
    return fx.rounded(live.to_table(live.wait_all_timeframes(stream, "30T", ("1H", "15T")), f"{f}/out", f"{f}/c"))


add("n02_wait_all", waited, f"WITH {B30}, {named_bars(60, 'b60')}, {named_bars(15, 'b15')}, m AS (SELECT symbol, least((SELECT max(time) FROM b60 x WHERE x.symbol = s.symbol), (SELECT max(time) FROM b15 x WHERE x.symbol = s.symbol)) AS w FROM (SELECT DISTINCT symbol FROM bars) s) SELECT symbol, {T}, {r('close')} FROM bars JOIN m USING (symbol) WHERE time <= w")


def once(spark, d):
    stream, f = streamed(fx.bars(spark, d).select("symbol", "time", "close"))
    return fx.rounded(live.to_table(live.process_once(stream.union(stream)), f"{f}/out", f"{f}/c"))


add("n03_process_once", once, f"WITH {B30} SELECT symbol, {T}, {r('close')} FROM bars")


def features(spark, d):
    stream, f = streamed(fx.bars(spark, d))  # all files are one batch, whose rows the state takes by time
    return live.to_table(live.stream_features(stream), f"{f}/out", f"{f}/c")


_FEATURES = f"{B30}, ft AS (SELECT symbol, time, close, {span('close', 12)} AS ema12, {span('close', 26)} AS ema26, CASE WHEN count(close) OVER {fr(10)} >= 10 THEN avg(close) OVER {fr(10)} END AS sma10, sum(volume) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS cum_volume FROM bars)"
add("n04_stream_features", lambda spark, d: fx.rounded(features(spark, d), digits=4), f"WITH {_FEATURES} SELECT symbol, {T}, {r('close', 'ema12', 'ema26', 'sma10', 'cum_volume', digits=4)} FROM ft")


def decisions(spark, d):
    stream, f = streamed(features(spark, d))
    scored = live.stream_decisions(stream, lambda df: df.withColumn("p", F.round(1 / (1 + F.exp(-(c("ema12") - c("ema26")) / 10)), 6)), 0.45, 0.55)
    return fx.rounded(live.to_table(scored, f"{f}/out", f"{f}/c"), "symbol", "time", "signal")


add("n05_stream_decisions", decisions, f"WITH {_FEATURES}, q AS (SELECT *, round(1 / (1 + exp(-(ema12 - ema26) / 10)), 6) AS p FROM ft) SELECT symbol, {T}, CASE WHEN p >= 0.55 THEN 'BUY' WHEN p <= 0.45 THEN 'SELL' ELSE 'NONE' END AS signal FROM q")


def drift(spark, d):
    bars = fx.bars(spark, d)
    old = bars.filter("time < '2024-01-15'")
    train = stats.histogram(old, stats.equal_edges(old, ["close"], 10), ["close"])
    stream, f = streamed(bars.filter("time >= '2024-01-15'"))
    live.stream_drift(stream, train, ["close"], f"{f}/out", f"{f}/c").awaitTermination()
    return fx.rounded(spark.read.parquet(f"{f}/out"), "feature", "psi", "alarm")


add("n06_stream_drift", drift,
    f"""WITH {B30}, {_CLOSE}, ua AS (SELECT * FROM u WHERE time < {HALF}), ub AS (SELECT * FROM u WHERE time >= {HALF}), {EDGES.format(u='ua')}, {HIST.format(h='ha', u='ua')}, {HIST.format(h='hb', u='ub')},
f AS (SELECT ha.feature, CASE WHEN ha.n = 0 THEN 1e-9 ELSE ha.n / sum(ha.n) OVER () END AS p, CASE WHEN hb.n = 0 THEN 1e-9 ELSE hb.n / sum(hb.n) OVER () END AS q FROM ha JOIN hb USING (feature, bin)) SELECT feature, {r('psi=sum((q - p) * ln(q / p))')}, sum((q - p) * ln(q / p)) > 0.05 AS alarm FROM f GROUP BY 1""")


def latest(spark, d):
    stream, f = streamed(fx.scored(spark, d).select("symbol", "time", "p", "decision"))
    live.signal_sink(stream, f"{f}/latest", f"{f}/log", f"{f}/c").awaitTermination()
    return fx.rounded(live.latest_signals(spark, f"{f}/latest"), "symbol", "time", "p", "decision")


add("n07_signal_sink", latest, f"WITH {SCORED} SELECT symbol, {T}, {r('p')}, CAST(decision AS BIGINT) AS decision FROM scored QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1")


def metrics(spark, d):
    stream, f = streamed(fx.scored(spark, d).filter("y IS NOT NULL").select("symbol", "time", "y", "decision"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{f}/out")
    live.running_metrics(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{f}/c").trigger(availableNow=True).start().awaitTermination()
    return fx.rounded(spark.read.parquet(f"{f}/out"))


add("n09_running_metrics", metrics, f"WITH {SCORED}, k AS (SELECT symbol, count(*) FILTER (WHERE decision = y AND decision <> -1) AS wins, count(*) FILTER (WHERE decision <> y AND decision <> -1) AS losses, count(*) FILTER (WHERE decision = -1) AS nones FROM scored WHERE y IS NOT NULL GROUP BY 1) SELECT symbol, wins, losses, nones, {r('accuracy=100 * wins / nullif(wins + losses, 0)')} FROM k")
