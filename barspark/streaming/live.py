"""The live path as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barspark.operators.decide import decide, signal
from barspark.operators.stats import histogram, psi

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state beyond an executor's heap needs this provider; so does the stateful processor below."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def stream_bars(ticks: DataFrame, every: str = "30 minutes", lateness: str = "1 hour", symbol: str = "event_type", value: str = "value", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Candles of a stream of ticks; a candle comes out once the watermark has passed it, and later ticks of it are dropped."""
    at = ticks.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    order, v = F.struct(time, tie), F.col(value)
    grouped = at.groupBy(F.col(symbol).alias("symbol"), F.window(time, every).alias("span"))
    return grouped.agg(F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, order).alias("close"), F.count(v).cast("double").alias("volume")).select(
        "symbol", F.col("span.start").alias("time"), "open", "high", "low", "close", "volume"
    )


def process_once(bars: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A bar that comes again within the watermark is dropped."""
    return bars.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["symbol", "time"])


class _WaitAll(StatefulProcessor):
    """Holds main bars until every other timeframe has reached them, or, with ``wait`` (microseconds), until event time has passed them by so much."""

    def __init__(self, main: str, others: tuple[str, ...], wait: int | None):
        self.main, self.others, self.wait = main, others, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "tf string", "at long")
        self.waiting = handle.getMapState("waiting", "at long", "close double")

    def _expiry(self, at: int) -> int:
        return -(-(at + self.wait) // 1000)

    def _out(self, key, bars: list[tuple[int, float]], complete: bool) -> pd.DataFrame:
        return pd.DataFrame({"symbol": [key[0]] * len(bars), "at": [at for at, _ in bars], "close": [close for _, close in bars], "complete": [complete] * len(bars)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for tf, at in part.groupby("tf")["at"].max().items():
                before = self.last.getValue((tf,)) if self.last.containsKey((tf,)) else None
                if before is None or at > before[0]:
                    self.last.updateValue((tf,), (int(at),))
            own = part[part["tf"] == self.main]
            for at, close in zip(own["at"].tolist(), own["close"].tolist(), strict=True):
                self.waiting.updateValue((at,), (close,))
                if self.wait is not None:
                    self.handle.registerTimer(self._expiry(at))
        reached = [self.last.getValue((tf,))[0] if self.last.containsKey((tf,)) else None for tf in self.others]
        if not reached or None in reached:
            return
        done = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= min(reached))
        for at, _ in done:
            self.waiting.removeKey((at,))
            if self.wait is not None:
                self.handle.deleteTimer(self._expiry(at))
        if done:
            yield self._out(key, done, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        late = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if self._expiry(k[0]) <= due)
        for at, _ in late:
            self.waiting.removeKey((at,))
        if late:
            yield self._out(key, late, False)

    def close(self) -> None:
        pass


def wait_all_timeframes(bars: DataFrame, main: str, others: tuple[str, ...], wait: timedelta | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Of a stream of bars with ``tf``: each main bar, once all the others have a bar at its time or later.

    With ``wait``, a main bar comes out with ``complete`` false as soon as event time (the newest bar of any series, less ``lateness``) is past
    its time by so much, so a silent timeframe holds nothing up, and a series waits with no more bars than fit into that span.  Without, it
    waits for ever.  A bar that comes again while it waits counts once.
    """
    use_rocksdb(bars.sparkSession)
    rows = bars.select("symbol", "tf", F.col("time").cast("timestamp").alias("time"), "close")
    rows = rows.withWatermark("time", lateness) if wait is not None else rows
    rows = rows.withColumn("at", F.unix_micros("time"))
    span = None if wait is None else wait // timedelta(microseconds=1)
    schema = "symbol string, at long, close double, complete boolean"
    out = rows.groupBy("symbol").transformWithStateInPandas(_WaitAll(main, others, span), schema, "Append", "None" if wait is None else "EventTime")
    return out.select("symbol", F.timestamp_micros("at").alias("time"), "close", *([] if wait is None else ["complete"]))


class _Features(StatefulProcessor):
    """Keeps what the newest bar's features need: exponential means, a running sum, and the last closes."""

    def __init__(self, spans: tuple[int, ...], mean: int):
        self.spans, self.mean = spans, mean

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "n long, sum double, means array<double>, closes array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = self.state.get() if self.state.exists() else None
        n, total, means, closes = (stored[0], stored[1], list(stored[2]), list(stored[3])) if stored else (0, 0.0, [], [])
        out = []
        for row in pd.concat(list(rows)).sort_values("time").itertuples():
            means = [m + 2.0 / (s + 1) * (row.close - m) for m, s in zip(means, self.spans, strict=True)] if n else [row.close] * len(self.spans)
            n, total, closes = n + 1, total + row.volume, [*closes, row.close][-self.mean :]
            out.append((key[0], row.time, row.close, *means, sum(closes) / self.mean if len(closes) == self.mean else None, total))
        self.state.update((n, total, means, closes))
        yield pd.DataFrame(out, columns=["symbol", "time", "close", *[f"ema{s}" for s in self.spans], f"sma{self.mean}", "cum_volume"])

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame, spans: tuple[int, ...] = (12, 26), mean: int = 10) -> DataFrame:
    """Features of each new bar from a bounded state per series, equal to the batch scans over all bars; bars come in order of time."""
    use_rocksdb(bars.sparkSession)
    schema = "symbol string, time timestamp, close double, " + ", ".join(f"ema{s} double" for s in spans) + f", sma{mean} double, cum_volume double"
    rows = bars.select("symbol", F.col("time").cast("timestamp").alias("time"), "close", "volume")
    return rows.groupBy("symbol").transformWithStateInPandas(_Features(spans, mean), schema, "Append", "None")


def stream_decisions(features: DataFrame, score: Callable[[DataFrame], DataFrame], negative: float, positive: float) -> DataFrame:
    """Features to signals: ``score`` adds p, by a model or an expression."""
    scored = score(features).withColumn("decision", decide(F.col("p"), negative, positive))
    return scored.withColumn("signal", signal(F.col("decision")))


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is replaced in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, fresh = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fresh.getFileSystem(conf).create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), conf).rename(fresh, target, overwrite)


def _version(spark: SparkSession, latest: str) -> int | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{latest}/current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return int(spark.read.text(f"{latest}/current").first()[0])


def latest_signals(spark: SparkSession, latest: str) -> DataFrame:
    """The latest signal of each series, from one whole version of the table, also while the next one is being written."""
    number = _version(spark, latest)
    if number is None:
        raise FileNotFoundError(f"no version in {latest}")
    return spark.read.parquet(f"{latest}/version={number:012d}").drop("__batch")


def _drop_version(spark: SparkSession, latest: str, number: int) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{latest}/version={number:012d}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def signal_sink(signals: DataFrame, latest: str, log: str, checkpoint: str, once: bool = True, keep: int = 2) -> StreamingQuery:
    """Each batch appends to the log under its own number and makes the next version of the latest signals, from the version before and its own rows.

    A version is written apart and becomes current when a pointer file is replaced, in one step; ``keep`` versions before it stay for those
    who read them.  A batch that comes again writes the same log files; if its version is current, nothing else happens.  Of signals of
    one series and time, the one of the later batch counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        rows = spark.read.schema(batch.schema).parquet(f"{log}/batch={number}").withColumn("__batch", F.lit(number).cast("long"))
        before = _version(spark, latest)
        if before is not None and before >= number:
            return
        if before is not None:
            rows = spark.read.parquet(f"{latest}/version={before:012d}").unionByName(rows)
        others = [k for k in rows.columns if k != "symbol"]
        last = rows.groupBy("symbol").agg(F.max_by(F.struct(*others), F.struct("time", "__batch")).alias("p"))
        last.select("symbol", "p.*").write.mode("overwrite").parquet(f"{latest}/version={number:012d}")
        _replace(spark, f"{latest}/current", str(number))
        _drop_version(spark, latest, number - keep - 1)

    writer = signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_drift(features: DataFrame, train: DataFrame, columns: list[str], out: str, checkpoint: str, alarm: float = 0.05) -> StreamingQuery:
    """PSI of each batch of feature rows against a stored training histogram."""

    def write(batch: DataFrame, number: int) -> None:
        scores = psi(train, histogram(batch, train.select("feature", "bin", "lo", "hi"), columns))
        scores.withColumn("alarm", F.col("psi") > alarm).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_metrics(decided: DataFrame) -> DataFrame:
    """Wins, losses and undecided rows per series so far; output mode update or complete."""
    d, y = F.col("decision"), F.col("y")
    counts = decided.groupBy("symbol").agg(F.count_if((d == y) & (d != -1)).alias("wins"), F.count_if((d != y) & (d != -1)).alias("losses"), F.count_if(d == -1).alias("nones"))
    return counts.withColumn("accuracy", 100 * F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet, and reads that."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def replay_parity(ticks: DataFrame, folder: str, every: str = "30 minutes", lateness: str = "1 hour", spans: tuple[int, ...] = (12, 26), mean: int = 10, symbol: str = "event_type", time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Ticks as a stream through bars and features, and the bars of both ways: (features of the stream, bars of the stream).

    ticks: a streaming DataFrame.  ``folder`` takes the tables and checkpoints.
    """
    bars = to_table(stream_bars(ticks, every, lateness, symbol, time=time), f"{folder}/bars", f"{folder}/bars-checkpoint")
    again = ticks.sparkSession.readStream.schema(bars.schema).parquet(f"{folder}/bars")
    return to_table(stream_features(again, spans, mean), f"{folder}/features", f"{folder}/features-checkpoint"), bars
