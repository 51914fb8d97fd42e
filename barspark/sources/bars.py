"""Bars from files and from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("time", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
PRICES = ("open", "high", "low", "close")
#: Timeframe labels and their lengths: fixed values.
MINUTES = {"5T": 5, "15T": 15, "30T": 30, "1H": 60}
#: Other names of the time and close columns, in order of preference: fixed values.
TIME_NAMES = ("time", "Time", "timestamp", "datetime", "Date")
CLOSE_NAMES = ("close", "Close", "CLOSE")


def duration(tf: str) -> str:
    return f"{MINUTES[tf]} minutes"


def read_bars(spark: SparkSession, path: str, tf: str, symbol: str, fmt: str = "csv") -> DataFrame:
    """A candle file with an explicit schema; a file without ``time`` is refused."""
    schema = T.StructType([f for f in BAR.fields if f.name not in ("symbol", "tf")])
    if fmt == "csv":
        header = spark.read.text(path).first()
        names = [x.strip().strip('"') for x in (header[0] if header else "").split(",")]
        if not set(names) & set(TIME_NAMES):
            raise ValueError(f"{path} has no time column")
        by = {f.name: f for f in schema.fields}
        own = T.StructType([T.StructField(n, by[n].dataType if n in by and n != "time" else T.StringType()) for n in names])
        rows = normalize_bars(spark.read.schema(own).option("header", True).csv(path))
    else:
        rows = normalize_bars(spark.read.parquet(path))
    missing = [f.name for f in schema.fields if f.name not in rows.columns]
    return rows.select(F.lit(symbol).alias("symbol"), F.lit(tf).alias("tf"), "time", *[(F.lit(None) if c in missing else F.col(c)).cast("double").alias(c) for c in (*PRICES, "volume")])


def read_timeframes(spark: SparkSession, paths: dict[str, str | list[str]], main: str, symbol: str, fmt: str = "csv") -> DataFrame:
    """All timeframes as one table.  The main one must be there; of several candidate paths the first readable is taken."""
    out = None
    for tf, candidates in paths.items():
        for path in [candidates] if isinstance(candidates, str) else candidates:
            try:
                own = read_bars(spark, path, tf, symbol, fmt)
            except Exception as e:  # the path is not there: Spark's own analysis error
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            out = own if out is None else out.unionByName(own)
            break
        else:
            if tf == main:
                raise FileNotFoundError(f"no file for the main timeframe {main}")
    return out


def normalize_bars(df: DataFrame) -> DataFrame:
    """Known column names, parsed times, no rows without one."""
    time = next((c for c in TIME_NAMES if c in df.columns), None)
    if time is None:
        raise ValueError("no time column")
    close = next((c for c in CLOSE_NAMES if c in df.columns), None)
    df = df.withColumnRenamed(time, "time")
    if close and close != "close":
        df = df.withColumnRenamed(close, "close")
    if dict(df.dtypes)["time"] == "string":
        df = df.withColumn("time", F.try_to_timestamp("time"))
    return df.withColumn("time", F.col("time").cast("timestamp_ntz")).dropna(subset=["time"])


def bars_from_events(df: DataFrame, every: str = "30 minutes", symbol: str | Column = "event_type", value: str = "value", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Candles of ticks: first, highest, lowest and last value of each span, and the number of ticks as volume.

    Ticks of the same time are ordered by ``tie``.  One shuffle, partially aggregated before it.
    """
    key = F.col(symbol) if isinstance(symbol, str) else symbol
    order = F.struct(time, tie)
    v = F.col(value)
    grouped = df.groupBy(key.alias("symbol"), F.window(time, every).alias("span"))
    return grouped.agg(
        F.min_by(v, order).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, order).alias("close"), F.count(v).cast("double").alias("volume")
    ).select("symbol", F.col("span.start").alias("time"), "open", "high", "low", "close", "volume")


def daily_bars(df: DataFrame, symbol: Column, price: str, day: str, tie: str) -> DataFrame:
    """Daily candles of rows that have a date only; the tie column orders a day's rows."""
    p, order = F.col(price).cast("double"), F.col(tie)
    return df.groupBy(symbol.alias("symbol"), F.col(day).cast("timestamp_ntz").alias("time")).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )


def tail_n(df: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "time") -> DataFrame:
    """The last n rows of each series."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def cut_asof(df: DataFrame, at: Column, n: int | None = None, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows up to a time, and of these the last n of each series."""
    rows = df.filter(F.col("time") <= at)
    return rows if n is None else tail_n(rows, n, keys)


#: History of each timeframe as multiples of the main rows, and the least warm-up rows: fixed values.
TAIL_RATIOS = {"5T": 6.0, "15T": 2.0, "30T": 1.0, "1H": 0.5}


def slice_tail(df: DataFrame, n_main: int, warmup: dict[str, int] | None = None) -> DataFrame:
    """Per timeframe, the last rows that a main tail of ``n_main`` rows needs: its ratio of them, and its warm-up at least."""
    warmup = warmup or {}
    need = F.coalesce(*[F.when(F.col("tf") == tf, F.lit(max(int(n_main * ratio), warmup.get(tf, 0)))) for tf, ratio in TAIL_RATIOS.items()])
    rank = F.row_number().over(Window.partitionBy("symbol", "tf").orderBy(F.col("time").desc()))
    return df.withColumn("__r", rank).filter(F.col("__r") <= need).drop("__r")
