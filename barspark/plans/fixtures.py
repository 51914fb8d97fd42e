"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions import windows as x
from barspark.operators.decide import decide
from barspark.operators.frame import label_next_up
from barspark.sources.bars import bars_from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, every: str = "30 minutes") -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"), every)


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is missing in every 17th row of a series and 0 in every 23rd."""
    n = F.row_number().over(x.series())
    return bars(spark, sf_dir).withColumn("n", n).withColumn("close", F.when(F.col("n") % 17 == 0, None).when(F.col("n") % 23 == 0, 0.0).otherwise(F.col("close")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a probability, the next bar's rise and a decision."""
    rows = label_next_up(bars(spark, sf_dir), keep_last=True)
    z = x.zscore(F.col("close"), 10, x.series())
    rows = rows.withColumn("p", F.round(1 / (1 + F.exp(-z)), 6)).filter("p IS NOT NULL")
    return rows.withColumn("decision", decide(F.col("p"), 0.4, 0.6))


def second_feed(df: DataFrame, column: str = "p") -> DataFrame:
    """The same rows, with the column a little higher in every 50th row of a series."""
    n = F.row_number().over(x.series())
    return df.withColumn("__n", n).withColumn(column, F.when(F.col("__n") % 50 == 0, F.col(column) + 1e-3).otherwise(F.col(column))).drop("__n")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded and times written out, for comparison by value.  A hair is added first, so that exact halves of the last digit don't depend on the last bit."""
    out: list[Column] = []
    kinds = dict(df.dtypes)
    for k in columns or df.columns:
        kind = kinds[k]
        if kind in ("double", "float"):
            v = F.round(F.col(k).cast("double") * (1 + 1e-12), digits)
            out.append(F.when(v == 0, F.lit(0.0)).otherwise(v).alias(k))
        elif kind.startswith("timestamp"):
            out.append(F.date_format(k, "yyyy-MM-dd HH:mm:ss").alias(k))
        elif kind == "date":
            out.append(F.col(k).cast("string").alias(k))
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            out.append(F.col(k).cast("long").alias(k))
        else:
            out.append(F.col(k))
    return df.select(*out)
