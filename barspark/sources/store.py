"""Reports, distributions, blacklists and models on disk."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet, or CSV with a header; arrays and structs are JSON text in CSV."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        df.withColumns({k: F.to_json(k) for k in nested}).write.mode("overwrite").option("header", True).csv(path)


_DISTRIBUTION = "train_bins map<string, array<double>>, train_dist map<string, array<double>>"


def save_distribution(histogram: DataFrame, path: str) -> None:
    """A histogram (feature, bin, lo, hi, freq) as one JSON object: edges and frequencies of each feature."""
    per = histogram.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "freq"))).alias("b"))
    edges = F.concat(F.col("b.lo"), F.slice(F.col("b.hi"), -1, 1))
    per = per.select("feature", edges.alias("edges"), F.col("b.freq").alias("freq"))
    pairs = lambda k: F.map_from_entries(F.collect_list(F.struct("feature", k)))
    per.agg(pairs("edges").alias("train_bins"), pairs("freq").alias("train_dist")).coalesce(1).write.mode("overwrite").json(path)


def load_distribution(spark: SparkSession, path: str) -> DataFrame:
    """feature, bin, lo, hi, freq."""
    row = spark.read.schema(_DISTRIBUTION).json(path)
    long = row.select(F.explode("train_bins").alias("feature", "edges"), "train_dist")
    items = F.expr("transform(sequence(0, size(edges) - 2), i -> struct(i AS bin, edges[i] AS lo, edges[i + 1] AS hi, train_dist[feature][i] AS freq))")
    return long.select("feature", F.explode(items).alias("p")).select("feature", "p.*")


def load_blacklist(spark: SparkSession, texts: tuple[str, ...] = (), arrays: tuple[str, ...] = (), compares: tuple[str, ...] = (), parities: tuple[str, ...] = (), least_ratio: float = 1e-3) -> DataFrame:
    """Distinct base feature names from text lines, JSON arrays, compare summaries (mismatch_cnt above 0) and parity summaries (ratio_diff, else n_diff)."""
    out = spark.createDataFrame([], "feature string")
    for path in texts:
        out = out.union(spark.read.text(path).select(F.trim("value")))
    for path in arrays:
        out = out.union(spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>"))))
    for path in compares:
        out = out.union(spark.read.option("header", True).csv(path).filter(F.col("mismatch_cnt").try_cast("double") > 0).select("feature"))
    for path in parities:
        rows = spark.read.option("header", True).csv(path)
        rule = F.col("ratio_diff").try_cast("double") > least_ratio if "ratio_diff" in rows.columns else F.col("n_diff").try_cast("double") > 0
        out = out.union(rows.filter(rule).select("feature"))
    return out.select(F.regexp_replace("feature", r"_tminus\d+$", "").alias("feature")).filter("feature <> ''").distinct()


#: What a saved model must say about itself: fixed values.
REQUIRED = ("window_size", "neg_thr", "pos_thr", "feats", "train_window_cols", "schema_version")


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    missing = [k for k in REQUIRED if k not in meta]
    if missing:
        raise ValueError(f"metadata lacks {missing}")
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    missing = [k for k in REQUIRED if k not in meta]
    if missing:
        raise ValueError(f"metadata lacks {missing}")
    return PipelineModel.load(f"{path}/model"), meta
