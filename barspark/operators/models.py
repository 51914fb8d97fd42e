"""Models on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.decide import classification_metrics
from barspark.storage import stored


def class_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Label, rows, and the weight that balances the classes: all rows over the number of classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("__t") / (F.col("__k") * F.col("n"))).alias("weight"))


def classifier(algo: str, label: str, features: str, n_features: int, weight: str | None = None, seed: int = 7, **params):
    common = {"labelCol": label, "featuresCol": features, **params}
    weighted = common | ({"weightCol": weight} if weight else {})
    match algo:
        case "logreg":
            return LogisticRegression(**weighted)
        case "rf":
            return RandomForestClassifier(seed=seed, **weighted)
        case "gbt":
            return GBTClassifier(seed=seed, **weighted)
        case "svm":
            return LinearSVC(**weighted)
        case "mlp":
            return MultilayerPerceptronClassifier(layers=[n_features, 16, 2], seed=seed, **common)
    raise ValueError(algo)


def fit_classifier(df: DataFrame, features: list[str], label: str = "y", algo: str = "logreg", weight: str | None = None, **params) -> PipelineModel:
    """Assembles, scales and fits; rows with a null feature or label are skipped."""
    stages = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]
    return Pipeline(stages=[*stages, classifier(algo, label, "__x", len(features), weight, **params)]).fit(df.filter(F.col(label).isNotNull()))


def predict_proba(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Adds the probability of class 1; for a model with margins only, their logistic."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.withColumn(name, p).drop("__raw", "__x", "rawPrediction", "probability", "prediction")


def fit_regressor(df: DataFrame, features: list[str], label: str, algo: str = "linear", seed: int = 7, **params) -> PipelineModel:
    """linear, ridge, poly, rf or gbt."""
    stages, x = [VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip")], "__raw"
    if algo == "poly":
        stages, x = [*stages, PolynomialExpansion(degree=2, inputCol="__raw", outputCol="__x")], "__x"
    common = {"labelCol": label, "featuresCol": x, **params}
    last = {
        "linear": lambda: LinearRegression(**common), "poly": lambda: LinearRegression(**common), "ridge": lambda: LinearRegression(**{"regParam": 1.0, **common}),
        "rf": lambda: RandomForestRegressor(seed=seed, **common), "gbt": lambda: GBTRegressor(seed=seed, **common),
    }[algo]()
    return Pipeline(stages=[*stages, last]).fit(df.filter(F.col(label).isNotNull()))


def calibrate(scored: DataFrame, p: str = "p", label: str = "y", method: str = "sigmoid"):
    """Fits a map from out-of-fold scores to probabilities; returns a function that adds ``calibrated`` to scored rows."""
    rows = scored.filter(F.col(p).isNotNull())
    if method == "isotonic":
        model = IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(rows.filter(F.col(label).isNotNull()))
        return model.transform
    model = Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="__s"), LogisticRegression(featuresCol="__s", labelCol=label)]).fit(rows.filter(F.col(label).isNotNull()))
    return lambda df: model.transform(df).withColumn("calibrated", vector_to_array("probability")[1]).drop("__s", "rawPrediction", "probability", "prediction")


def _folds(df: DataFrame, fold: str) -> list[int]:
    return sorted(r[0] for r in df.select(fold).distinct().collect() if r[0])


def out_of_fold(df: DataFrame, features: list[str], label: str = "y", fold: str = "test_fold", algo: str = "logreg", **params) -> DataFrame:
    """Probabilities of each fold by a model of the rows before it; fold 0 is trained on only.  The rows are stored once for all fits.

    Linear regressions of all folds and penalties come from one pass instead, see :mod:`barspark.operators.linear`.
    """
    return _out_of_fold(stored(df, "folds"), features, label, fold, algo, **params)


def _out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, algo: str, **params) -> DataFrame:
    out = None
    for f in _folds(rows, fold):
        model = fit_classifier(rows.filter(F.col(fold) < f), features, label, algo, **params)
        own = predict_proba(model, rows.filter(F.col(fold) == f))
        out = own if out is None else out.unionByName(own)
    return rows.limit(0).withColumn("p", F.lit(None).cast("double")) if out is None else out


def calibrated_ensemble(df: DataFrame, features: list[str], label: str = "y", fold: str = "test_fold", algo: str = "logreg", method: str = "sigmoid", **params):
    """Forward-chained calibration: fold f's model is fitted on the rows before it, and its scores in f fit its calibrator.

    Returns a function that adds ``calibrated``, the mean of what all folds' calibrated models say; like :func:`predict_proba`, it leaves
    out rows with a null feature.  Needs a fold from 1 on.
    """
    rows = stored(df, "folds")
    pairs = []
    for f in _folds(rows, fold):
        model = fit_classifier(rows.filter(F.col(fold) < f), features, label, algo, **params)
        pairs.append((model, calibrate(predict_proba(model, rows.filter(F.col(fold) == f), "__p"), "__p", label, method)))
    if not pairs:
        raise ValueError(f"no fold from 1 on in {fold}")

    def apply(to: DataFrame) -> DataFrame:
        for i, (model, calibrator) in enumerate(pairs):
            to = calibrator(predict_proba(model, to, "__p")).drop("__p").withColumnRenamed("calibrated", f"__c{i}")
        names = [f"__c{i}" for i in range(len(pairs))]
        return to.withColumn("calibrated", sum((F.col(k) for k in names[1:]), F.col(names[0])) / len(names)).drop(*names)

    return apply


def grid_evaluate(df: DataFrame, features: list[str], grid: list[dict], label: str = "y", fold: str = "test_fold", metric: str = "f1") -> DataFrame:
    """Forward-chained scores of each algorithm and parameter set (``{"algo": ..., **params}``), the best first."""
    rows, reports = stored(df, "folds"), None
    for i, setting in enumerate(grid):
        algo, params = setting["algo"], {k: v for k, v in setting.items() if k != "algo"}
        scored = _out_of_fold(rows, features, label, fold, algo, **params).withColumn("decision", (F.col("p") >= 0.5).cast("int"))
        own = classification_metrics(scored.withColumn("model", F.lit(f"{i}:{algo}")), y=label, keys=("model",))
        reports = own if reports is None else reports.unionByName(own)
    return reports.orderBy(F.col(metric).desc(), "model")


def oversample_knn(df: DataFrame, features: list[str], label: str = "y", ratio: float = 0.8, k: int = 5, id_col: str = "row_id", seed: int = 7) -> DataFrame:
    """The rows and synthetic rows of the smaller class on segments to near neighbours of its own, up to ``ratio`` of the larger class.

    Neighbours are approximate, see :func:`near_neighbours`; a row without one is repeated as it is.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    small, large = min(counts, key=counts.get), max(counts.values())
    missing = int(ratio * large) - counts[small]
    if missing <= 0 or len(counts) < 2:
        return df
    rows = VectorAssembler(inputCols=features, outputCol="__v").transform(df.filter(F.col(label) == small)).select(F.col(id_col).alias("a"), vector_to_array("__v").alias("x"))
    each, more = divmod(missing, counts[small])
    draw = F.pmod(F.xxhash64("a", F.lit(seed)), F.lit(1 << _DRAW_BITS))
    turns = rows.withColumn("turns", F.lit(each) + (draw < _smallest(rows.select(draw.alias("h")), more)).cast("int")).filter("turns > 0")
    turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("turns"))))
    chosen = turns.join(near_neighbours(rows, len(features), k, seed), "a", "left")
    unit = lambda *salt: F.pmod(F.xxhash64("a", "turn", *[F.lit(s) for s in salt]), F.lit(1 << 30)) / float(1 << 30)
    pick = F.coalesce(F.get("n", F.floor(unit(seed) * F.size("n")).cast("int"))["y"], F.col("x"))
    made = chosen.withColumns({"p": pick, "u": unit(seed, 1)}).withColumn("z", F.zip_with("x", "p", lambda x, y: x + F.col("u") * (y - x)))
    synthetic = made.select(*[F.get("z", F.lit(i)).alias(f) for i, f in enumerate(features)], F.lit(small).cast(df.schema[label].dataType).alias(label))
    return df.withColumn("synthetic", F.lit(False)).unionByName(synthetic.withColumn("synthetic", F.lit(True)), allowMissingColumns=True)


_DRAW_BITS = 60


def _smallest(draws: DataFrame, n: int, at_once: int = 10_000) -> int:
    """The limit below which n of the numbers ``h`` lie: counts of 4,096 ranges at a time, then the few numbers of the last range."""
    low, bits, inside = 0, _DRAW_BITS, at_once + 1
    while n and bits and inside > at_once:
        bits -= 12
        own = draws.filter(F.col("h").between(low, low + (1 << (bits + 12)) - 1))
        found = {r["g"]: r["count"] for r in own.groupBy(F.shiftright(F.col("h") - F.lit(low), bits).alias("g")).count().collect()}
        for g in sorted(found):
            inside = found[g]
            if inside > n:
                break
            n -= inside
        else:
            return low + (1 << (bits + 12))
        low += g << bits
    if not n or not bits:
        return low
    return sorted(r["h"] for r in draws.filter(F.col("h").between(low, low + (1 << bits) - 1)).collect())[n]


def near_neighbours(rows: DataFrame, n_features: int, k: int = 5, seed: int = 7, tables: int = 4, block: int = 256) -> DataFrame:
    """``a, n``: for each row (a, x array<double>) up to k near others, ``n array<struct<d, b, y>>``, the nearest first.

    In each table three random projections are interleaved bit by bit to one number; rows are sorted by it and cut into blocks, and inside
    a block all distances are taken. So equal or crowded rows make no large group. Rows that a block leaves alone are not in the result.
    """
    kind = dict(rows.dtypes)["a"]
    rows = rows.filter("a IS NOT NULL")
    middle = rows.select(*[F.struct(F.avg(F.get("x", F.lit(i))).alias("m"), F.stddev_pop(F.get("x", F.lit(i))).alias("s")).alias(f"f{i}") for i in range(n_features)]).first()
    mean = np.array([r["m"] or 0.0 for r in middle])
    scale = np.array([r["s"] or 1.0 for r in middle])
    rng = np.random.default_rng(seed)
    # distances are those of the features as they are; only the projections' range follows from their spread
    lines = rng.normal(size=(tables, n_features, 3))
    wide = np.maximum(np.sqrt(((lines * scale[None, :, None]) ** 2).sum(axis=1)), 1e-300)
    shift = rng.random((tables, 3))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            x = np.array(part["x"].tolist(), np.float64)
            for t in range(tables):
                cell = np.clip((((x - mean) @ lines[t]) / wide[t] + shift[t] + 8) * (1 << 16), 0, (1 << 20) - 1).astype(np.int64)
                z = np.zeros(len(x), np.int64)
                for bit in range(20):
                    for j in range(3):
                        z |= ((cell[:, j] >> bit) & 1) << (3 * bit + j)
                yield pd.DataFrame({"t": np.full(len(x), t, np.int32), "z": z, "a": part["a"], "x": part["x"]})

    def near(part: pd.DataFrame) -> pd.DataFrame:
        ids, x = part["a"].to_numpy(), np.array(part["x"].tolist(), np.float64)
        d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        d[ids[:, None] == ids[None, :]] = np.inf
        first = np.argsort(d, axis=1, kind="stable")[:, :k]
        found = [[{"d": float(d[i, j]), "b": ids[j], "y": x[j].tolist()} for j in own if d[i, j] < np.inf] for i, own in enumerate(first)]
        return pd.DataFrame({"a": part["a"].to_numpy(), "n": found})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in batches:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            at = 0
            while len(held) - at >= 2 * block:  # what is left over goes to the last block
                yield near(held.iloc[at : at + block])
                at += block
            held = held.iloc[at:]
        if held is not None and len(held):
            yield near(held)

    item = f"struct<d: double, b: {kind}, y: array<double>>"
    dealt = rows.mapInPandas(keyed, f"t int, z long, a {kind}, x array<double>").withColumn("h", F.xxhash64("a"))
    dealt = dealt.repartitionByRange("t", "z", "h").sortWithinPartitions("t", "z", "h").select("t", "z", "a", "x")
    found = dealt.mapInPandas(blocks, f"a {kind}, n array<{item}>").groupBy("a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))).alias("n"))  # k of each table at most
    return found.select("a", F.slice("n", 1, k).alias("n")).filter(F.size("n") > 0)
