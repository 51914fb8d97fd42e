"""Linear models of all training prefixes from one pass over the rows (J2, J9): cumulative normal equations.

The sums of squares and products of each fold's rows are taken once. Those of a training prefix are the sum of the folds before it, so every
fold, every penalty and the model of all rows are solved from them, and the errors in a test fold follow from that fold's own sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at once.
ROWS_AT_ONCE = 65_536
#: Directions of a prefix with less than this share of the largest one's spread are not fitted.
LEAST_SPREAD = 1e-12
FITS = "fold int, ridge double, n_train long, n_test long, n_skipped long, intercept double, coefficients array<double>, mse double, r2 double"


def _finite(k: str) -> Column:
    v = F.col(k).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def fold_sums(df: DataFrame, features: list[str], label: str, fold: str) -> tuple[np.ndarray, dict[int, np.ndarray], dict[int, int]]:
    """The mean of each column (the features, then the label), each fold's matrix of products and its number of skipped rows.

    A matrix is that of the columns 1, features less their means, label less its mean.  Rows with a null, NaN or infinity are skipped and
    counted, rows without a fold left out.  What comes to the driver is one matrix a fold: it grows with columns and folds, not with rows.
    """
    columns = [*features, label]
    size = len(columns) + 1
    i, j = np.triu_indices(size)
    rows = df.filter(F.col(fold).isNotNull()).select(F.col(fold).cast("int").alias("f"), *[_finite(k).alias(f"c{n}") for n, k in enumerate(columns)])
    first = rows.agg(*[F.avg(f"c{n}").alias(f"c{n}") for n in range(len(columns))]).first()
    base = np.array([first[f"c{n}"] or 0.0 for n in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        skipped: dict[int, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                own = batch.column(0).to_numpy()
                x = np.column_stack([np.ones(len(own)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
                x[:, 1:] -= base
                good = ~np.isnan(x).any(axis=1)
                for f in np.unique(own).tolist():
                    z = x[(own == f) & good]
                    sums[f] = sums.get(f, 0.0) + z.T @ z
                    skipped[f] = skipped.get(f, 0) + int(((own == f) & ~good).sum())
        for f, total in sums.items():
            n = len(i) + 1  # the last place holds the skipped rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, f, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.append(total[i, j], float(skipped[f])))], ["f", "place", "v"]
            )

    found = rows.mapInArrow(run, "f int, place int, v double").groupBy("f", "place").agg(F.sum("v").alias("v")).toPandas()
    matrices, gone = {}, {}
    for f, part in found.groupby("f"):
        flat = part.sort_values("place")["v"].to_numpy()
        gram = np.zeros((size, size))
        gram[i, j] = gram[j, i] = flat[:-1]
        matrices[int(f)], gone[int(f)] = gram, int(flat[-1])
    return base, matrices, gone


def _solve(gram: np.ndarray, ridge: float) -> np.ndarray | None:
    """Intercept and coefficients of the last column on the others; None without rows."""
    n = gram[0, 0]
    if n < 1:
        return None
    mean = gram[0, 1:] / n
    spread = gram[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = spread[:-1, :-1], spread[:-1, -1]
    # a column is flat if its spread is what rounding leaves of its squares
    there = np.diag(xx) > 1e-13 * np.maximum(np.diag(gram)[1:-1], 1e-300)
    w = np.zeros(len(xy))
    if there.any():
        scale = np.sqrt(np.diag(xx)[there])
        unit = xx[np.ix_(there, there)] / np.outer(scale, scale) + np.diag(ridge / scale**2)
        value, vector = np.linalg.eigh(unit)
        kept = value > LEAST_SPREAD * value[-1]
        turned = vector[:, kept].T @ (xy[there] / scale)
        w[there] = vector[:, kept] @ (turned / value[kept]) / scale
    return np.append(mean[-1] - w @ mean[:-1], w)


def ridge_path(df: DataFrame, features: list[str], label: str, fold: str = "test_fold", ridges: tuple[float, ...] = (0.0, 1.0)) -> DataFrame:
    """One row for each fold and penalty: ``fold, ridge, n_train, n_test, n_skipped, intercept, coefficients, mse, r2``.

    Fold f (from 1) is fitted on the rows of all folds before it and judged on its own; the row of the fold after the last is the model of all
    rows, with nothing to be judged on.  The penalty is ``ridge`` times the sum of the squared coefficients, next to the sum of squared errors;
    the intercept is free.  Features that are constant in a prefix get 0, and so do directions that collinear ones leave open.
    ``n_skipped`` counts the rows of the prefix that have a gap in the label or a feature.  A fold without training rows has null fits.
    ``r2`` is null where the test fold's label is constant.
    """
    base, matrices, gone = fold_sums(df, features, label, fold)
    empty = np.zeros((len(features) + 2,) * 2)
    out = []
    for f in range(1, max(matrices) + 2) if matrices else ():
        before = [k for k in matrices if k < f]
        train, test = sum((matrices[k] for k in before), empty), matrices.get(f, empty)
        n = test[0, 0]
        for ridge in ridges:
            fit = _solve(train, ridge)
            row = [f, float(ridge), int(train[0, 0]), int(n), sum(gone[k] for k in before)]
            if fit is None:
                out.append((*row, None, None, None, None))
                continue
            error = np.append(-fit, 1.0)
            mse = max(float(error @ test @ error) / float(n), 0.0) if n else None
            total = float((test[-1, -1] - test[0, -1] ** 2 / n) / n) if n else 0.0
            r2 = 1 - mse / total if n and total > 1e-13 * test[-1, -1] / n else None
            intercept = float(fit[0] + base[-1] - fit[1:] @ base[:-1])
            out.append((*row, intercept, fit[1:].tolist(), mse, r2))
    return df.sparkSession.createDataFrame(out, FITS)


def path_report(fits: DataFrame) -> DataFrame:
    """Per penalty: ``ridge, folds, mse`` over all judged rows alike, the best first."""
    judged = fits.filter("mse IS NOT NULL")
    report = judged.groupBy("ridge").agg(F.count(F.lit(1)).alias("folds"), (F.sum(F.col("mse") * F.col("n_test")) / F.sum("n_test")).alias("mse"))
    return report.orderBy("mse", "ridge")


def predict_path(df: DataFrame, fits: DataFrame, features: list[str], ridge: float, fold: str = "test_fold", name: str = "prediction") -> DataFrame:
    """The rows that a model was not fitted on, each with the prediction of its own fold's model; rows with a gap in a feature have none.

    The fits, one row a fold, are broadcast.
    """
    own = fits.filter(F.col("ridge") == ridge).select(F.col("fold").alias("__fold"), F.col("intercept").alias("__b"), F.col("coefficients").alias("__w"))
    rows = df.filter(F.col(fold) >= 1).join(F.broadcast(own), F.col(fold) == F.col("__fold"))
    terms = F.zip_with(F.array(*map(_finite, features)), "__w", lambda x, w: x * w)
    return rows.withColumn(name, F.aggregate(terms, F.col("__b"), lambda a, t: a + t)).drop("__fold", "__b", "__w")
