"""Ridge regression from sums of products.

One aggregate by fold gives the sums every fold's fit and validation score needs, whatever the number
of folds or of column subsets tried; only k-by-k matrices come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass
class Gram:
    """Per fold the matrix of sums of products of (1, columns..., target)."""

    columns: list[str]
    folds: dict[int, np.ndarray]

    @property
    def whole(self) -> np.ndarray:
        return sum(self.folds.values())


def gram_by_fold(df: DataFrame, columns: Sequence[str], target: str, fold_col: str = "fold",
                 log_target: bool = True, log_columns: bool = False) -> Gram:
    """Sums of products by fold, from one pass: every task sends one matrix per fold, and Spark adds them cell by cell.

    A missing value is an error, as any number in its place would change the fit.
    """
    columns = list(columns)
    y = F.col(target).cast("double")
    values = [F.col(c).cast("double") for c in columns]
    if log_columns:
        values = [F.log1p(v) for v in values]
    cells = [F.lit(1.0), *values, F.log1p(y) if log_target else y]
    size = len(cells)
    rows = df.select(F.col(fold_col).cast("int").alias("fold"), F.array(*cells).alias("v"))

    def partial(batches):
        folds = {}
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            for k in np.unique(fold):
                own = cells[fold == k]
                folds[k] = folds.get(k, 0.0) + own.T @ own
        if folds:
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k) for k in folds], pa.int32()), pa.array([m.ravel().tolist() for m in folds.values()], pa.list_(pa.float64()))],
                names=["fold", "cells"])

    sums = rows.mapInArrow(partial, "fold int, cells array<double>").select("fold", F.posexplode("cells").alias("at", "cell"))
    folds: dict[int, np.ndarray] = {}
    for row in sums.groupBy("fold", "at").agg(F.sum("cell").alias("cell")).collect():
        folds.setdefault(row["fold"], np.zeros((size, size))).flat[row["at"]] = row["cell"]
    names = ["1", *columns, target]
    if wrong := [n for i, n in enumerate(names) if any(not np.isfinite(m[i, i]) for m in folds.values())]:
        raise ValueError(f"missing or infinite values in {wrong}")
    return Gram(columns, folds)


def solve(matrix: np.ndarray, picked: Sequence[int], alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the picked columns; the intercept is not penalised."""
    n, last = matrix[0, 0], matrix.shape[0] - 1
    at = [p + 1 for p in picked]
    mean_x, mean_y = matrix[0, at] / n, matrix[0, last] / n
    xx = matrix[np.ix_(at, at)] - n * np.outer(mean_x, mean_x)
    xy = matrix[at, last] - n * mean_x * mean_y
    system = xx + alpha * np.eye(len(at))
    weights = np.linalg.lstsq(system, xy, rcond=None)[0] if at else np.zeros(0)
    return float(mean_y - weights @ mean_x), weights


def cv_score(gram: Gram, columns: Sequence[str], alpha: float = 0.0) -> float:
    """Root mean squared validation error over all folds (RMSLE where the target was logged)."""
    picked = [gram.columns.index(c) for c in columns]
    error = rows = 0.0
    for matrix in gram.folds.values():
        intercept, weights = solve(gram.whole - matrix, picked, alpha)
        w = np.zeros(matrix.shape[0])
        w[0], w[-1] = intercept, -1.0
        for p, value in zip(picked, weights):
            w[p + 1] = value
        error += float(w @ matrix @ w)
        rows += matrix[0, 0]
    return float(np.sqrt(max(error, 0.0) / rows))


def _expression(columns: Sequence[str], fit: tuple[float, np.ndarray], log_columns: bool) -> Column:
    out = F.lit(fit[0])
    for c, w in zip(columns, fit[1]):
        value = F.col(c).cast("double")
        out = out + F.lit(float(w)) * (F.log1p(value) if log_columns else value)
    return out


def cv_ridge_stack(oof: DataFrame, test: DataFrame | None, models: Sequence[str], target: str, alpha: float = 1.0,
                   fold_col: str = "fold", clip: tuple[float | None, float | None] = (None, None),
                   log_columns: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Ridge on log1p of model predictions and of the target.

    Returns out-of-fold predictions, test predictions of the fit on all rows, and the coefficients
    per fold (fold -1 is the fit on all rows).  The same log is applied to train and test inputs.
    """
    from foldsmith.functions.scalar import bounded

    models = list(models)
    gram = gram_by_fold(oof, models, target, fold_col, True, log_columns)
    picked = range(len(models))
    fits = {k: solve(gram.whole - m, picked, alpha) for k, m in sorted(gram.folds.items())}
    fits[-1] = solve(gram.whole, picked, alpha)
    raw = F.when(F.lit(False), F.lit(0.0))
    for k, fit in fits.items():
        if k >= 0:
            raw = raw.when(F.col(fold_col) == k, _expression(models, fit, log_columns))
    oof_out = oof.select("id", F.col(target).alias("y"), bounded(F.expm1(raw), *clip).alias("pred"))
    test_out = None
    if test is not None:
        test_out = test.select("id", bounded(F.expm1(_expression(models, fits[-1], log_columns)), *clip).alias("pred"))
    rows = [(int(k), name, float(v)) for k, (b, w) in fits.items() for name, v in [("intercept", b), *zip(models, w)]]
    return oof_out, test_out, oof.sparkSession.createDataFrame(rows, "fold int, term string, coefficient double")
