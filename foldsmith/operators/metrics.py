"""Scores, correlations and drift."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.operators.lookup import attach
from foldsmith.operators.ordering import average_ranks, melt, running_totals
from foldsmith.storage import materialize


def rmsle(y_true: Column, y_pred: Column) -> Column:
    """Aggregate: root mean squared log error."""
    gap = F.log1p(y_true) - F.log1p(y_pred)
    return F.sqrt(F.avg(gap * gap))


def rmse(y_true: Column, y_pred: Column) -> Column:
    """Aggregate: root mean squared error."""
    gap = y_true - y_pred
    return F.sqrt(F.avg(gap * gap))


def segment_scores(df: DataFrame, segment: str, y_true: str, y_pred: str,
                   metric: Callable[[Column, Column], Column] = rmsle) -> DataFrame:
    """Score per segment, and overall in the row whose segment is ``all``."""
    return (df.rollup(segment).agg(metric(F.col(y_true), F.col(y_pred)).alias("score"), F.count(F.lit(1)).alias("rows"),
                                   F.grouping(segment).alias("__all"))
            .select(F.when(F.col("__all") == 1, "all").otherwise(F.col(segment).cast("string")).alias("segment"),
                    "score", "rows"))


def drift_by_feature(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Exact ROC AUC of every feature used as the score of a 0/1 label, ties counted half.

    All features go through one aggregate to (feature, value) rows, so the ranking works on distinct
    values and not on table rows.
    """
    counts = melt(df, features, keep=[label]).groupBy("column_name", "value").agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    ranked = running_totals(counts, ["value"], ["neg"], by=["column_name"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before").cast("double") + F.col("neg") / F.lit(2.0)))
    return ranked.groupBy("column_name").agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return drift_by_feature(df, label, [score]).select("auc", "positives", "negatives")


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation over the rows where both are present; NULL when either does not vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def corr_pearson_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of every column with the target, from one aggregate."""
    wide = df.agg(*[pearson(F.col(c), F.col(target)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column_name", "corr")


def _against(wide: DataFrame, base_model: str, models: Sequence[str], out: str) -> DataFrame:
    others = [m for m in models if m != base_model]
    row = wide.agg(*[pearson(F.col(base_model), F.col(m)).alias(m) for m in others])
    return row.unpivot([], others, "model", out).orderBy(F.desc(out), "model")


def corr_pearson_models(wide: DataFrame, base_model: str, models: Sequence[str]) -> DataFrame:
    """Correlation of every model with the base model, highest first."""
    return _against(wide, base_model, models, "pearson")


def corr_spearman_models(predictions: DataFrame, base_model: str, models: Sequence[str]) -> DataFrame:
    """Rank correlation over a long ``(model, id, pred)`` table, average ranks for ties."""
    ranks = materialize(average_ranks(predictions, "pred", by=["model"]))
    ranked = attach(predictions.select("model", "id", "pred"), ranks, ["model", "pred"], ["rank"], weight="n")
    wide = ranked.groupBy("id").pivot("model", list(models)).agg(F.first("rank"))
    return _against(wide, base_model, models, "spearman")


def correlation_matrix(df: DataFrame, columns: Sequence[str], batch: int = 100) -> np.ndarray:
    """Correlations of all column pairs, each over the rows where both are finite; NaN where either does not vary.

    Columns are first centred and scaled by their mean and range, which leaves little to cancel. One pass then adds up,
    per task and without a product for every pair in the plan, the sums that pairs need; Spark adds those of the tasks.
    """
    columns = list(columns)
    size, centre, half = len(columns), [], []
    for start in range(0, size, batch):
        finite = {c: nan_free(F.col(f"`{c}`").cast("double")) for c in columns[start:start + batch]}
        row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(finite.values()) for n, f in (("m", F.avg), ("a", F.min), ("b", F.max))]).first()
        for i in range(len(finite)):
            known = row[f"m{i}"] is not None and np.isfinite([row[f"m{i}"], row[f"a{i}"], row[f"b{i}"]]).all()
            centre.append(row[f"m{i}"] if known else 0.0)
            half.append((row[f"b{i}"] - row[f"a{i}"]) / 2 or 1.0 if known else 1.0)
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("v"))

    def partial(batches):
        total = np.zeros((4, size, size))
        for part in batches:
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            x = (x - centre) / half
            seen = np.isfinite(x)
            x, seen = np.where(seen, x, 0.0), seen.astype(float)
            total += np.stack([seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x])
        yield lines({i: total[:, i].ravel() for i in range(size)})

    def lines(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["line", "cells"])

    def added(batches):
        found = {}
        for part in batches:
            for line, cells in zip(part.column(0).to_pylist(), part.column(1)):
                own = cells.values.to_numpy()
                found[line] = found[line] + own if line in found else own
        if found:
            yield lines(found)

    # a task sends a row per line of its matrices, and the lines are added up on the executors
    kind = "line int, cells array<double>"
    told = rows.mapInArrow(partial, kind).repartition(min(size, 200), "line").mapInArrow(added, kind)
    sums = np.zeros((4, size, size))
    for row in told.toArrow().to_pylist():
        sums[:, row["line"]] = np.reshape(row["cells"], (4, size))
    n, x, xx, xy = sums
    spread = n * xx - x * x
    spread = np.where(spread > 1e-12 * n * xx, spread, np.nan)
    return (n * xy - x * x.T) / np.sqrt(spread * spread.T)


def drop_correlated(df: DataFrame, columns: Sequence[str], max_corr: float = 0.9999999) -> DataFrame:
    """Columns with their highest absolute correlation to an earlier column, and whether to drop them."""
    columns = list(columns)
    found = np.abs(correlation_matrix(df, columns))
    rows = []
    for i, c in enumerate(columns):
        known = found[i, :i][~np.isnan(found[i, :i])]
        most = float(min(1.0, known.max())) if len(known) else None
        rows.append((i, c, most, most is not None and most > max_corr))
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, max_corr double, dropped boolean")


def nan_free(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def fold_mean_predictions(per_fold: DataFrame, values: Sequence[str] = ("pred",)) -> DataFrame:
    """Mean over the folds' test predictions by id."""
    return per_fold.groupBy("id").agg(*[F.avg(v).alias(v) for v in values])
