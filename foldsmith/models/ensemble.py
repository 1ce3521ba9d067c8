"""Hill-climbing blend of model predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.functions.exact import quoted
from foldsmith.functions.scalar import nan_to_null
from foldsmith.operators.metrics import rmsle

Score = Callable[[Column, Column], Column]

# larger aggregates outgrow one generated class and fall back to interpreted evaluation
BATCH = 50
# values of a matrix of rows x candidates held at a time
CELLS = 1 << 20


@dataclass(frozen=True)
class ScoreKernel:
    """A score of many candidates at once: ``partial`` turns a block of targets (rows) and predictions (rows x candidates) into
    states (states x candidates) that add up over blocks, ``finish`` turns their sums into a score per candidate."""

    partial: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def _squares(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    gap = np.log1p(p)
    gap -= np.log1p(y)[:, None]
    return np.stack([np.einsum("ij,ij->j", gap, gap), np.full(p.shape[1], float(len(y)))])


RMSLE = ScoreKernel(lambda y, p: _squares(y, p), lambda s: np.sqrt(s[0] / s[1]))
RMSE = ScoreKernel(lambda y, p: np.stack([((p - y[:, None]) ** 2).sum(axis=0), np.full(p.shape[1], float(len(y)))]), lambda s: np.sqrt(s[0] / s[1]))


def score_blends(wide: DataFrame, target: str, models: Sequence[str], weights: np.ndarray, kernel: ScoreKernel) -> np.ndarray:
    """Scores of the blends ``models @ weights`` (a column per candidate) floored at 0, in one pass over ``wide``.

    A task multiplies its rows with all weights, block by block, and adds up the kernel's states; one row a task and state is
    summed, so what is shuffled does not grow with the rows.
    """
    weights, partial = np.asarray(weights, float), kernel.partial
    n_models, block = len(models), max(1, CELLS // max(1, weights.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            rows = np.stack(columns[1:], axis=1) if n_models else np.zeros((batch.num_rows, 0))
            for start in range(0, batch.num_rows, block):
                states = partial(columns[0][start:start + block], np.maximum(rows[start:start + block] @ weights, 0.0))
                total = states if total is None else total + states
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["state", "sums"])

    numbers = wide.select(F.col(target).cast("double"), *[F.col(quoted(m)).cast("double") for m in models])
    told = numbers.mapInArrow(run, "state int, sums array<double>").select("state", F.posexplode("sums").alias("at", "part"))
    rows = told.groupBy("state", "at").agg(F.sum("part").alias("total")).collect()
    sums = np.zeros((max(r["state"] for r in rows) + 1, weights.shape[1])) if rows else np.zeros((2, weights.shape[1]))
    for r in rows:
        sums[r["state"], r["at"]] = r["total"]
    return kernel.finish(sums)


def weight_grid(step: float = 0.01, limit: float = 0.5, negative: bool = True) -> list[float]:
    n = round(limit / step)
    return [round(i * step, 10) for i in range(-n if negative else 1, n + 1) if i != 0]


@dataclass
class Climb:
    weights: dict[str, float]
    score: float
    steps: list[tuple[int, str, float, float]]
    converged: bool = True

    def weights_frame(self, spark) -> DataFrame:
        used = [(m, float(w)) for m, w in self.weights.items() if w != 0.0]
        return spark.createDataFrame(used, "model string, weight double")

    def steps_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step int, model string, weight double, score double")


def score_candidates(wide: DataFrame, target: str, candidates: Sequence[str], scoring_fn: Score = rmsle) -> list[float]:
    """Score of every candidate blend (a SQL expression each) floored at 0, many per aggregate; no value may be missing."""
    out: list[float] = []
    for start in range(0, len(candidates), BATCH):
        row = wide.agg(*[scoring_fn(F.col(target), F.greatest(F.expr(c), F.lit(0.0))).alias(f"c{i}")
                         for i, c in enumerate(candidates[start:start + BATCH])]).first()
        out += [float(v) for v in row]
    return out


def hill_climb(wide: DataFrame, models: Sequence[str], target: str, tol: float = 1e-5, use_negative_weights: bool = True,
               step: float = 0.01, max_steps: int | None = None, scoring_fn: Score = rmsle, kernel: ScoreKernel | None = None) -> Climb:
    """Start from the best model; each step mixes in the model and weight that lower the score most.

    With weight w the blend becomes ``(1 - w) * blend + w * model``.  Stops when the gain is below
    ``tol``; ``max_steps`` may end it earlier, and ``converged`` says which.  ``wide`` has one column per model, is
    cached once for all steps, and must have no missing prediction or target: a blend over fewer models than the
    weights say would be another blend.

    A ``kernel`` scores all models and weights of a step in one pass; the default score has one. Another ``scoring_fn``, an
    aggregate over target and prediction, is evaluated some candidates at a time.
    """
    models = list(models)
    if kernel is None and scoring_fn is rmsle:
        kernel = RMSLE
    rows = wide.select(F.col(target).cast("double").alias("__y"), *[quoted(m) for m in models]).persist()

    def scored(blends: np.ndarray) -> list[float]:
        if kernel is not None:
            return [float(v) for v in score_blends(rows, "__y", models, blends, kernel)]
        terms = [" + ".join(f"{quoted(m)} * {float(w)!r}D" for m, w in zip(models, blend) if w != 0.0) or "0.0D" for blend in blends.T]
        return score_candidates(rows, "__y", terms, scoring_fn)

    try:
        gaps = rows.agg(*[F.count_if(nan_to_null(F.col(quoted(c))).isNull()).alias(c) for c in ["__y", *models]]).first()
        if absent := [c for c in ["__y", *models] if gaps[c]]:
            raise ValueError(f"missing values in {[target if c == '__y' else c for c in absent]}")
        single = np.eye(len(models))
        scores = scored(single)
        best = min(range(len(models)), key=lambda i: (scores[i], models[i]))
        weights, score = single[:, best], scores[best]
        steps, converged = [(0, models[best], 1.0, score)], False
        grid = weight_grid(step, negative=use_negative_weights)
        while max_steps is None or len(steps) <= max_steps:
            used = [m for m, w in zip(models, weights) if w != 0.0]
            cells = [(m, w) for m in models for w in grid if used != [m]]
            if not cells:
                converged = True
                break
            blends = np.stack([(1.0 - w) * weights + w * single[:, models.index(m)] for m, w in cells], axis=1)
            scores = scored(blends)
            best = min(range(len(cells)), key=lambda i: (scores[i], cells[i]))
            if score - scores[best] < tol or score == scores[best]:
                converged = True
                break
            weights, score = blends[:, best], scores[best]
            steps.append((len(steps), *cells[best], score))
    finally:
        rows.unpersist()
    return Climb({m: float(w) for m, w in zip(models, weights)}, score, steps, converged)
