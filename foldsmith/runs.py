"""Whole runs: a model run from stored features to stored predictions, and blends of stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldsmith.functions.scalar import bounded
from foldsmith.models.ensemble import Climb, hill_climb
from foldsmith.models.linear import cv_ridge_stack
from foldsmith.models.trainers import CVTrainer, RunResult
from foldsmith.operators.lookup import align_on_id, keep_base_rows
from foldsmith.operators.metrics import rmsle
from foldsmith.sources import predictions as store
from foldsmith.sources.feature_store import FeatureStore
from foldsmith.storage import materialize


def run_model(name: str, trainer: CVTrainer, train: DataFrame, test: DataFrame, target: str, features: Sequence[str],
              predictions_path: str, feature_store: FeatureStore | None = None,
              stored: Sequence[str] = ()) -> RunResult:
    """Add stored features, cross-validate, refit on all rows, store the three prediction splits and a manifest row."""
    if stored:
        more_train, more_test = feature_store.read_features(stored)
        train, test = align_on_id(train, more_train), align_on_id(test, more_test)
    features = [*features, *stored]
    result = trainer.train_and_score(train, target, features, test)
    full = trainer.train_on_full(train, target, features, test, result.best_iterations if trainer.stops_early else None)
    store.predictions_write(predictions_path, name, result.score, result.best_iterations, trainer.params,
                            oof=result.oof, test=result.test, test_from_full=full)
    return result


def _aligned(spark: SparkSession, predictions_path: str, train: DataFrame, target: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Wide out-of-fold rows with the target, wide test rows, and the model names; predictions clipped at 0."""
    stored = store.committed(spark, predictions_path)
    loaded = materialize(store.predictions_load(store.predictions_read(spark, predictions_path), stored)
                         .withColumn("pred", bounded(F.col("pred"), lower=0.0)))
    models = sorted(m for m, splits in stored.items() if "oof" in splits)
    base = train.select(F.col("id").cast("string").alias("id"), target, *(["fold"] if "fold" in train.columns else []))
    oof = keep_base_rows(loaded.filter("kind = 'oof'"), base)
    return (store.align_models(oof, models).join(base, "id"),
            store.align_models(loaded.filter("kind = 'test'"), models), models)


def run_hill_climb(spark: SparkSession, predictions_path: str, train: DataFrame, target: str, out_path: str,
                   bounds: tuple[float | None, float | None] = (None, None), tol: float = 1e-5,
                   use_negative_weights: bool = True) -> tuple[Climb, float]:
    """Blend stored predictions; writes ``submission``, ``weights`` and ``train_ensemble`` CSV folders."""
    oof, tst, models = _aligned(spark, predictions_path, train, target)
    climb = hill_climb(oof, models, target, tol, use_negative_weights)
    blend = sum((F.lit(w) * F.col(f"`{m}`") for m, w in climb.weights.items() if w != 0.0), F.lit(0.0))
    train_blend = oof.select("id", target, bounded(blend, lower=0.0).alias("pred"))
    store.submission_write(tst.select("id", blend.alias("pred")), f"{out_path}/submission", target, *bounds)
    climb.weights_frame(spark).coalesce(1).write.mode("overwrite").csv(f"{out_path}/weights", header=True)
    store.submission_write(train_blend, f"{out_path}/train_ensemble", target, 0.0, None)
    return climb, train_blend.agg(rmsle(F.col(target), F.col("pred"))).first()[0]


def run_ridge_stack(spark: SparkSession, predictions_path: str, train: DataFrame, target: str, out_path: str,
                    bounds: tuple[float | None, float | None] = (None, None), alpha: float = 1.0) -> float:
    """Ridge over stored predictions; writes a ``submission`` CSV folder and returns the out-of-fold score."""
    oof, tst, models = _aligned(spark, predictions_path, train, target)
    scored, test_out, _ = cv_ridge_stack(oof, tst, models, target, alpha, clip=bounds)
    store.submission_write(test_out, f"{out_path}/submission", target, *bounds)
    return scored.agg(rmsle(F.col("y"), F.col("pred"))).first()[0]


def run_gbt_stack(spark: SparkSession, predictions_path: str, trainer: CVTrainer, train: DataFrame, test: DataFrame, target: str,
                  out_path: str, base: Sequence[str] = (), feature_store: FeatureStore | None = None, stored: Sequence[str] = (),
                  bounds: tuple[float | None, float | None] = (None, None)) -> RunResult:
    """Trees over stored predictions, columns of the base and stored features; writes a ``submission`` CSV folder.

    Every stored model's predictions are features, logarithms like the target where the trainer takes it so. Rows of train and test must
    have a prediction of every model.
    """
    oof, tst, models = _aligned(spark, predictions_path, train, target)
    keep = ["id", *base]

    def stacked(rows: DataFrame, predictions: DataFrame, more: DataFrame | None, extra: Sequence[str]) -> DataFrame:
        level = [(F.log1p(F.col(f"`{m}`")) if trainer.log else F.col(f"`{m}`")).alias(f"pred_{m}") for m in models]
        frames = [predictions.select("id", *level)] + ([more.select("id", *[f"`{c}`" for c in stored])] if more is not None else [])
        text = rows.select(F.col("id").cast("string").alias("id"), *[c for c in [*keep[1:], *extra]])
        return align_on_id(text, *frames)

    extra_train, extra_test = feature_store.read_features(list(stored)) if stored else (None, None)
    train_rows = materialize(stacked(train, oof, extra_train, [target, trainer.fold_col]))
    test_rows = materialize(stacked(test, tst, extra_test, []))
    result = trainer.train_and_score(train_rows, target, [*base, *[f"pred_{m}" for m in models], *stored], test_rows)
    store.submission_write(result.test, f"{out_path}/submission", target, *bounds)
    return result
