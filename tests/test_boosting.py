"""Continued boosting, categories as categories, and folds side by side."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from foldsmith import runs
from foldsmith.models import boosting, parallel, trainers
from foldsmith.operators import folds
from foldsmith.operators.metrics import rmse

PARAMS = {"maxIter": 60, "maxDepth": 3, "stepSize": 0.2, "seed": 42}


@pytest.fixture(scope="module")
def curved(spark):
    """A curve with noise, so that the validation error turns up after some trees."""
    rng = np.random.default_rng(3)
    x, z = rng.uniform(0, 6, 900), rng.uniform(0, 1, 900)
    y = 20 + 5 * np.sin(x) + 2 * z + rng.normal(0, 3, 900)
    rows = [(str(i), float(a), float(b), "ab"[i % 2], float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return folds.kfold(spark.createDataFrame(rows, "id string, x double, z double, s string, y double"), 3).cache()


def prepared(df, features):
    stage = trainers.assembler(df, features)
    rows = trainers.vectorised(df.withColumn("__label", F.col("y")), stage, ["id", "y", "__label", "fold"])
    return rows.filter("fold <> 0").cache(), rows.filter("fold = 0").cache()


@pytest.mark.parametrize("loss, chunk", [("squared", 4), ("squared", 7), ("absolute", 5)])
def test_chunks_give_the_full_fit_cut_at_its_best(curved, loss, chunk):
    fit, val = prepared(curved, ["x", "z", "s"])
    params = {**PARAMS, "lossType": loss, "maxIter": 30}
    found = boosting.boost(fit, val, params, 5, lambda total: rmse(F.col("y"), F.col(total)), chunk=chunk)
    whole = GBTRegressor(featuresCol="features", labelCol="__label", **params).fit(fit)
    best = found.model.getNumTrees
    assert best == boosting.best_iteration(found.curve, 5)
    assert found.fitted == len(found.curve) <= min(30, best + 5 + chunk)
    for ours, theirs in zip(found.model.trees, whole.trees):
        assert ours.toDebugString.split("\n", 1)[1] == theirs.toDebugString.split("\n", 1)[1]
    assert list(found.model.treeWeights) == list(whole.treeWeights)[:best]
    errors = boosting.boost(fit, val, {**params, "maxIter": found.fitted}, 10**6, lambda total: rmse(F.col("y"), F.col(total)), chunk=100).curve
    assert errors == pytest.approx(found.curve)
    own = found.model.transform(val).agg(rmse(F.col("y"), F.col("__raw"))).first()[0]
    assert own == pytest.approx(min(found.curve))


def test_many_chunks_are_written(curved, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNKS_PER_WRITE", 2)
    fit, val = prepared(curved, ["x", "z"])
    score = lambda total: rmse(F.col("y"), F.col(total))
    one = boosting.boost(fit, val, {**PARAMS, "maxIter": 9}, 100, score, chunk=1)
    other = boosting.boost(fit, val, {**PARAMS, "maxIter": 9}, 100, score, chunk=9)
    assert one.curve == pytest.approx(other.curve) and one.fitted == other.fitted == 9


def test_drawn_rows_and_weights(curved):
    fit, val = prepared(curved.withColumn("w", F.lit(2.0)), ["x", "z"])
    fit = fit.withColumn("w", F.lit(2.0))
    score = lambda total: rmse(F.col("y"), F.col(total))
    drawn = boosting.boost(fit, val, {**PARAMS, "subsamplingRate": 0.5, "featureSubsetStrategy": "onethird"}, 4, score, "w", chunk=3)
    assert drawn.fitted <= drawn.model.getNumTrees + 4 + 3
    assert len({t.toDebugString for t in drawn.model.trees}) > 1


def test_patience_saves_trees_and_refit_follows(curved, tmp_path):
    params = {"n_estimators": 200, "max_depth": 3, "learning_rate": 0.3}
    trainer = trainers.CVTrainer(params, n_splits=3, log_transform_targets=False, scoring_fn=rmse, early_stop_rounds=6, chunk=4)
    result = runs.run_model("m", trainer, curved, curved, "y", ["x", "z"], str(tmp_path / "p"))
    for best, fitted in zip(result.best_iterations, trainer.fitted):
        assert best <= fitted <= best + 6 + 4 < 200
    assert trainer.refit_trees == max(1, int(sum(result.best_iterations) / 3 * 1.2)) < 200


def test_scrambled_category_is_split_at_depth_one(spark):
    """High and low levels alternate in every order of names and frequencies; one unordered split parts them."""
    names = ["kiwi", "fig", "pear", "lime", "plum", "date", "nut", None]
    rows = [(str(i), names[i % 8], 100.0 if i % 8 in (0, 2, 3, 7) else 10.0) for i in range(800)]
    df = folds.kfold(spark.createDataFrame(rows, "id string, c string, y double"), 4)
    trainer = trainers.CVTrainer({"n_estimators": 1, "max_depth": 1}, n_splits=4, log_transform_targets=False, scoring_fn=rmse)
    run = trainer.train_and_score(df, "y", ["c"])
    assert run.score == pytest.approx(0.0, abs=1e-9)
    coded = df.withColumn("c", F.crc32(F.coalesce("c", F.lit("?"))))
    assert trainer.train_and_score(coded, "y", ["c"]).score > 1  # as an ordered number one split does not
    listed = trainers.CVTrainer({"n_estimators": 1, "max_depth": 1}, n_splits=4, log_transform_targets=False, scoring_fn=rmse, categorical=["c"])
    assert listed.train_and_score(coded, "y", ["c"]).score == pytest.approx(0.0, abs=1e-9)


def test_wide_categories_raise_the_bins_and_pool_rare_levels(spark):
    rows = [(str(i), f"v{i % 300}" if i < 3000 else "top", float(i % 300 % 2)) for i in range(3600)]
    df = folds.kfold(spark.createDataFrame(rows, "id string, c string, y double"), 2)
    stage = trainers.assembler(df, ["c"])
    assert len(stage.levels["c"]) == 254 and stage.levels["c"][0] == "top" and stage.max_bins == 256
    run = trainers.CVTrainer({"n_estimators": 1, "max_depth": 1}, n_splits=2, log_transform_targets=False, scoring_fn=rmse).train_and_score(df, "y", ["c"])
    assert run.score < 0.4
    auc, _, _ = trainers.adversarial_validation(df.filter("c <> 'top'"), df.filter("c = 'top'"), ["c"], {"n_estimators": 1, "max_depth": 2}, n_splits=2)
    assert auc.first()["auc"] > 0.99


def test_jobs_side_by_side(spark):
    together = threading.Barrier(3, timeout=30)

    def job(n):
        together.wait()  # all three run at once, or this breaks
        return n, spark.range(n).count(), spark.sparkContext.getLocalProperty("spark.scheduler.pool")

    assert parallel.side_by_side(spark, [lambda n=n: job(n) for n in range(3)], 3, "p") == [(n, n, f"p-{n}") for n in range(3)]
    assert parallel.side_by_side(spark, [lambda n=n: n for n in range(3)], 1) == [0, 1, 2]
    with pytest.raises(ZeroDivisionError):
        parallel.side_by_side(spark, [lambda: 1 / 0, lambda: 1], 2)
