"""Invariants of model runs, selection and blending."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.models import boosting, ensemble, linear, search, selection, trainers
from foldsmith.operators import folds
from foldsmith.plans import standin

SMALL = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x, z = rng.uniform(0, 10, 600), rng.uniform(0, 10, 600)
    y = np.exp(0.2 * x) * 10 + z
    rows = [(str(i), float(a), float(b), "ab"[i % 2], float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    df = folds.kfold(spark.createDataFrame(rows, "id string, x double, z double, s string, y double"), 3)
    return df.filter("cast(id as int) < 450").cache(), df.filter("cast(id as int) >= 450").drop("y").cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_every_id_is_predicted_once_within_the_clip(data):
    train, test = data
    run = trainers.CVTrainer(SMALL, n_splits=3, clip_preds=(12.0, 60.0)).train_and_score(train, "y", ["x", "z", "s"], test)
    assert ids(run.oof) == ids(train) and ids(run.test) == ids(test)
    low, high = run.oof.agg(F.min("pred"), F.max("pred")).first()
    assert 12.0 <= low and high <= 60.0
    again = math.sqrt(sum((math.log1p(r["y"]) - math.log1p(r["pred"])) ** 2 for r in run.oof.collect()) / 450)
    assert run.score == pytest.approx(again)
    spread = train.agg(F.stddev_pop(F.log1p("y"))).first()[0]
    assert run.score < 0.8 * spread


def test_out_of_fold_model_never_saw_its_fold(data):
    train, _ = data
    # a target that is only known inside fold 0 cannot be predicted there
    shifted = train.withColumn("y", F.when(F.col("fold") == 0, 1000.0).otherwise(10.0))
    run = trainers.CVTrainer(SMALL, n_splits=3).train_and_score(shifted, "y", ["x", "z"])
    wrong = run.oof.join(train.select("id", "fold"), "id").filter("fold = 0").agg(F.max("pred")).first()[0]
    assert wrong == pytest.approx(10.0, rel=1e-3)


def test_best_iteration_respects_patience():
    assert boosting.best_iteration([5, 4, 4.5, 4.4, 3], rounds=2) == 2
    assert boosting.best_iteration([5, 4, 4.5, 4.4, 3], rounds=3) == 5
    assert boosting.best_iteration([1.0], rounds=1) == 1


def test_early_stop_and_refit(data):
    train, test = data
    trainer = trainers.CVTrainer({**SMALL, "n_estimators": 6}, n_splits=3, early_stop=True)
    run = trainer.train_and_score(train, "y", ["x", "z"])
    assert all(1 <= n <= 6 for n in run.best_iterations)
    assert ids(trainer.train_on_full(train, "y", ["x", "z"], test, run.best_iterations)) == ids(test)


def test_outliers_leave_training_but_are_scored(data):
    train, _ = data
    first, second, outliers = trainers.two_round_outlier_fit(trainers.CVTrainer(SMALL, n_splits=3), train, "y", ["x"], q=0.9)
    assert outliers.count() == 45
    assert ids(second.oof) == ids(train)


def test_segments_are_scored_together(data):
    train, test = data
    run = trainers.cv_by_segment(trainers.CVTrainer(SMALL, n_splits=3), train, "y", ["x", "z"], "s", ["a", "b"], test)
    assert ids(run.oof) == ids(train) and ids(run.test) == ids(test)


def test_fold_hook_sees_all_parts(data):
    train, test = data
    seen = []

    def hook(fit, val, tst, fold):
        seen.append((fold, fit.count() + val.count(), tst.count()))
        return fit, val, tst

    run = trainers.CVTrainer(SMALL, n_splits=3, fn_modify_fold_data=hook).train_and_score(train, "y", ["x"], test)
    assert seen == [(k, 450, 150) for k in range(3)]
    plain = trainers.CVTrainer(SMALL, n_splits=3).train_and_score(train, "y", ["x"], test)
    assert run.score == pytest.approx(plain.score, rel=0.05)
    assert ids(run.test) == ids(test)


def test_predicted_std_is_positive(data):
    train, test = data
    oof, tst, _ = trainers.predict_mean_std(trainers.CVTrainer(SMALL, n_splits=3), train, "y", ["x", "z"], test)
    assert oof.filter("pred_std > 0").count() == 450 and tst.filter("pred_std > 0").count() == 150


def test_adversarial_auc_of_a_random_split_and_of_full_drift(data):
    train, test = data
    auc, importances, _ = trainers.adversarial_validation(train, test, ["x", "z"], SMALL, n_splits=2)
    assert abs(auc.first()["auc"] - 0.5) < 0.12
    drifted = test.withColumn("z", F.col("z") + 100)
    auc, importances, _ = trainers.adversarial_validation(train, drifted, ["x", "z"], SMALL, n_splits=2)
    assert auc.first()["auc"] > 0.99
    assert trainers.importance_top_k(importances, 1).first()["feature"] == "z"


def test_missing_feature_values_do_not_drop_rows(data):
    train, _ = data
    holes = train.withColumn("x", F.when(F.col("x") > 5, F.col("x"))).withColumn("z", F.when(F.col("z") > 2, F.col("z")).otherwise(F.lit(float("nan"))))
    assert ids(trainers.CVTrainer(SMALL, n_splits=3).train_and_score(holes, "y", ["x", "z"]).oof) == ids(train)


def test_ridge_equals_least_squares_on_pandas(data):
    train, _ = data
    pdf = train.toPandas()
    oof, _, coefficients = linear.cv_ridge_stack(train, None, ["x", "z"], "y", alpha=2.0, log_columns=False)
    got = {r["id"]: r["pred"] for r in oof.collect()}
    for k in range(3):
        fit, val = pdf[pdf.fold != k], pdf[pdf.fold == k]
        X, t = fit[["x", "z"]].to_numpy(), np.log1p(fit.y.to_numpy())
        Xc, tc = X - X.mean(0), t - t.mean()
        w = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(2), Xc.T @ tc)
        want = np.expm1(t.mean() + (val[["x", "z"]].to_numpy() - X.mean(0)) @ w)
        assert [got[i] for i in val.id] == pytest.approx(list(want))


def test_forward_selection_matches_recomputation(data):
    train, _ = data
    train = train.withColumns({"x2": F.col("x") * F.col("x"), "noise": F.lit(1.0)})
    names = ["x", "z", "x2", "noise"]
    scorer = selection.linear_scorer(train, names, "y")
    chosen, log = selection.forward_select(names, scorer, max_features=2)
    best_first = min(names, key=lambda n: (scorer([n]), n))
    best_second = min((n for n in names if n != best_first), key=lambda n: (scorer([best_first, n]), n))
    assert chosen == [best_first, best_second]
    scores = [row[2] for row in log if row[4] == "selected"]
    assert scores == sorted(scores, reverse=True)


def test_forward_selection_options():
    score = {frozenset(): 1.0}
    fn = lambda fs: 1.0 - 0.1 * len(set(fs) & {"a", "b"}) + 0.05 * len(set(fs) & {"c"})
    assert selection.forward_select(["a", "b", "c"], fn, ["o"])[0] == ["a", "b"]
    assert selection.forward_select(["a", "b", "c"], fn, ["o"], stop_at_max_score=False)[0] == ["a", "b", "c"]
    assert selection.forward_select(["a", "b", "c"], fn, ["o"], initial_to_select=["c"], initial_to_discard=["a"])[0] == ["c", "b"]
    _, log = selection.forward_select(["a", "b", "c"], fn, ["o"], discard_worst_n=1, max_features=1)
    assert [(r[1], r[4]) for r in log[1:]] == [("a", "selected"), ("b", "kept"), ("c", "discarded")]


def test_search_draws_are_stable_and_in_range():
    space = {"i": ("int", 2, 5), "f": ("float", 0.1, 0.2), "l": ("log", 1e-3, 1.0), "c": ("choice", ["p", "q"])}
    for t in range(50):
        d = search.draw(space, t)
        assert d == search.draw(space, t)
        assert 2 <= d["i"] <= 5 and 0.1 <= d["f"] <= 0.2 and 1e-3 <= d["l"] <= 1.0 and d["c"] in "pq"


def test_search_direction(spark):
    best, rows = search.param_search(spark, lambda p: p["v"], {"v": ("float", 0.0, 1.0)}, 8, direction="maximize")
    assert best["v"] == max(r["score"] for r in rows.collect())


def test_climb_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(10, 100, 300)
    models = {"a": y * 1.2 + rng.normal(0, 4, 300), "b": y * 0.9 + rng.normal(0, 8, 300), "c": rng.uniform(10, 100, 300)}
    models = {k: np.clip(v, 0, None) for k, v in models.items()}
    wide = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, *models.values())], "y double, a double, b double, c double")
    climb = ensemble.hill_climb(wide, ["a", "b", "c"], "y", tol=1e-6, step=0.05)
    score = lambda p: float(np.sqrt(np.mean((np.log1p(y) - np.log1p(np.maximum(p, 0))) ** 2)))
    blend = min(models.values(), key=score)
    start = score(blend)
    for _ in range(100):
        options = [((1 - w) * blend + w * m) for m, w in itertools.product(models.values(), ensemble.weight_grid(0.05))]
        best = min(options, key=score)
        if score(blend) - score(best) < 1e-6:
            break
        blend = best
    assert climb.score == pytest.approx(score(blend), abs=1e-9)
    assert climb.score <= start
    final = sum(climb.weights[m] * v for m, v in models.items())
    assert score(final) == pytest.approx(climb.score)


def test_negative_weights_can_be_switched_off():
    assert all(w > 0 for w in ensemble.weight_grid(negative=False))
    assert min(ensemble.weight_grid()) == -0.5 and 0 not in ensemble.weight_grid()


def test_standin_splits_cover_all_rows(spark, sf_dir):
    counts = {r["split"]: r["count"] for r in standin.frame(spark, sf_dir).groupBy("split").count().collect()}
    assert sum(counts.values()) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert counts["train"] == standin.train(spark, sf_dir).count()
