"""Searches and selections that resume, run side by side and survive failing trials; scores of many blends at once."""

from __future__ import annotations

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.models import ensemble, search, selection, trainers
from foldsmith.operators import folds
from foldsmith.operators.metrics import rmsle

SPACE = {"x": ("float", -1.0, 1.0), "kind": ("choice", ["a", "b"])}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(0, 10, 400), rng.integers(0, 4, 400)
    y = np.exp(0.1 * x) * 10 + 5 * (z % 2) + rng.normal(0, 0.1, 400)
    data = [(str(i), float(a), "wxyz"[b], float(b * 0), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]
    return folds.kfold(spark.createDataFrame(data, "id string, x double, z string, none double, y double"), 3).cache()


def test_a_stopped_search_goes_on_with_the_same_draws(spark, tmp_path):
    path, seen = str(tmp_path / "trials"), []

    def objective(params):
        seen.append(params["x"])
        if len(seen) == 5:
            raise KeyboardInterrupt  # the driver is killed
        return params["x"] ** 2

    with pytest.raises(KeyboardInterrupt):
        search.param_search(spark, objective, SPACE, 9, path=path)
    assert len(search.stored_trials(spark, path)) == 4
    best, trials = search.param_search(spark, objective, SPACE, 9, path=path)
    whole, other = search.param_search(spark, lambda p: p["x"] ** 2, SPACE, 9)
    assert best == whole and len(seen) == 10 and len(set(seen)) == 9  # trial 4 alone ran twice
    columns = ["trial", "state", "score", "params"]
    assert [tuple(r) for r in trials.select(*columns).collect()] == [tuple(r) for r in other.select(*columns).collect()]
    assert search.param_search(spark, objective, SPACE, 9, path=path)[0] == best and len(seen) == 10
    more, table = search.param_search(spark, objective, SPACE, 12, path=path)
    assert table.count() == 12 and len(seen) == 13
    with pytest.raises(ValueError, match="another search"):
        search.param_search(spark, objective, SPACE, 9, path=path, seed=7)


def test_failing_trials_are_kept_and_passed_over(spark):
    def objective(params):
        if params["kind"] == "a":
            raise ArithmeticError("no fit")
        return params["x"]

    best, trials = search.param_search(spark, objective, SPACE, 10, direction="maximize", at_once=3)
    found = trials.collect()
    assert {(r["state"], r["params"]["kind"]) for r in found} == {("failed", "a"), ("done", "b")}
    assert all(r["error"] == "ArithmeticError: no fit" and r["score"] is None for r in found if r["state"] == "failed")
    assert best["x"] == max(r["score"] for r in found if r["state"] == "done")
    nothing, trials = search.param_search(spark, lambda p: 1 / 0, SPACE, 3)
    assert nothing == {} and trials.filter("state = 'failed'").count() == 3


def test_trials_run_side_by_side(spark):
    together = threading.Barrier(3, timeout=30)
    best, trials = search.param_search(spark, lambda p: together.wait() * 0.0 + p["x"], SPACE, 6, at_once=3)
    assert trials.filter("state = 'done'").count() == 6


def test_hopeless_trials_are_dropped_after_a_step(spark):
    steps = []

    def objective(params, report):
        for k in range(5):
            steps.append(k)
            report(params["x"] + 0.001 * k)
        return params["x"]

    best, trials = search.param_search(spark, objective, SPACE, 30, warm_up=4)
    found = trials.collect()
    dropped = [r for r in found if r["state"] == "pruned"]
    assert all(r["state"] == "done" for r in found[:4]) and dropped and len(steps) < 150
    done = [float(r["params"]["x"]) for r in found if r["state"] == "done"]
    assert best["x"] == min(float(r["params"]["x"]) for r in found) == min(done)
    assert all(len(r["reports"]) == 1 for r in dropped)


def test_search_over_a_trainer_reports_folds(spark, rows):
    space = {"max_depth": ("choice", [1, 3]), "n_estimators": ("int", 2, 4)}
    make = lambda p: trainers.CVTrainer(p, n_splits=3)
    objective = search.cv_objective(make, rows, "y", ["x", "z"])
    best, trials = search.param_search(spark, objective, space, 3, at_once=2, warm_up=10)
    for r in trials.collect():
        params = {k: int(v) for k, v in r["params"].items()}
        assert len(r["reports"]) == 3
        assert r["score"] == pytest.approx(make(params).train_and_score(rows, "y", ["x", "z"]).score)


def test_prepared_scorer_equals_the_plain_one(spark, rows):
    trainer = trainers.CVTrainer({"n_estimators": 2, "max_depth": 2}, n_splits=3)
    plain = selection.tree_scorer(trainer, rows, "y")
    with selection.TreeScorer(trainer, rows, "y", ["x", "z", "none"]) as scorer:
        for chosen in (["x"], ["z"], ["none", "z"], ["x", "z", "none"]):
            assert scorer(chosen) == pytest.approx(plain(chosen))


def test_a_stopped_selection_goes_on(spark, tmp_path):
    path, asked = str(tmp_path / "log"), []
    gain = {"a": 0.3, "b": 0.2, "c": 0.1}

    def score(names):
        asked.append(tuple(names))
        if len(asked) == 5:
            raise KeyboardInterrupt
        return 1.0 - sum(gain[n] for n in names)

    with pytest.raises(KeyboardInterrupt):
        selection.forward_select(list("abc"), score, spark=spark, log_path=path)
    assert {r[0] for r in selection.stored_log(spark, path)} == {-1, 0}
    chosen, log = selection.forward_select(list("abc"), score, spark=spark, log_path=path, at_once=2)
    assert chosen == ["a", "b", "c"] and not any(len(a) == 1 for a in asked[5:])
    assert log == selection.forward_select(list("abc"), lambda n: 1.0 - sum(gain[x] for x in n))[1]
    n = len(asked)
    assert selection.forward_select(list("abc"), score, spark=spark, log_path=path) == (chosen, log) and len(asked) == n
    with pytest.raises(ValueError, match="another selection"):
        selection.forward_select(list("ab"), score, spark=spark, log_path=path)
    with pytest.raises(ValueError):
        selection.forward_select(list("ab"), score, log_path=path)


def test_all_blends_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(6)
    y, m = rng.uniform(1, 100, 700), rng.uniform(0, 100, (700, 3))
    wide = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(y, m)], "y double, `a b` double, b double, c double").repartition(5)
    weights = rng.uniform(-0.5, 1.5, (3, 40))
    blends = np.maximum(m @ weights, 0)
    want = np.sqrt(((np.log1p(blends) - np.log1p(y)[:, None]) ** 2).mean(axis=0))
    for cells in (1 << 20, 64):
        monkeypatch.setattr(ensemble, "CELLS", cells)
        assert ensemble.score_blends(wide, "y", ["a b", "b", "c"], weights, ensemble.RMSLE) == pytest.approx(want)
    largest = ensemble.ScoreKernel(lambda y, p: (np.abs(p - y[:, None]) ** 8).sum(axis=0)[None], lambda s: s[0] ** 0.125)
    assert ensemble.score_blends(wide, "y", ["a b", "b", "c"], weights, largest) == pytest.approx(((np.abs(blends - y[:, None]) ** 8).sum(axis=0)) ** 0.125)
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"blends {n}", "")
        ensemble.score_blends(wide, "y", ["a b", "b", "c"], weights[:, :n], ensemble.RMSLE)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"blends {n}"))

    assert jobs(40) == jobs(1)


def test_climb_with_a_kernel_and_with_an_aggregate(spark):
    rng = np.random.default_rng(7)
    y = rng.uniform(10, 100, 300)
    models = [np.clip(y * f + rng.normal(0, s, 300), 0, None) for f, s in ((1.2, 4), (0.9, 8), (1.0, 20))]
    wide = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, *models)], "y double, a double, b double, c double")
    one = ensemble.hill_climb(wide, list("abc"), "y", step=0.1)
    other = ensemble.hill_climb(wide, list("abc"), "y", step=0.1, scoring_fn=lambda y, p: rmsle(y, p))
    assert [s[:3] for s in one.steps] == [s[:3] for s in other.steps] and one.score == pytest.approx(other.score)
    squared = ensemble.hill_climb(wide, list("abc"), "y", step=0.1, kernel=ensemble.RMSE)
    blend = sum(squared.weights[m] * v for m, v in zip("abc", models))
    assert squared.score == pytest.approx(np.sqrt(((np.maximum(blend, 0) - y) ** 2).mean()))
