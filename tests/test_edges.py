"""Missing, constant, many-valued and large values in fits, stores and blends."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.functions import bins, power
from foldsmith.functions.scalar import cap_outliers_iqr
from foldsmith.models import boosting, ensemble, linear, trainers
from foldsmith.operators import encoders, folds, lookup, metrics, ordering
from foldsmith.sources import feature_store as fs
from foldsmith.storage import scratch_path

SMALL = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def noisy(spark):
    """y is normal with deviation 10 around 100 + 5x; s has 60 values."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 1500)
    y = 100 + 5 * x + rng.normal(0, 10, 1500)
    rows = [(str(i), float(a), f"v{i % 60:02d}", float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return folds.kfold(spark.createDataFrame(rows, "id string, x double, s string, y double"), 3).cache()


def test_predicted_deviation_is_the_true_one(noisy):
    trainer = trainers.CVTrainer(SMALL, n_splits=3, log_transform_targets=False)
    oof, _, _ = trainers.predict_mean_std(trainer, noisy, "y", ["x"], noisy)
    assert oof.agg(F.avg("pred_std")).first()[0] == pytest.approx(10, rel=0.15)


def test_text_of_many_values_and_missing_below_any_value(noisy):
    run = trainers.CVTrainer(SMALL, n_splits=3).train_and_score(noisy, "y", ["x", "s"], noisy)
    assert run.oof.count() == 1500 and run.test.filter("pred IS NULL").count() == 0
    low = noisy.withColumn("x", F.when(F.col("x") > 5, F.col("x") - 1e12))
    fitted = trainers.assembler(low, ["x", "s"])
    assert fitted.missing["x"] < low.agg(F.min("x")).first()[0] and len(fitted.levels["s"]) == 60 and fitted.max_bins == 62
    few = trainers.assembler(low, ["x", "s"], max_levels=5)
    assert few.levels["s"] == [f"v{i:02d}" for i in range(5)]  # all as frequent, so by value
    codes = trainers.vectorised(low.limit(1).select("id", F.lit("new").alias("s"), F.lit(None).cast("double").alias("x")), few, ["id"]).first()
    assert list(codes["features"]) == [fitted.missing["x"], 1.0]


def test_run_is_cut_at_the_best_iteration(noisy):
    absolute = lambda y, p: F.avg(F.abs(y - p))
    trainer = trainers.CVTrainer({**SMALL, "n_estimators": 12, "learning_rate": 0.9}, n_splits=3, log_transform_targets=False,
                                 scoring_fn=absolute, early_stop_rounds=2)
    run = trainer.train_and_score(noisy, "y", ["x"])
    errors = run.oof.join(noisy.select("id", "fold"), "id").groupBy("fold").agg(absolute(F.col("y"), F.col("pred")).alias("e"))
    errors = {r["fold"]: r["e"] for r in errors.collect()}
    assert [m.getNumTrees for m in run.models] == run.best_iterations
    for k, n in enumerate(run.best_iterations):
        assert errors[k] == pytest.approx(trainer.curves[k][n - 1]) and n == boosting.best_iteration(trainer.curves[k], 2)
    assert min(run.best_iterations) < 12


def test_segments_take_in_every_value(noisy):
    parts = noisy.withColumn("part", F.when(F.col("x") > 3, F.when(F.col("x") > 6, "b").otherwise("a")))
    run = trainers.cv_by_segment(trainers.CVTrainer(SMALL, n_splits=3), parts, "y", ["x"], "part", test=parts)
    assert run.oof.count() == 1500 and run.test.count() == 1500
    with pytest.raises(ValueError, match="no run for"):
        trainers.cv_by_segment(trainers.CVTrainer(SMALL, n_splits=3), parts, "y", ["x"], "part", ["a", "b"])


def test_blend_and_ridge_refuse_missing_predictions(spark):
    wide = spark.createDataFrame([("1", 0, 1.0, 1.0, 2.0), ("2", 1, 2.0, 2.0, None), ("3", 0, 3.0, 3.0, 1.0)],
                                 "id string, fold int, y double, a double, b double")
    with pytest.raises(ValueError, match="missing"):
        ensemble.hill_climb(wide, ["a", "b"], "y")
    with pytest.raises(ValueError, match="missing"):
        linear.gram_by_fold(wide, ["a", "b"], "y")
    assert linear.gram_by_fold(wide, ["a"], "y", log_target=False).whole.tolist() == [[3, 6, 6], [6, 14, 14], [6, 14, 14]]


def test_climb_by_another_score_runs_to_its_end(spark):
    rng = np.random.default_rng(2)
    y = rng.uniform(1, 9, 300)
    rows = [(float(v), float(v + a), float(v - 2 * a)) for v, a in zip(y, rng.normal(1, 0.3, 300))]
    wide = spark.createDataFrame(rows, "y double, a double, b double")
    absolute = lambda t, p: F.avg(F.abs(t - p))
    climb = ensemble.hill_climb(wide, ["a", "b"], "y", scoring_fn=absolute)
    assert climb.converged and climb.score < 0.1 and climb.weights["a"] == pytest.approx(2 / 3, abs=0.02)
    assert not ensemble.hill_climb(wide, ["a", "b"], "y", max_steps=1, tol=0.0, step=0.1).converged


def test_gram_of_many_columns_is_one_pass(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 5).cast("int").alias("fold"), F.rand(1).alias("y"),
                                  *[F.rand(i).alias(f"c{i}") for i in range(71)])
    gram = linear.gram_by_fold(df, [f"c{i}" for i in range(71)], "y")
    assert gram.whole.shape == (73, 73) and gram.whole[0, 0] == 2000 and len(gram.folds) == 5


def test_bins_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(str(i), 7.0, None, float(i)) for i in range(6)], "id string, k double, e double, x double")
    for strategy in bins.STRATEGIES:
        tr, _ = bins.compute_binned(df, df, 5, strategy, "k")
        assert {r[f"bins_k_5_{strategy}"] for r in tr.collect()} == {0.0}
        tr, _ = bins.compute_binned(df, df, 5, strategy, "e")
        assert {r[f"bins_e_5_{strategy}"] for r in tr.collect()} == {None}


def test_all_bins_at_once_are_the_single_ones(spark):
    df = spark.range(300).select((F.rand(3) * 50).alias("a"), F.floor(F.rand(4) * 9).cast("double").alias("b"))
    specs = bins.all_specs(["a", "b"], range(3, 6))
    together = bins.fit_all(df, specs)
    for n, strategy, c in specs:
        assert together[n, strategy, c] == pytest.approx(bins.FITS[strategy](df, c, n))


def test_power_fit_leaves_its_first_range(spark):
    x = np.exp(np.random.default_rng(3).normal(0, 1, 800) * 0.05)
    steep = spark.createDataFrame([(float((v * 8) ** 0.12 - 1),) for v in x], "x double")
    best = power.fit(steep, "x")
    scores = power.log_likelihoods(steep, "x", [best - 0.2, best, best + 0.2])
    assert best > 4 and scores[1] == max(scores)
    with pytest.raises(ValueError):
        power.fit(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x")


def test_store_keeps_types_and_counts_once(spark):
    store = fs.FeatureStore(spark, scratch_path(spark, "edge-store"))
    day = datetime.date(2024, 2, 29)
    rows = spark.createDataFrame([("1", 2 ** 53 + 1, day, True, "t", None), ("2", None, None, None, None, 0.5)],
                                 "id string, big long, day date, flag boolean, txt string, num double")
    meta = {"type": "t", "subtype": "s"}
    names = ["big", "day", "flag", "txt", "num"]
    store.save_many(rows, rows, {n: meta for n in names})
    train, test = store.read_features(names)
    assert sorted(map(tuple, train.collect())) == sorted(map(tuple, rows.collect())) and test.count() == 2
    store.save(rows, rows, "big", meta)
    assert store.overview().first()["features"] == 5
    for name, n in (("two", 2), ("four", 4)):
        store.save_folded(spark.createDataFrame([(str(i), k, p, 1.0) for i in range(2) for k in range(n) for p in ("train", "val", "test")],
                                                f"id string, outer_fold int, part string, {name} double"), name,
                          {**meta, "outer_folds": n, "feature_list": [name]})
    assert len(store.read_features_by_fold(column_names=["two"])) == 2
    assert len(store.read_features_by_fold(column_names=["four"])) == 4


def test_codes_of_text_and_of_large_whole_numbers(spark):
    df = spark.createDataFrame([("b", 2 ** 53), ("a", 2 ** 53 + 1), (None, None), ("b", 2 ** 53)], "s string, n long")
    found, _ = encoders.category_codes(df, df, ["s", "n"])
    assert sorted(map(tuple, found.select("s", "s_cat", "n_cat").collect()), key=str) == sorted(
        [("b", 1, 0), ("a", 0, 1), (None, None, None), ("b", 1, 0)], key=str)


def test_ranks_take_their_group_size_from_the_range_totals(spark):
    df = spark.createDataFrame([("1", "a", 5.0), ("2", "a", 5.0), ("3", "a", 9.0), ("4", "b", 1.0), ("5", None, 2.0), ("6", "a", None)],
                               "id string, k string, v double")
    found = {r["id"]: r["r"] for r in ordering.groupby_then_rank(df, "v", "k", "r").collect()}
    assert found == {"1": 0.5, "2": 0.5, "3": 1.0, "4": 1.0, "5": 1.0, "6": None}


def test_broadcast_bound_is_in_bytes(spark):
    table = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array_repeat("id", 20).alias("a"))
    assert 100 * 1016 < lookup.measured_bytes(table) < 100 * 3000
    assert lookup.is_small(table) and not lookup.is_small(table, 50_000)


def test_correlations_of_200_columns_with_gaps(spark):
    df = spark.range(500).select(*[F.when(F.rand(1000 + i) > 0.1, F.rand(i) + 1e6).alias(f"c{i}") for i in range(200)]).cache()
    found = metrics.correlation_matrix(df, df.columns)
    want = df.toPandas().corr().to_numpy()
    assert np.abs(found - want).max() < 1e-6
    assert metrics.drop_correlated(df.withColumn("again", -2 * F.col("c7")), [*df.columns, "again"]).filter("dropped").first()["column_name"] == "again"


def test_capping_leaves_a_column_without_values(spark):
    train = spark.createDataFrame([(1, None, float(i)) for i in range(20)] + [(1, None, 1e6)], "id int, none double, x double")
    test = spark.createDataFrame([(2, 7.0, -1e6)], "id int, none double, x double")
    capped, other = cap_outliers_iqr(train, test, ["none", "x"])
    assert capped.filter("none IS NOT NULL").count() == 0 and capped.agg(F.max("x")).first()[0] < 100
    assert other.first()["none"] == 7.0 and other.first()["x"] > -100
