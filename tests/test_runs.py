"""From raw frames to a submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith import creators, runs
from foldsmith.models.trainers import CVTrainer
from foldsmith.plans import standin
from foldsmith.sources.feature_store import FeatureStore


def test_features_models_and_blend(spark, sf_dir, tmp_path):
    halves = F.when(F.col("fold") < 2, 0).otherwise(1)
    train = standin.train(spark, sf_dir).withColumn("fold", halves).cache()
    test = standin.test(spark, sf_dir).cache()
    store = FeatureStore(spark, str(tmp_path / "store"))

    pairs = creators.create_pair_features(store, train, test, [("qty", "line"), ("qty", "qty")], ops=["Multiply", "Minus", "Plus"],
                                          combine=[("status", "flag")], group_means=[("disc", "mon")],
                                          group_ranks=[("qty", "status")])
    # qty + qty repeats nothing before it, so only exact repeats are left out
    assert "Multiply_qty_line" in pairs and "Combine_status_flag" in pairs and "groupby_then_rank_qty_by_status" in pairs
    assert len(creators.create_polynomials(store, train, test, ["qty", "disc"])) == 2
    assert len(creators.create_masked(store, train, test, ["qty"], "status", {"F": "F", "O": "O"})) == 2
    assert creators.create_bins(store, train, test, ["qty"], range(3, 4)) == [
        "bins_qty_3_uniform", "bins_qty_3_quantile", "bins_qty_3_kmeans"]
    maps = creators.create_external_maps(store, train, test, standin.ext(spark, sf_dir), ["status", "qty"], "y", "mean", scale=100)
    assert len(maps) == 3
    te = creators.create_target_encodings(store, train, test, "y", [["qty"]], n_splits=2, scale=100)
    nested = creators.create_nested_target_encodings(store, train, test, "y", [["qty"]], outer=2, scale=100)
    assert {r["column_name"] for r in store.catalog().collect()} >= {*pairs, *maps, *te, *nested}
    assert store.read_features_by_fold(column_names=nested)[1][1].count() == train.filter("fold = 1").count()

    path, out = str(tmp_path / "predictions"), str(tmp_path / "out")
    trainer = CVTrainer({"n_estimators": 3, "max_depth": 3, "learning_rate": 0.5}, n_splits=2, clip_preds=(1.0, None))
    first = runs.run_model("trees", trainer, train, test, "y", ["qty", "disc"], path, store, [*te, "masked_qty_x_F"])
    runs.run_model("trees_small", trainer, train, test, "y", ["mon"], path)
    climb, score = runs.run_hill_climb(spark, path, train, "y", out, bounds=(1.0, 200000.0))
    assert score <= first.score + 1e-9 and abs(score - climb.score) < 1e-6
    written = spark.read.csv(f"{out}/submission", header=True, schema="id string, y double")
    assert written.count() == test.count() == written.select("id").distinct().count()
    weights = spark.read.csv(f"{out}/weights", header=True, schema="model string, weight double").collect()
    assert {r["model"] for r in weights} <= {"trees", "trees_small"}
    ridge = runs.run_ridge_stack(spark, path, train, "y", out, alpha=1.9, bounds=(1.0, None))
    assert ridge < 1.2 * first.score
    assert spark.read.csv(f"{out}/submission", header=True).count() == test.count()
    stack = runs.run_gbt_stack(spark, path, trainer, train, test, "y", out, ["qty", "mon"], store, ["masked_qty_x_F", *te], bounds=(1.0, 200000.0))
    assert stack.score < 1.2 * first.score and stack.oof.count() == train.count()
    written = spark.read.csv(f"{out}/submission", header=True, schema="id string, y double")
    assert written.count() == test.count() == written.filter("y BETWEEN 1 AND 200000").select("id").distinct().count()


def test_pair_search(spark, tmp_path):
    """Pairs come from types and counts; constants take no part, repeats are left out across blocks."""
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), ((F.col("id") * 37) % 101).cast("double").alias("x"), (F.col("id") % 4 + 1).alias("k"),
                                 F.lit(5).alias("same"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("s"))
    columns = ["x", "k", "same", "s"]
    pairs = creators.candidate_pairs(df, columns, 10)
    assert pairs == {"arith": [("x", "k")], "combine": [("k", "s")], "group": [("x", "k"), ("x", "s"), ("k", "s")]}
    assert creators.candidate_pairs(df, columns)["combine"] == []
    sizes = {}
    for at_once in (3, 60):
        store = FeatureStore(spark, str(tmp_path / f"store{at_once}"))
        found = creators.search_pair_features(store, df, df, columns, max_nunique_if_numeric=10, max_corr=0.999, at_once=at_once)
        assert set(found) == {r["column_name"] for r in store.catalog().collect()}
        assert store.read_features(found)[0].count() == 200
        sizes[at_once] = sorted(found)
        # the least of x and 1..4 hardly differs from x, and so does their maximum
        assert "Combine_k_s" in found and "Multiply_x_k" in found and "Max_x_k" not in found and "Plus_x_k" not in found
    assert sizes[3] == sizes[60]
