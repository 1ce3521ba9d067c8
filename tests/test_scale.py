"""What large tables go through, on small ones: cells instead of rows, lookups of worked-out encodings, distinct counts without pairs."""

from __future__ import annotations

import gc
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from foldsmith.models import selection, trainers
from foldsmith.operators import external
from foldsmith.operators.folds import kfold
from foldsmith.plans import registry
from foldsmith.storage import shuffles_dropped, write_buckets, write_table

SMALL = {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3}


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("int").alias("z"),
                                    F.when(F.col("id") % 11 == 0, None).otherwise(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int"))).alias("s"),
                                    (F.lit(5.0) + F.pmod(F.xxhash64("id"), F.lit(100)) / 10 + F.col("id") % 7 * 3 + F.col("id") % 3).alias("y"))
    return kfold(made, 3).withColumn("w", F.col("z") + 1.0).cache()


def both(monkeypatch, run):
    """What ``run`` gives on rows, and on cells."""
    made, whole = [], trainers.cells_of
    monkeypatch.setattr(trainers, "cells_of", lambda df, *a: made.append(1) or whole(df, *a))
    plain = run()
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    made.clear()
    cells = run()
    assert made  # cells were used
    return plain, cells


def predictions(run):
    return {r["id"]: r["pred"] for df in (run.oof, run.test) if df is not None for r in df.collect()}


@pytest.mark.parametrize("options", [{}, {"weight_col": "w"}, {"early_stop_rounds": 2, "chunk": 2}, {"early_stop_rounds": 2, "eval_metric": lambda y, p: F.avg(F.abs(y - p))}])
def test_runs_on_cells_equal_runs_on_rows(monkeypatch, rows, options):
    def run():
        trainer = trainers.CVTrainer(SMALL, n_splits=3, **options)
        run = trainer.train_and_score(rows, "y", ["x", "z", "s"], rows.withColumn("id", F.concat(F.lit("t"), "id")))
        return run.score, run.best_iterations, predictions(run), [c for curve in trainer.curves for c in curve]
    plain, cells = both(monkeypatch, run)
    assert cells[0] == pytest.approx(plain[0], abs=1e-9) and cells[1] == plain[1]
    assert cells[2] == pytest.approx(plain[2], abs=1e-9) and cells[3] == pytest.approx(plain[3], abs=1e-9)


def test_outliers_stay_out_of_cells(monkeypatch, rows):
    def run():
        _, second, outliers = trainers.two_round_outlier_fit(trainers.CVTrainer(SMALL, n_splits=3), rows, "y", ["x", "s"], q=0.9)
        return second.score, {r[0] for r in outliers.select("id").collect()}
    plain, cells = both(monkeypatch, run)
    assert cells[0] == pytest.approx(plain[0], abs=1e-9) and cells[1] == plain[1]


def test_refit_on_cells(monkeypatch, rows):
    def run():
        out = trainers.CVTrainer(SMALL, n_splits=3).train_on_full(rows, "y", ["x", "z", "s"], rows, [2, 3, 4])
        return {r["id"]: r["pred"] for r in out.collect()}
    plain, cells = both(monkeypatch, run)
    assert cells == pytest.approx(plain, abs=1e-9)


@pytest.mark.parametrize("options", [{}, {"early_stop_rounds": 2, "chunk": 2}])
def test_folded_columns_on_cells(monkeypatch, rows, options):
    parts = [rows.select("id", F.lit(k).alias("outer_fold"), F.lit(p).alias("part"), (F.col("x") * F.lit(k + 1.0)).alias("te"))
             for k in range(3) for p in ("train", "val", "test")]
    folded = write_table(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]).unionByName(parts[5])
                         .unionByName(parts[6]).unionByName(parts[7]).unionByName(parts[8]), "folded", ["outer_fold", "part"])
    assert folded.columns == ["id", "outer_fold", "part", "te"]
    assert len(folded.where("outer_fold = 1 AND part = 'val'").inputFiles()) and folded.count() == 27000

    def run():
        return predictions(trainers.CVTrainer(SMALL, n_splits=3, fn_modify_fold_data=trainers.with_folded_features(folded, ["te"]), **options)
                           .train_and_score(rows, "y", ["z", "te"], rows))
    plain, cells = both(monkeypatch, run)
    assert cells == pytest.approx(plain, abs=1e-9)


def test_selection_on_cells(monkeypatch, rows):
    def run():
        with selection.TreeScorer(trainers.CVTrainer(SMALL, n_splits=3), rows, "y", ["x", "z", "s"]) as scorer:
            return [scorer(c) for c in (["x"], ["s", "x"], ["z", "x", "s"])]
    plain, cells = both(monkeypatch, run)
    assert cells == pytest.approx(plain, abs=1e-9)


def test_fold_by_fold_scores_on_cells(monkeypatch, rows):
    def run():
        told = []
        return [trainers.CVTrainer(SMALL, n_splits=3).score_by_fold(rows, "y", ["x", "s"], told.append), *told]
    plain, cells = both(monkeypatch, run)
    assert cells == pytest.approx(plain, abs=1e-9)


def test_adversarial_on_cells(monkeypatch, rows):
    def run():
        sides = rows.where("z < 3 OR x > 4"), rows.where("z >= 1").withColumn("id", F.concat(F.lit("t"), "id"))
        found, importances, oof = trainers.adversarial_validation(*sides, ["x", "z", "s"], SMALL, 3)
        return found.first()["auc"], {r[0]: r[1] for r in importances.collect()}, {r["id"]: r["score"] for r in oof.collect()}
    plain, cells = both(monkeypatch, run)
    for a, b in zip(plain, cells):
        assert b == pytest.approx(a, abs=1e-9)


def test_cells_refuse_missing_labels(monkeypatch, rows):
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    with pytest.raises(ValueError, match="labels"):
        trainers.CVTrainer(SMALL, n_splits=3).train_and_score(rows.withColumn("y", F.when(F.col("x") > 1, F.col("y"))), "y", ["x"])


@pytest.mark.parametrize("hot", [4096, 3, 0])
def test_distinct_counts_by_combination(monkeypatch, spark, hot):
    monkeypatch.setattr(external, "HOT", hot)
    made = spark.range(600).select(F.when(F.col("id") % 13 > 0, (F.col("id") % 4).cast("double")).alias("a"), F.concat(F.lit("k"), F.col("id") % 3).alias("b"),
                                   F.when(F.col("id") % 17 > 0, F.pmod(F.xxhash64("id"), F.lit(90)) / 2.0).alias("y"), (F.col("id") % 2).alias("c"))
    made = made.unionByName(made.limit(100)).unionByName(spark.createDataFrame([(9.0, "only", None, 1), (-0.0, "k0", float("nan"), 0), (0.0, "k0", float("nan"), 1)], "a double, b string, y double, c long"))
    calls, whole = [], external.roll_up
    monkeypatch.setattr(external, "roll_up", lambda *a, **o: calls.append(o.get("always")) or whole(*a, **o))
    got = {tuple(r) for r in external.external_by_combo(made, ["a", "b", "c"], "y", "nunique").collect()}
    want = set()
    for keys in external.combos(["a", "b", "c"]):
        for r in made.groupBy(*keys).agg(F.count_distinct("y").alias("v")).collect():
            want.add(("_".join(keys), *[r[c] if c in keys else None for c in ("a", "b", "c")], r["v"]))
    assert got == want
    assert (["__y"] in calls) == (hot < 4096)  # pairs of key and value are made for hot values alone


def test_distinct_counts_keep_no_arrays_of_earlier_batches():
    columns, held = ["a", "b", "c", "d"], []

    def batches():
        for k in range(12):
            held.append(tracemalloc.get_traced_memory()[0])
            values = [k * 1000 + n // 2 for n in range(2000)]
            yield pa.RecordBatch.from_pydict({**{c: [n % (i + 2) for n in range(2000)] for i, c in enumerate(columns)}, "__y": values})

    gc.disable()
    tracemalloc.start()
    try:
        told = sum(b.num_rows for b in external._repeats(columns, list(range(1, 16)))(batches()))
    finally:
        tracemalloc.stop()
        gc.enable()
    assert told == 24000 and held[-1] - held[2] < 15 * 2000 * 8  # less than what one batch needs


@pytest.mark.parametrize("options", [{}, {"weight_col": "w", "chunk": 2}, {"scoring_fn": lambda y, p: F.avg(F.abs(y - p))}])
def test_trees_on_drawn_rows_come_from_their_sums(monkeypatch, spark, rows, options):
    params = {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.4, "subsample": 0.7}
    trainer = trainers.CVTrainer(params, n_splits=3, **options)
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    monkeypatch.setattr(trainers, "CELLS_PER_ROW", 1.0)
    monkeypatch.setattr(trainers.CVTrainer, "_fit", lambda *a: pytest.fail("fitted on the rows"))
    stored = trainers.stored_rows(rows, ["x", "z", "s"], ["id", "y", "w"])
    run = trainer.train_and_score(stored, "y", ["x", "z", "s"], rows)
    found = {r["id"]: r["pred"] for r in run.oof.collect()}
    assert len(found) == rows.count() == run.test.count() and run.best_iterations == [3, 3, 3]
    assert run.score == pytest.approx(run.oof.agg(trainer.scoring_fn(F.col("y"), F.col("pred"))).first()[0], abs=1e-9)
    assert trainer.train_and_score(rows.repartition(3), "y", ["x", "z", "s"]).score == pytest.approx(run.score, abs=1e-9)
    # the same trees fitted on the drawn rows themselves
    stage, data = trainer.prepared(rows, "y", ["x", "z", "s"])
    fit = data.where("fold <> 0").withColumn("__sum", F.lit(0.0))
    weight = {"weightCol": "w"} if "weight_col" in options else {}
    total, held = F.lit(0.0), data.where("fold = 0")
    for n in range(3):
        target = F.col("__label") if n == 0 else 2.0 * (F.col("__label") - F.col("__sum"))
        drawn = fit.withColumn("__target", target).where(trainer._drawn(n))
        assert 0.5 < drawn.count() / fit.count() < 0.9
        tree = DecisionTreeRegressor(labelCol="__target", predictionCol="__t", maxDepth=2, **weight).fit(drawn)
        step = F.lit(1.0 if n == 0 else 0.4) * F.col("__t")
        fit = tree.transform(fit).withColumn("__sum", F.col("__sum") + step).drop("__t")
        held = tree.transform(held).withColumn(f"__p{n}", step).drop("__t")
        total = total + F.col(f"__p{n}")
    want = {r["id"]: r["p"] for r in held.select("id", F.expm1(total).alias("p")).collect()}
    assert {i: found[i] for i in want} == pytest.approx(want, abs=1e-9)


def test_drawn_rows_that_hardly_equal_are_fitted_themselves(monkeypatch, spark, rows):
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    monkeypatch.setattr(trainers.CVTrainer, "_run_on_drawn_cells", lambda *a: pytest.fail("summed up"))
    trainer = trainers.CVTrainer({"n_estimators": 2, "max_depth": 2, "subsample": 0.7}, n_splits=3)
    own = rows.withColumn("u", F.xxhash64("id").cast("double"))
    assert trainer.train_and_score(own, "y", ["x", "u"]).oof.count() == rows.count()


def test_missing_labels_of_drawn_runs_are_refused(monkeypatch, rows):
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    monkeypatch.setattr(trainers, "CELLS_PER_ROW", 1.0)
    with pytest.raises(ValueError, match="labels"):
        trainers.CVTrainer({"n_estimators": 1, "subsample": 0.5}, n_splits=3).train_and_score(rows.withColumn("y", F.when(F.col("x") > 1, F.col("y"))), "y", ["x"])


@pytest.mark.parametrize("options", [{}, {"weight_col": "w"}, {"early_stop_rounds": 2, "chunk": 2}])
def test_categories_of_more_levels_than_cells(monkeypatch, rows, options):
    """Three letters and none are four cells; with those for missing and other ones the category has five levels."""
    def run():
        trainer = trainers.CVTrainer(SMALL, n_splits=3, **options)
        other = rows.withColumn("id", F.concat(F.lit("t"), "id"))
        run = trainer.train_and_score(rows, "y", ["s"], other)
        return run.score, predictions(run), {r["id"]: r["pred"] for r in trainer.train_on_full(rows, "y", ["s"], other).collect()}
    plain, cells = both(monkeypatch, run)
    for a, b in zip(plain, cells):
        assert b == pytest.approx(a, abs=1e-9)


def test_adversarial_on_a_category_of_one_level(monkeypatch, rows):
    def run():
        sides = rows.withColumn("s", F.lit("a")), rows.withColumns({"id": F.concat(F.lit("t"), "id"), "s": F.lit("a")})
        found, _, oof = trainers.adversarial_validation(*sides, ["s"], SMALL, 3)
        return found.first()["auc"], {r["id"]: r["score"] for r in oof.collect()}
    plain, cells = both(monkeypatch, run)
    for a, b in zip(plain, cells):
        assert b == pytest.approx(a, abs=1e-9)


def test_drawn_rows_of_a_category_of_more_levels_than_cells(monkeypatch, rows):
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    monkeypatch.setattr(trainers, "CELLS_PER_ROW", 1.0)
    monkeypatch.setattr(trainers.CVTrainer, "_fit", lambda *a: pytest.fail("fitted on the rows"))
    run = trainers.CVTrainer({"n_estimators": 3, "max_depth": 2, "subsample": 0.7}, n_splits=3).train_and_score(rows, "y", ["s"])
    assert run.oof.groupBy("pred").count().count() <= 3 * 4 and run.oof.count() == rows.count()


def test_folded_frames_come_together_without_a_shuffle(spark, sf_dir):
    registry.load()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = registry.QUERIES["folded_training_frame"](spark, sf_dir)
        assert "Join" in (plan := made._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert made.count() == 5 * made.select("id").distinct().count()


def test_buckets_keep_rows_and_drop_their_shuffle_files(spark, rows):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in files.split("\n") if "shuffle_" in f}

    odd = rows.unionByName(rows.where("x < 1")).withColumn("id", F.when(F.col("id") != "r5", F.col("id")))
    want = sorted(map(repr, odd.collect()))
    before, kept = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    stored = write_buckets(odd, "odd", ["fold", "z"])
    assert sorted(map(repr, stored.collect())) == want and stored.schema == odd.schema
    with shuffles_dropped(spark):
        write_table(rows.groupBy("x").count(), "counts")
    end = time.time() + 20
    while (left := shuffled() - before) and time.time() < end:
        time.sleep(0.5)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_folds_of_a_hook_are_counted_by_id_without_a_shuffle(monkeypatch, spark, sf_dir):
    registry.load()
    monkeypatch.setattr(trainers, "FEW_ROWS", 0)
    monkeypatch.setattr(trainers.CVTrainer, "_learner", lambda self, *a, made=trainers.CVTrainer._learner, **o: made(self, *a, **{**o, "maxIter": 1, "maxDepth": 2}))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = registry.QUERIES["cv_with_folded_features"](spark, sf_dir)
        assert "hashpartitioning" not in facts._jdf.queryExecution().executedPlan().toString()
        assert all(r["rows"] == r["ids"] > 0 and r["missing"] == r["below"] == 0 and r["score_matches"] in (None, True) for r in facts.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
