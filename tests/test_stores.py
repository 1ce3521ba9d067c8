"""Feature store and prediction store."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foldsmith.sources import predictions as store
from foldsmith.sources.feature_store import FeatureStore, MissingFeatures


def split(spark, name, values, kind="double"):
    return spark.createDataFrame([(str(i), v) for i, v in values], f"id string, {name} {kind}")


@pytest.fixture
def fs(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "store"))
    made.save(split(spark, "f", [(1, 1.0), (2, None)]), split(spark, "f", [(3, 3.0)]), "f",
              {"type": "t", "subtype": "s", "created_at": datetime(2025, 1, 1)})
    made.save(split(spark, "c", [(1, "x"), (2, "y")], "string"), split(spark, "c", [(3, "z")], "string"), "c",
              {"type": "u", "subtype": "s", "created_at": datetime(2025, 1, 2)})
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_read_back_by_name_and_by_criteria(fs):
    train, test = fs.read_features(["c", "f"])
    assert train.columns == ["id", "c", "f"]
    assert rows(train) == [("1", "x", 1.0), ("2", "y", None)] and rows(test) == [("3", "z", 3.0)]
    assert fs.read_features(criteria={"type": ("u",)})[0].columns == ["id", "c"]
    assert fs.read_features(newest_first_=True)[0].columns == ["id", "c", "f"]


def test_saving_again_replaces_and_newest_prefix_wins(fs, spark, caplog):
    fs.save(split(spark, "f", [(1, 8.0)]), split(spark, "f", [(3, 9.0)]), "f", {"type": "t", "created_at": datetime(2025, 2, 1)})
    assert "already exists" in caplog.text
    assert rows(fs.read_features(["f"])[0]) == [("1", 8.0)]
    fs.save(split(spark, "f", [(1, 7.0)]), split(spark, "f", [(3, 7.0)]), "f",
            {"type": "t", "filename_prefix": "f_v2", "created_at": datetime(2025, 3, 1)})
    assert rows(fs.read_features(["f"])[0]) == [("1", 7.0)]
    assert rows(fs.read_features(["c"])[1]) == [("3", "z")]


def test_missing_names_are_reported(fs):
    with pytest.raises(MissingFeatures, match="nope"):
        fs.read_features(["f", "nope"])
    with pytest.raises(MissingFeatures):
        fs.read_features(criteria={"type": ("nope",)})


def test_types_survive(fs, spark):
    fs.save(split(spark, "n", [(1, 5)], "int"), split(spark, "n", [(3, 6)], "int"), "n", {"type": "t"})
    assert dict(fs.read_features(["n"])[0].dtypes)["n"] == "int"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_take_the_chosen_columns_and_files_alone(fs):
    train = fs.read_features(["f"])[0]
    assert "ReadSchema: struct<id:string,f:double>" in plan_of(train)
    assert train.inputFiles() and all("/split=train/" in f for f in train.inputFiles())


def test_families_meet_without_a_shuffle(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "wide"), buckets=5)
    frame = lambda start, names: spark.range(start, start + 300).select("id", *[(F.col("id") * k).alias(n) for k, n in enumerate(names)])
    names = [[f"{letter}{i}" for i in range(8)] for letter in "abc"]
    for some in names:
        made.save_many(frame(0, some), frame(1000, some), {n: {"type": "t"} for n in some})
    train, test = made.read_features([n for some in names for n in some])
    plan = plan_of(train)
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 3 and "SelectedBucketsCount: 5 out of 5" in plan
    assert sorted(tuple(r) for r in train.collect()) == sorted((str(i), *[i * k for _ in range(3) for k in range(8)]) for i in range(300))
    assert test.count() == 300 and made.buckets() == 5
    assert FeatureStore(spark, str(tmp_path / "wide"), buckets=9).buckets() == 5  # the store's own number stays


def test_a_new_session_object_reads_the_store(fs, spark):
    again = FeatureStore(spark.newSession(), fs.path)
    assert rows(again.read_features(["c", "f"])[0]) == [("1", "x", 1.0), ("2", "y", None)]


def test_families_with_other_ids_keep_them_all(fs, spark):
    fs.save(split(spark, "g", [(2, 5), (9, 6)], "int"), split(spark, "g", [(3, 7)], "int"), "g", {"type": "t"})
    train, test = fs.read_features(["f", "g", "c"])
    assert rows(train.fillna({"f": -1.0, "g": -1, "c": "none"})) == [("1", 1.0, -1, "x"), ("2", -1.0, 5, "y"), ("9", -1.0, 6, "none")]
    assert rows(test) == [("3", 3.0, 7, "z")]


def test_repeated_ids_are_refused_and_leave_no_trace(fs, spark):
    with pytest.raises(ValueError, match="repeat"):
        fs.save(split(spark, "r", [(1, 1), (1, 2)], "int"), split(spark, "r", [(3, 7)], "int"), "r", {"type": "t"})
    with pytest.raises(MissingFeatures):
        fs.read_features(["r"])


def test_vacuum_removes_overwritten_and_unfinished_families(fs, spark):
    fs.save(split(spark, "f", [(1, 8.0)]), split(spark, "f", [(3, 9.0)]), "f", {"type": "t"})
    with pytest.raises(ValueError, match="repeat"):
        fs.save(split(spark, "r", [(1, 1), (1, 2)], "int"), split(spark, "r", [(3, 7)], "int"), "r", {"type": "t"})
    assert len(fs.vacuum()) == 2 and fs.vacuum() == []
    assert rows(fs.read_features(["f"])[0]) == [("1", 8.0)] and rows(fs.read_features(["c"])[1]) == [("3", "z")]


def test_odd_column_names(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "it's odd"))
    frame = spark.createDataFrame([("1", 2.0, 3)], "id string, `a b` double, `x.y` int")
    made.save_many(frame, frame, {"a b": {"type": "t"}, "x.y": {"type": "t"}})
    assert rows(made.read_features(["x.y", "a b"])[0]) == [("1", 3, 2.0)]


def folded(spark, name, folds, shift=0.0):
    data = [(str(i), o, p, i + o + shift) for o in range(folds) for i, p in ((1, "train"), (2, "val"), (3, "test"))]
    return spark.createDataFrame(data, f"id string, outer_fold int, part string, {name} double")


def test_folded_features(fs, spark):
    meta = {"type": "te", "agg": "mean", "outer_folds": 2, "inner_folds": 4, "created_at": datetime(2025, 1, 3)}
    fs.save_folded(folded(spark, "te_a", 2), "te_a", {**meta, "feature_list": ["b", "a"]})
    fs.save_folded(folded(spark, "te_c", 2, 0.5), "te_c", {**meta, "feature_list": ["c"]})
    parts = fs.read_features_by_fold(feature_lists=[["a", "b"], ["c"]], agg=["mean"])
    assert len(parts) == 2
    assert rows(parts[1][1]) == [("2", 3.0, 3.5)]
    with pytest.raises(MissingFeatures):
        fs.read_folded(feature_lists=[["a"]])
    with pytest.raises(ValueError, match="outer folds given"):
        fs.save_folded(folded(spark, "te_d", 1), "te_d", {**meta, "feature_list": ["d"]})
    fs.save_folded(folded(spark, "te_e", 3), "te_e", {**meta, "outer_folds": 3, "feature_list": ["e"]})
    with pytest.raises(ValueError, match="different numbers"):
        fs.read_folded(column_names=["te_a", "te_e"])
    # plain reads do not see folded features
    with pytest.raises(MissingFeatures):
        fs.read_features(["te_a"])


def test_overview_counts(fs):
    assert sum(r["features"] for r in fs.overview().collect()) == 2


def preds(spark, data):
    return spark.createDataFrame(data, "model string, split string, id string, pred double")


def test_full_refit_is_preferred_and_models_without_test_are_rejected(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = lambda *v: spark.createDataFrame(v, "id string, pred double")
    store.predictions_write(path, "m1", oof=frame(("1", 1.0)), test=frame(("9", 2.0)), test_from_full=frame(("9", 3.0)))
    store.predictions_write(path, "m2", oof=frame(("1", 4.0)), test=frame(("9", 5.0)))
    loaded = store.predictions_load(store.predictions_read(spark, path))
    assert rows(loaded) == [("oof", "m1", "1", 1.0), ("oof", "m2", "1", 4.0), ("test", "m1", "9", 3.0), ("test", "m2", "9", 5.0)]
    store.predictions_write(path, "m2", test=frame(("9", 6.0)))
    again = store.predictions_load(store.predictions_read(spark, path))
    assert ("test", "m2", "9", 6.0) in rows(again) and ("oof", "m2", "1", 4.0) in rows(again)
    store.predictions_write(path, "m3", oof=frame(("1", 4.0)))
    with pytest.raises(ValueError, match="m3"):
        store.predictions_load(store.predictions_read(spark, path))
    with pytest.raises(ValueError, match="unknown split"):
        store.predictions_write(path, "m3", other=frame(("1", 4.0)))


def test_runs_are_seen_once_their_manifest_row_is_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    frame = lambda *v: spark.createDataFrame(v, "id string, pred double")
    store.predictions_write(path, "m", 0.5, [3, 4], {"maxDepth": 3}, oof=frame(("1", 1.0)), test=frame(("9", 2.0)))
    with monkeypatch.context() as stopped:  # the driver is lost between the rows and the manifest
        stopped.setattr(store, "committed", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.predictions_write(path, "m", 0.1, oof=frame(("1", 7.0)), test=frame(("9", 7.0)))
        with pytest.raises(ZeroDivisionError):
            store.predictions_write(path, "half", 0.1, oof=frame(("1", 7.0)))
    assert rows(store.predictions_read(spark, path)) == [("1", 1.0, "m", "oof"), ("9", 2.0, "m", "test")]
    run = store.latest_runs(spark, path).first()
    assert (run["score"], run["best_iterations"], run["params"]) == (0.5, [3, 4], {"maxDepth": "3"})
    store.predictions_write(path, "m", 0.4, test_from_full=frame(("9", 3.0)))
    assert {s: len(v) for s, v in store.committed(spark, path)["m"].items()} == {"oof": 32, "test": 32, "test_from_full": 32}
    assert store.manifest(spark, path).count() == 2 and store.latest_runs(spark, path).first()["score"] == 0.4
    assert len(store.predictions_vacuum(spark, path)) == 3 and store.predictions_vacuum(spark, path) == []  # two splits of one version, and one
    loaded = store.predictions_load(store.predictions_read(spark, path), store.committed(spark, path))
    assert rows(loaded) == [("oof", "m", "1", 1.0), ("test", "m", "9", 3.0)]
    plan = plan_of(loaded)
    assert "PartitionFilters" in plan and "version" in plan


def test_blend_uses_negative_weights_and_clips_models_first(spark):
    p = preds(spark, [("a", "test", "1", 10.0), ("b", "test", "1", -5.0), ("c", "test", "1", 4.0)])
    w = spark.createDataFrame([("a", 1.5), ("b", 1.0), ("c", -0.5)], "model string, weight double")
    assert [r["pred"] for r in store.blend_predictions(p, w).collect()] == [13.0]
    assert rows(store.models_not_used(p, w.filter("model <> 'c'"))) == [("c",)]


def test_submission_file(spark, tmp_path):
    path = str(tmp_path / "s")
    store.submission_write(preds(spark, [("a", "test", "1", 400.0), ("a", "test", "2", -3.0)]), path, "Calories", 1.0, 314.0)
    back = spark.read.csv(path, header=True, schema="id string, Calories double")
    assert rows(back) == [("1", 314.0), ("2", 1.0)]


def test_id_mismatch(spark):
    p = preds(spark, [("a", "test", "1", 0.0), ("a", "test", "2", 0.0), ("b", "test", "2", 0.0), ("b", "test", "3", 0.0)])
    assert rows(store.id_mismatch_report(p, "a", ["a", "b"])) == [("a", 0, 0), ("b", 1, 1)]


def test_imported_predictions_come_back_to_scale(spark):
    df = spark.createDataFrame([(7, 0.0), (8, 1.0)], "row int, p double")
    got = store.predictions_import(df, "net", "oof", "row", "p").select("id", F.round("pred", 6)).collect()
    assert sorted(tuple(r) for r in got) == [("7", 0.0), ("8", 1.718282)]
