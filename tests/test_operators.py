"""Edge cases of joins, encodings, ranks and folds on hand-made frames."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import duplicates, encoders, external, folds, lattice, lookup, metrics, ordering, sets


def keyed(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, fold int, y double")


ROWS = [(1, "a", 0, 1.0), (2, "a", 1, 3.0), (3, "b", 0, 5.0), (4, None, 0, 7.0), (5, None, 1, 9.0), (6, "a", 1, 5.0)]


def by_id(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_out_of_fold_mean_and_keys_seen_in_own_fold_only(spark):
    enc = encoders.TargetEncoder(["k"], n_splits=2).fit(keyed(spark, ROWS), "y")
    got = by_id(enc.transform_train(keyed(spark, ROWS)), "te_mean_k")
    assert got == {1: 4.0, 2: 1.0, 3: None, 4: 9.0, 5: 7.0, 6: 1.0}
    unseen = spark.createDataFrame([(7, "zz"), (8, None), (9, "a")], "id int, k string")
    assert by_id(enc.transform(unseen), "te_mean_k") == {7: None, 8: 8.0, 9: 3.0}


def test_fillna_and_smoothing(spark):
    enc = encoders.TargetEncoder(["k"], n_splits=2, smooth=1.0, fillna=True).fit(keyed(spark, ROWS), "y")
    got = by_id(enc.transform_train(keyed(spark, ROWS)), "te_mean_k")
    without_0, without_1 = (3 + 9 + 5) / 3, (1 + 5 + 7) / 3
    assert got[3] == pytest.approx(without_0, rel=1e-6)
    assert got[1] == pytest.approx((8 + without_0) / 3, rel=1e-6)
    assert got[2] == pytest.approx((1 + without_1) / 2, rel=1e-6)


def test_nested_encoding_never_uses_the_outer_validation_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), i % 3, float(rng.randint(1, 100))) for i in range(60)]
    train = keyed(spark, rows)
    out = encoders.target_encode_nested(train, train.select("id", "k"), "y", ["k"], outer=3, inner=2)
    inner = {o: by_id(train.withColumn("j", folds.inner_fold(o, 2)), "j") for o in range(3)}
    for r in out.collect():
        row = rows[r["id"]]
        o = r["outer_fold"]
        pool = [x for x in rows if x[2] != o and x[1] == row[1]]
        if r["part"] == "train":
            pool = [x for x in pool if inner[o][x[0]] != inner[o][row[0]]]
        want = sum(x[3] for x in pool) / len(pool) if pool else None
        assert r["te_mean_k"] == (None if want is None else pytest.approx(want, rel=1e-6))
    assert Counter((r["part"]) for r in out.collect()) == {"train": 120, "val": 60, "test": 180}


def test_lookup_is_null_safe_and_salting_changes_nothing(spark):
    rng = random.Random(1)
    keys = [None if rng.random() < 0.1 else "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 40)}" for _ in range(3000)]
    base = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    table = base.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 2)
    want = Counter(keys)
    for weight in ("n", None):
        salted = lookup.attach(base, table, ["k"], ["v"], weight=weight, max_broadcast_bytes=0)
        got = salted.collect()
        assert len(got) == 3000
        assert all(r["v"] == want[r["k"]] * 2 for r in got)


def test_salting_splits_only_hot_keys(spark):
    base = spark.range(10_000).select("id", F.when(F.col("id") < 4000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = base.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    left, right = lookup._salted(base, table, ["k"], "n", ["id"])
    copies = {r["k"]: r["count"] for r in right.groupBy("k").count().collect()}
    assert copies[-1] == 100 and all(v == 1 for k, v in copies.items() if k != -1)
    largest = left.groupBy("k", "__salt").count().agg(F.max("count")).first()[0]
    assert largest < 100


def test_lookup_misses_give_null(spark):
    base = spark.createDataFrame([(1, "x")], "id int, k string")
    table = spark.createDataFrame([("y", 1)], "k string, v int")
    assert by_id(lookup.attach(base, table, ["k"]), "v") == {1: None}


def test_align_rejects_different_ids_and_repeated_names(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, x int")
    with pytest.raises(ValueError, match="ids differ"):
        lookup.align_on_id(a, spark.createDataFrame([(1, 1), (3, 2)], "id int, z int"))
    with pytest.raises(ValueError, match="ids differ"):
        lookup.align_on_id(a, spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "id int, z int"))
    with pytest.raises(ValueError, match="not unique"):
        lookup.align_on_id(a, a)


def test_frequency_counts_missing_as_a_value(spark):
    train = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    test = spark.createDataFrame([(3, None), (4, "b")], "id int, k string")
    tr, te = encoders.frequency_encode(train, test, ["k"])
    assert by_id(tr, "freq_k") == {1: 1, 2: 2} and by_id(te, "freq_k") == {3: 2, 4: 1}


def test_running_totals_match_brute_force(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("ab"), rng.randint(0, 500)) for _ in range(400)})
    rows = [(g, v, rng.randint(1, 9)) for g, v in rows]
    df = spark.createDataFrame(rows, "g string, v int, n long").repartition(5)
    seen, want = defaultdict(int), {}
    for g, v, n in rows:
        want[g, v] = seen[g]
        seen[g] += n
    got = {(r["g"], r["v"]): r["n_before"] for r in ordering.running_totals(df, ["v"], ["n"], by=["g"]).collect()}
    assert got == want


def test_running_totals_over_several_range_partitions(spark):
    # a group that spans partitions, with coalescing switched off
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("g"))
        rows = ordering.running_totals(df, ["v"], ["n"], by=["g"]).collect()
        assert all(r["n_before"] == r["v"] for r in rows) and len(rows) == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(1, "g", 5.0), (2, "g", 5.0), (3, "g", 9.0), (4, "h", 1.0)], "id int, k string, v double")
    got = by_id(ordering.groupby_then_rank(df, "v", "k"), "groupby_then_rank_v_by_k")
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0}


def test_auc_with_ties_and_without_a_class(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, 3.0), (0, 1.0)], "label int, s double")
    assert metrics.auc(df, "label", "s").first()["auc"] == 0.875
    assert metrics.auc(df.filter("label = 1"), "label", "s").first()["auc"] is None


def test_duplicates_with_missing_values(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", 1), (4, None, None)], "id int, a string, b int")
    marked = duplicates.duplicate_rows(df, ["a", "b"])
    assert by_id(marked, "is_duplicate") == {1: True, 2: True, 3: False, 4: False}
    numbers = by_id(duplicates.duplicate_group_number(df, ["a", "b"]), "unique_no")
    assert numbers[1] == numbers[2] == 5 and numbers[3] < 5 and numbers[4] < 5


def test_stratified_folds_split_every_class_evenly(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("c"))
    rows = folds.kfold_stratified(df, "c").groupBy("c").pivot("fold").count().collect()
    for r in rows:
        sizes = [r[str(k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_are_near_equal_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    sizes = Counter(r["fold"] for r in folds.kfold(df).collect())
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) < 200
    assert by_id(folds.kfold(df), "fold") == by_id(folds.kfold(df.repartition(3)), "fold")


def test_seven_columns_have_127_combinations():
    assert len(external.combos(list("abcdefg"))) == 127


def test_external_lookup_matches_missing_keys(spark):
    ext = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, y double")
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    name = external.feature_name(["k"], "mean")
    assert by_id(external.map_external_agg(ext, ["k"], "y", "mean", df)[0], name) == {1: 2.0, 2: 5.0, 3: None}
    assert by_id(external.map_external_agg(ext, ["k"], "y", "mean", df, fill=True)[0], name) == {1: 2.0, 2: 5.0, 3: 3.0}


def test_external_by_combo_keeps_missing_keys_apart_from_unused_ones(spark):
    ext = spark.createDataFrame([("a", None, 1.0), (None, None, 3.0)], "k string, j string, y double")
    got = {(r["combo"], r["k"], r["j"]): r["value"] for r in external.external_by_combo(ext, ["k", "j"], "y").collect()}
    assert got == {("k", "a", None): 1.0, ("k", None, None): 3.0, ("j", None, None): 2.0, ("k_j", "a", None): 1.0,
                   ("k_j", None, None): 3.0}


def test_drop_correlated_keeps_the_first(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * -3.0).alias("b"), (F.col("id") % 7).cast("double").alias("c"),
                                F.lit(1.0).alias("d"))
    got = {r["column_name"]: r["dropped"] for r in metrics.drop_correlated(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_external_rows_get_ids_of_their_own(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, x double")
    rows = sets.append_external(df, df).collect()
    assert sorted((r["id"], r["is_original"]) for r in rows) == [("1", 0), ("ext:1", 1)]
    tr, val, te = sets.append_external_per_fold(df, df, df, df)
    assert [d.filter("is_original = 1").count() for d in (tr, val, te)] == [1, 0, 0]


def test_lattice_equals_grouping_each_combination(spark, monkeypatch):
    """NULL keys and targets, repeated and single target values; every round small, and waiting for smaller sources."""
    rng = random.Random(8)
    rows = [(rng.choice(["u", "v", None]), rng.randrange(4), rng.choice([None, 1.5, 2.5]), rng.randrange(3), rng.choice([None, 1.0, 2.0, rng.random()]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b int, c double, d int, y double")
    brute = {"mean": lambda v: sum(v) / len(v) if v else None, "max": lambda v: max(v, default=None), "min": lambda v: min(v, default=None),
             "nunique": lambda v: len(set(v))}
    for little, agg in itertools.product((0, 1 << 16), brute):
        monkeypatch.setattr(lattice, "LITTLE", little)
        for sizes in (None, [2, 3]):
            found = external.external_by_combo(df, list("abcd"), "y", agg, sizes).collect()
            want = {}
            for combo in external.combos("abcd", sizes):
                groups = {}
                for row in rows:
                    key = tuple(row["abcd".index(c)] if c in combo else None for c in "abcd")
                    groups.setdefault(key, []).extend([] if row[4] is None else [row[4]])
                want |= {("_".join(combo), *key): brute[agg](values) for key, values in groups.items()}
            got = {tuple(r)[:5]: r["value"] for r in found}
            assert len(got) == len(found) and got.keys() == want.keys()
            assert all(got[k] == pytest.approx(want[k]) for k in want)
    found = external.external_aggregates(df, list("abcd"), "y", "max")
    assert found.of(["a", "d"]).count() == found.lattice.rows[found.lattice.id_of(["a", "d"])] == len({(r[0], r[3]) for r in rows})
    empty = external.external_by_combo(df.limit(0), list("abcd"), "y", "mean")
    assert empty.count() == 0


def test_lattice_plan_expands_little(spark):
    df = spark.range(1000).selectExpr("id % 7 a", "id % 5 b", "id % 3 c", "id y")
    text = external.external_by_combo(df, list("abc"), "y", "max")._jdf.queryExecution().toString()
    assert "Expand" not in text and "Exchange" not in text


def test_shares_of_lookups_left_empty(spark):
    outer = spark.createDataFrame([("x", 1, 2.0), ("y", 2, 4.0), (None, 1, 6.0)], "a string, b int, y double")
    rows = spark.createDataFrame([("x", 1), ("x", 3), (None, 1), ("z", 2)], "a string, b int")
    found = external.external_aggregates(outer, ["a", "b"], "y", "mean")
    quotas = {r["combo"]: (r["rows"], r["nan_quota"], r["mean"]) for r in external.map_quotas(found, rows, rows).collect()}
    assert quotas == {"a": (8, 0.25, pytest.approx(10 / 3)), "b": (8, 0.25, 4.0), "a_b": (8, 0.5, 4.0)}


@pytest.mark.parametrize("options", [{}, {"smooth": 3.0}, {"smooth": 2.0, "fillna": True}, {"fillna": True}])
def test_many_encodings_equal_single_ones(spark, options):
    rng = random.Random(2)
    data = [(i, rng.choice(["u", "v", None]), rng.randrange(5), rng.choice([None, 1.5]), i % 4, rng.choice([None, *map(float, range(9))])) for i in range(300)]
    train = spark.createDataFrame(data, "id int, a string, b int, c double, fold int, y double")
    test = spark.createDataFrame([(1000 + i, rng.choice(["u", "w", None]), rng.randrange(7), None) for i in range(40)], "id int, a string, b int, c double")
    combos = [["a"], ["b", "a"], ["c"], ["a", "c", "b"]]
    many = encoders.target_encode_many(train, test, "y", combos, n_splits=4, **options)
    nested = encoders.target_encode_nested_many(train, test, "y", combos, 4, 3, **options)
    for cols in combos:
        name = encoders.te_name(cols)
        single = encoders.target_encode_kfold(train, test, "y", cols, n_splits=4, **options)
        for one, all_ in zip(single, many):
            assert by_id(one, name) == pytest.approx(by_id(all_, name))
        key = lambda df: {(r["id"], r["outer_fold"], r["part"]): r[name] for r in df.collect()}  # noqa: E731, B023
        assert key(encoders.target_encode_nested(train, test, "y", cols, 4, 3, **options)) == pytest.approx(key(nested))


@pytest.mark.parametrize("few, accuracy, most", [(100_000, 10_000, 10**6), (50, 100, 10**6), (50, 100, 5), (0, 20, 10**6)])
def test_quantiles_between_brackets(spark, monkeypatch, few, accuracy, most):
    """Small columns whole, brackets between sketched quantiles, and the way for too many values: the same exact rows."""
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "ACCURACY", accuracy)
    monkeypatch.setattr(ordering, "MOST", most)
    rng = np.random.default_rng(9)
    table = {"a": rng.normal(0, 1, 3000), "b c": rng.integers(0, 7, 3000).astype(float), "c": np.where(rng.random(3000) < 0.4, np.nan, rng.exponential(1, 3000)),
             "d": np.full(3000, np.nan), "e": np.where(rng.random(3000) < 0.9, 5.0, rng.normal(0, 100, 3000)), "f": np.full(3000, 2.0)}
    rows = [tuple(float(v[i]) if not (np.isnan(v[i]) and i % 2) else None for v in table.values()) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in table)).repartition(7)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.51, 0.9, 0.999, 1.0]
    got = ordering.quantile_row(df, list(table), shares).first()
    for c, v in table.items():
        v = v[~np.isnan(v)]
        assert got[c] == ([None] * 8 if not len(v) else pytest.approx(list(np.quantile(v, shares)), rel=1e-12))
    few_rows = df.limit(3)
    assert ordering.quantile_row(few_rows, ["f"], [0.5]).first()["f"] == [2.0]
    assert ordering.quantile_row(df.limit(0), ["f"], [0.5]).first()["f"] == [None]
