from __future__ import annotations

import zlib

import numpy as np
import pytest

from foldsmith.llm import queries
from foldsmith.llm.classifier import FEATURES, document_statistics, fit, quality_scores, statistics, training_rows
from tests.llm.tables import frame, rows


def test_trees_as_arrays_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) & (x[:, 2] < 1)).astype(float)
    forest = fit(x, y, trees=60, depth=3)
    margin = forest.margin(x)
    for i in range(100):
        total = forest.base
        for f, c, v in zip(forest.feature, forest.cut, forest.value):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if x[i, f[node]] > c[node] else 1)
            total += v[node]
        assert abs(total - margin[i]) < 1e-9
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.97


def best_split(x, grad, hess, ridge, least_rows):
    """Gain, feature and threshold of every split of a node, by trying each value."""
    found, score = (1e-6, None, None), lambda g, h: g * g / (h + ridge)
    for f in range(x.shape[1]):
        for cut in sorted(set(x[:, f]))[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) >= least_rows:
                gain = score(grad[left].sum(), hess[left].sum()) + score(grad[~left].sum(), hess[~left].sum()) - score(grad.sum(), hess.sum())
                if gain > found[0] + 1e-9:
                    found = (gain, f, cut)
    return found


def test_splits_against_exhaustive_search():
    """Few enough values that every one is a bin: each node's split must be the best of all, and each leaf its Newton step."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(300, 4)).astype(float)
    y = ((x[:, 0] + 2 * (x[:, 2] > 6) + rng.normal(size=300)) > 7).astype(float)
    forest = fit(x, y, trees=5, depth=3, rate=0.3, ridge=1.0, least_rows=10)
    margin = np.full(len(y), forest.base)
    for t in range(5):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, rows_of = p - y, p * (1 - p), {0: np.arange(len(y))}
        for node in range(7):
            mine = rows_of[node]
            gain, f, cut = best_split(x[mine], grad[mine], hess[mine], 1.0, 10) if len(mine) else (0, None, None)
            if f is None:
                assert np.isinf(forest.cut[t, node]) or not len(mine)
                left = np.ones(len(mine), bool)
            else:
                left = x[mine, forest.feature[t, node]] <= forest.cut[t, node]
                one = best_split(x[mine][:, [forest.feature[t, node]]], grad[mine], hess[mine], 1.0, 10)
                assert abs(one[0] - gain) < 1e-6
                assert np.array_equal(left, x[mine, forest.feature[t, node]] <= one[2])
            rows_of[2 * node + 1], rows_of[2 * node + 2] = mine[left], mine[~left]
        for node in range(7, 15):
            mine = rows_of[node]
            assert abs(forest.value[t, node] + 0.3 * grad[mine].sum() / (hess[mine].sum() + 1)) < 1e-9
            margin[mine] += forest.value[t, node]
    assert np.allclose(forest.margin(x), margin)


def test_repeated_ids_are_one_row_each(spark):
    """What reaches the driver is bounded by ids, not by rows."""
    docs = spark.createDataFrame([(i % 4, f"word{i} " * (i + 1)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] * 3, "doc_id long, quality int")
    stats = document_statistics(docs)
    x, y = training_rows(stats, labels, 20_000)
    learned = [i for i in range(4) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(x) == len(learned) and y.tolist() == [i % 2 for i in learned]
    assert [tuple(r) for r in x] == [min(statistics(r["text"]) for r in docs.collect() if r["doc_id"] == i) for i in learned]
    assert len(training_rows(stats, labels, 2)[0]) == 2
    assert quality_scores(docs, labels).count() == 200


def test_degenerate_labels():
    none = fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert fit(np.zeros((8, 3)), np.ones(8)).score(np.zeros((1, 3)))[0] == pytest.approx(0.9)
    same = fit(np.zeros((40, 2)), np.array([0, 1] * 20))
    assert abs(same.score(np.zeros((1, 2)))[0] - 0.5) < 1e-6


def test_statistics_are_finite():
    for r in rows():
        found = statistics(r[1])
        assert len(found) == len(FEATURES) and np.isfinite(found).all()


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = queries.quality_classifier(spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = found.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in kept) >= 0.9 * len(kept)


def test_held_out_labels_do_not_count(spark):
    docs = frame(spark)
    labels = [(i, i % 2) for i in range(50)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    one, two = (sorted(map(tuple, quality_scores(docs, spark.createDataFrame([*rows_, (None, 1), (3, None)], "doc_id long, quality int")).collect()), key=str)
                for rows_ in (labels, flipped))
    assert one == two and len(one) == docs.count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(frame(spark), none).collect()} == {0.5}
    assert quality_scores(frame(spark, []), none).count() == 0
