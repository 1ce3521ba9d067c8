"""Stacking of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.operators import encoders, sets
from foldsmith.plans.registry import query
from foldsmith.plans.standin import CENTS, ext, sql, sql_mean, test, train

COLS = ["id", "status", "qty", "disc", "y"]


@query("union_train_test", sql("SELECT id, split, status, qty FROM f WHERE split <> 'ext'"))
def union_train_test(spark, sf):
    cols = ["id", "split", "status", "qty"]
    return sets.union_train_test(train(spark, sf).select(*cols), test(spark, sf).select(*cols))


@query("append_external", sql(
    "SELECT CASE split WHEN 'ext' THEN 'ext:' || id ELSE id END AS id, status, qty, disc, y, CAST(split = 'ext' AS INTEGER) AS is_original "
    "FROM f WHERE split <> 'test'"))
def append_external(spark, sf):
    return sets.append_external(train(spark, sf).select(*COLS), ext(spark, sf).select(*COLS))


@query("append_external_per_fold", sql(
    "SELECT CAST(k AS INTEGER) AS i_fold, CASE WHEN split = 'test' THEN 'test' WHEN split = 'ext' OR fold <> k THEN 'train' ELSE 'val' END AS part, "
    "CAST(split = 'ext' AS INTEGER) AS is_original, count(*) AS rows, sum(CAST(round(y * 100) AS BIGINT))::BIGINT AS y_cents, count(DISTINCT id) AS ids "
    "FROM f, range(5) r(k) GROUP BY ALL"))
def append_external_per_fold(spark, sf):
    tr, te, ex = train(spark, sf), test(spark, sf), ext(spark, sf)
    out = []
    for k in range(5):
        parts = sets.append_external_per_fold(tr.filter(F.col("fold") != k).select(*COLS), tr.filter(F.col("fold") == k).select(*COLS),
                                              te.select(*COLS), ex.select(*COLS))
        out += [p.withColumns({"i_fold": F.lit(k), "part": F.lit(name)}) for p, name in zip(parts, ("train", "val", "test"))]
    return sets.concat_segments(*out).groupBy("i_fold", "part", "is_original").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.round(F.col("y") * 100).cast("long")).alias("y_cents"),
        F.count_distinct("id").alias("ids"))


@query("concat_segments", sql(
    f"SELECT id, m AS pred FROM train JOIN (SELECT status, qty, {sql_mean()} AS m FROM train GROUP BY status, qty) USING (status, qty)"))
def concat_segments(spark, sf):
    tr = train(spark, sf).select("id", "status", "qty", "y")
    parts = []
    for value in ("F", "O"):
        segment = tr.filter(F.col("status") == value)
        scored = encoders.groupby_then_mean(segment, "y", "qty", scale=CENTS)[0]
        parts.append(scored.select("id", F.col("groupby_then_mean_y_by_qty").alias("pred")))
    return sets.concat_segments(*parts)


@query("adversarial_frame", sql("SELECT id, qty, yr, CAST(split = 'train' AS INTEGER) AS label FROM f WHERE split <> 'ext'"))
def adversarial_frame(spark, sf):
    cols = ["id", "qty", "yr"]
    return sets.adversarial_frame(train(spark, sf).select(*cols), test(spark, sf).select(*cols))
