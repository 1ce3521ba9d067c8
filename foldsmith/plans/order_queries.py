"""Ranks, numbering and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.models.selection import select_best_discard_worst
from foldsmith.operators import duplicates, folds
from foldsmith.operators.ordering import groupby_then_rank as rank_in_group
from foldsmith.plans.registry import query
from foldsmith.plans.standin import frame, sql, sql_hash, train

SHAPE = ["status", "flag", "line", "qty", "disc"]


@query("groupby_then_rank", sql(
    "SELECT id, (rank() OVER (PARTITION BY status ORDER BY y) + (count(*) OVER (PARTITION BY status, y) - 1) / 2.0::DOUBLE) "
    "/ count(*) OVER (PARTITION BY status) AS groupby_then_rank_y_by_status FROM train"))
def groupby_then_rank(spark, sf):
    return rank_in_group(train(spark, sf).select("id", "status", "y"), "y", "status").select("id", "groupby_then_rank_y_by_status")


NUMBERS = (f"numbered AS (SELECT id, CASE WHEN copies > 1 THEN 5 + dense_rank() OVER (PARTITION BY copies > 1 ORDER BY {', '.join(SHAPE)}) - 1 "
           f"ELSE {sql_hash(chr(39) + '42:single:' + chr(39) + ' || id')} % 5 END AS unique_no FROM "
           f"(SELECT *, count(*) OVER (PARTITION BY {', '.join(SHAPE)}) AS copies FROM train))")


@query("duplicate_group_number", sql("SELECT id, unique_no FROM numbered", NUMBERS))
def duplicate_group_number(spark, sf):
    df = train(spark, sf).select("id", *SHAPE)
    return duplicates.duplicate_group_number(df, SHAPE).select("id", "unique_no")


@query("select_best_discard_worst", sql(
    "SELECT round, feature, score, CASE WHEN b = 1 THEN 'selected' WHEN w <= 2 THEN 'discarded' ELSE 'kept' END AS decision FROM ("
    "SELECT *, row_number() OVER (PARTITION BY round ORDER BY score, feature) AS b, "
    "row_number() OVER (PARTITION BY round ORDER BY score DESC, feature DESC) AS w FROM ("
    "SELECT mon AS round, 'feature_' || line AS feature, count(DISTINCT qty)::DOUBLE AS score FROM train GROUP BY mon, line))"))
def best_and_worst(spark, sf):
    scores = train(spark, sf).groupBy(F.col("mon").alias("round"), F.concat(F.lit("feature_"), F.col("line")).alias("feature")).agg(
        F.count_distinct("qty").cast("double").alias("score"))
    return select_best_discard_worst(scores, 2)


@query("kfold", sql("SELECT id, fold FROM f"))
def kfold(spark, sf):
    return folds.kfold(frame(spark, sf).select("id"), 5, seed=42)


@query("kfold_nested", sql(
    "SELECT id, fold, CAST(o AS INTEGER) AS outer_fold, CAST(" + sql_hash("'42:' || o || ':' || id")
    + " % 4 AS INTEGER) AS inner_fold FROM train, range(5) r(o) WHERE o <> fold"))
def kfold_nested(spark, sf):
    return folds.kfold_nested(train(spark, sf).select("id", "fold"), outer=5, inner=4, seed=42)


@query("kfold_stratified", sql(
    "SELECT id, unique_no, CAST((row_number() OVER (PARTITION BY unique_no ORDER BY md5('42:' || id), id) - 1 + "
    + sql_hash("'42:class:' || unique_no") + ") % 5 AS INTEGER) AS fold FROM numbered", NUMBERS))
def kfold_stratified(spark, sf):
    df = train(spark, sf).select("id", *SHAPE)
    classed = duplicates.duplicate_group_number(df, SHAPE).select("id", "unique_no")
    return folds.kfold_stratified(classed, "unique_no", 5, seed=42)
