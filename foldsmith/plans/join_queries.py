"""Alignment and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith.operators import encoders, external
from foldsmith.operators.lookup import align_on_id, keep_base_rows
from foldsmith.plans.registry import query
from foldsmith.plans.standin import (CENTS, MODELS, ext, frame, models_sql, predictions, sql, sql_mean, test,
                                     train)
from foldsmith.sources import predictions as store

KEYS = ["status", "qty", "disc", "tax", "mon"]


@query("align_on_id", sql("SELECT id, status, qty, qty * line AS qty_x_line, disc + tax AS rate FROM train"))
def align(spark, sf):
    tr = train(spark, sf)
    return align_on_id(tr.select("id", "status", "qty"), tr.select("id", (F.col("qty") * F.col("line")).alias("qty_x_line")),
                       tr.select("id", (F.col("disc") + F.col("tax")).alias("rate")))


def _lookup_sql(agg, name):
    return sql(f"SELECT t.id, CAST(CAST(v AS FLOAT) AS DOUBLE) AS {name} FROM f t LEFT JOIN e USING ({', '.join(KEYS)}) "
               "WHERE t.split <> 'ext'",
               f"e AS (SELECT {', '.join(KEYS)}, {agg} AS v FROM ext GROUP BY {', '.join(KEYS)})")


@query("map_external_agg", _lookup_sql(sql_mean(), external.feature_name(KEYS, "mean")))
def map_external_agg(spark, sf):
    name = external.feature_name(KEYS, "mean")
    df = frame(spark, sf, "train", "test").select("id", *KEYS)
    out = external.map_external_agg(ext(spark, sf), KEYS, "y", "mean", df, scale=CENTS)[0]
    return out.select("id", F.col(name).cast("double").alias(name))


@query("map_external_filled", sql(
    "SELECT t.id, CAST(CAST(coalesce(v, (SELECT " + sql_mean() + " FROM ext)) AS FLOAT) AS DOUBLE) AS v FROM f t "
    "LEFT JOIN e USING (qty, disc, tax, line) WHERE t.split <> 'ext'",
    f"e AS (SELECT qty, disc, tax, line, {sql_mean()} AS v FROM ext GROUP BY qty, disc, tax, line)"))
def map_external_filled(spark, sf):
    keys = ["qty", "disc", "tax", "line"]
    df = frame(spark, sf, "train", "test").select("id", *keys)
    out = external.map_external_agg(ext(spark, sf), keys, "y", "mean", df, scale=CENTS, fill=True)[0]
    return out.select("id", F.col(external.feature_name(keys, "mean")).cast("double").alias("v"))


@query("map_external_many", sql(
    "SELECT t.id, CAST(CAST(a.mx AS FLOAT) AS DOUBLE) AS map_orig_targets_max_qty_disc, "
    "CAST(CAST(a.mn AS FLOAT) AS DOUBLE) AS map_orig_targets_min_qty_disc, "
    "CAST(CAST(b.u AS FLOAT) AS DOUBLE) AS map_orig_targets_nunique_status_mon FROM f t LEFT JOIN a USING (qty, disc) "
    "LEFT JOIN b USING (status, mon) WHERE t.split <> 'ext'",
    "a AS (SELECT qty, disc, max(y) AS mx, min(y) AS mn FROM ext GROUP BY qty, disc)",
    "b AS (SELECT status, mon, count(DISTINCT y) AS u FROM ext GROUP BY status, mon)"))
def map_external_many(spark, sf):
    df = frame(spark, sf, "train", "test").select("id", "status", "qty", "disc", "mon")
    wanted = [(["qty", "disc"], "max"), (["qty", "disc"], "min"), (["status", "mon"], "nunique")]
    out = external.map_external_many(ext(spark, sf), wanted, "y", df)[0]
    names = [external.feature_name(k, a) for k, a in wanted]
    return out.select("id", *[F.col(n).cast("double").alias(n) for n in names])


@query("align_models", models_sql("SELECT id, m_mean, m_qty, m_qty_disc FROM oof_w"))
def align_models(spark, sf):
    return store.align_models(predictions(spark, sf).filter("split = 'oof'"), MODELS)


@query("keep_base_rows", sql(f"SELECT id, {sql_mean('sum(CAST(round(y * 100) AS BIGINT)) OVER (PARTITION BY qty)', 'count(*) OVER (PARTITION BY qty)')} AS pred "
                             "FROM f WHERE split <> 'test' QUALIFY split = 'train'"))
def keep_base(spark, sf):
    both = frame(spark, sf, "ext", "train")
    scored = encoders.groupby_then_mean(both, "y", "qty", scale=CENTS)[0]
    return keep_base_rows(scored.select("id", F.col("groupby_then_mean_y_by_qty").alias("pred")), train(spark, sf))


@query("id_mismatch_report", models_sql(
    "SELECT model, (SELECT count(*) FROM test_w) - count(*) FILTER (WHERE id IN (SELECT id FROM test_w)) AS missing, "
    "count(*) FILTER (WHERE id NOT IN (SELECT id FROM test_w)) AS extra FROM part GROUP BY model",
    "part AS (SELECT model, id FROM preds WHERE split = 'test' AND (model <> 'm_qty' OR id IN (SELECT id FROM test WHERE mon <> 3)) "
    "UNION ALL SELECT 'm_qty_disc', id FROM train WHERE mon = 5)"))
def id_mismatch_report(spark, sf):
    te = test(spark, sf)
    tst = predictions(spark, sf).filter("split = 'test'").select("model", "id")
    short = tst.filter("model = 'm_qty'").join(te.filter("mon <> 3").select("id"), "id", "left_semi").select("model", "id")
    beyond = train(spark, sf).filter("mon = 5").select(F.lit("m_qty_disc").alias("model"), "id")
    rows = tst.filter("model <> 'm_qty'").unionByName(short).unionByName(beyond)
    return store.id_mismatch_report(rows, "m_mean", MODELS)


@query("models_not_used", models_sql(
    "SELECT DISTINCT model FROM preds WHERE model NOT IN (SELECT * FROM (VALUES ('m_qty'), ('m_qty_disc')))"))
def models_not_used(spark, sf):
    weights = spark.createDataFrame([("m_qty", 0.7), ("m_qty_disc", 0.3), ("m_mean", 0.0)], "model string, weight double")
    return store.models_not_used(predictions(spark, sf), weights)
