"""Aggregations, encodings and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsmith import creators
from foldsmith.functions.exact import mean
from foldsmith.operators import duplicates, encoders, external, metrics
from foldsmith.operators.sets import adversarial_frame
from foldsmith.plans.registry import query
from foldsmith.plans.standin import (CENTS, FEATURES, MODELS, ext, model_frames, models_sql, predictions, sql,
                                     sql_mean, sql_nested, sql_te, test, train)
from foldsmith.sources import predictions as store


def _as_double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# -- the flagship: encode, predict, clip, score ----------------------------------------------------

@query("flagship", sql(
    "SELECT coalesce(status, 'all') AS segment, round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) AS score, count(*) AS rows FROM ("
    "SELECT t.status, t.y, CASE WHEN p < 1 THEN 1.0::DOUBLE WHEN p > (SELECT max(y) FROM train) THEN (SELECT max(y) FROM train) ELSE p END AS p "
    "FROM train t JOIN (SELECT id, coalesce(te, (SELECT CAST(CAST(" + sql_mean() + " AS FLOAT) AS DOUBLE) FROM train)) AS p FROM e_oof) USING (id)) "
    "GROUP BY ROLLUP (status)", sql_te("e", ["status", "qty"])))
def flagship(spark, sf):
    tr = train(spark, sf).select("id", "fold", "status", "qty", "y")
    encoded = encoders.TargetEncoder(["status", "qty"], scale=CENTS).fit(tr, "y").transform_train(tr)
    stats = tr.agg(F.struct(F.max("y").alias("top"), mean(F.col("y"), CENTS).cast("float").cast("double").alias("mean"))).scalar()
    from foldsmith.functions.scalar import bounded
    pred = bounded(F.coalesce(F.col("te_mean_status_qty").cast("double"), stats["mean"]), 1.0, stats["top"])
    scores = metrics.segment_scores(encoded.withColumn("pred", pred), "status", "y", "pred")
    return scores.withColumn("score", F.round("score", 6))


# -- external aggregates over all combinations -----------------------------------------------------

def _combo_sql(value):
    name = "concat_ws('_', " + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in FEATURES) + ")"
    return sql(f"SELECT * FROM (SELECT {name} AS combo, {', '.join(FEATURES)}, {value} AS value FROM ext "
               f"GROUP BY CUBE ({', '.join(FEATURES)})) WHERE combo <> ''")


def _by_combo(agg):
    return lambda spark, sf: external.external_by_combo(ext(spark, sf), FEATURES, "y", agg,
                                                        scale=CENTS if agg == "mean" else None)


query("external_mean_by_combo", _combo_sql(sql_mean()))(_by_combo("mean"))
query("external_max_by_combo", _combo_sql("max(y)"))(_by_combo("max"))
query("external_min_by_combo", _combo_sql("min(y)"))(_by_combo("min"))
query("external_nunique_by_combo", _combo_sql("count(DISTINCT y)"))(_by_combo("nunique"))


def _quota_sql():
    """Every one of the 127 lookups done row by row."""
    parts = []
    for keys in external.combos(FEATURES):
        same = " AND ".join(f"e.{c} = t.{c}" for c in keys)
        parts.append(f"SELECT '{'_'.join(keys)}' AS combo, count(*) AS rows, avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS nan_quota, avg(v) AS mean FROM rows_ t "
                     f"LEFT JOIN (SELECT {', '.join(keys)}, max(y) AS v FROM ext GROUP BY {', '.join(keys)}) e ON {same}")
    return "SELECT combo, rows, round(nan_quota, 9) AS nan_quota, round(mean, 4) AS mean FROM (" + " UNION ALL ".join(parts) + ")"


@query("external_map_quotas", sql(_quota_sql(), "rows_ AS (SELECT * FROM f WHERE split <> 'ext')"))
def external_map_quotas(spark, sf):
    """For each of the 127 lookups: rows of train and test, the share left empty, and the mean of what is found."""
    found = external.external_aggregates(ext(spark, sf), FEATURES, "y", "max")
    quotas = external.map_quotas(found, train(spark, sf), test(spark, sf))
    return quotas.select("combo", "rows", F.round("nan_quota", 9).alias("nan_quota"), F.round("mean", 4).alias("mean"))


@query("nan_quota", sql(
    "SELECT avg(CASE WHEN v IS NULL THEN 1 ELSE 0 END) AS nan_quota, count(*) AS rows FROM f LEFT JOIN "
    "(SELECT qty, disc, tax, mon, max(y) AS v FROM ext GROUP BY ALL) USING (qty, disc, tax, mon) WHERE split <> 'ext'"))
def nan_quota(spark, sf):
    keys = ["qty", "disc", "tax", "mon"]
    tr, te = external.map_external_agg(ext(spark, sf), keys, "y", "max", train(spark, sf), test(spark, sf))
    return external.nan_quota(tr, te, external.feature_name(keys, "max"))


@query("column_nunique", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS nunique FROM train" for c in [*FEATURES, "y"])))
def column_nunique(spark, sf):
    return external.column_nunique(train(spark, sf), [*FEATURES, "y"])


@query("useful_combinations", sql(
    "SELECT concat_ws('_', " + ", ".join(f"CASE WHEN b_{c} THEN '{c}' END" for c in FEATURES) + ") AS combo, CAST("
    + " + ".join(f"b_{c}::INT" for c in FEATURES) + " AS INTEGER) AS size, "
    + " * ".join(f"CASE WHEN b_{c} THEN n_{c} ELSE 1 END" for c in FEATURES) + " AS product FROM "
    + ", ".join(f"(SELECT unnest([true, false]) AS b_{c})" for c in FEATURES) + ", "
    + "(SELECT " + ", ".join(f"count(DISTINCT {c})::DOUBLE AS n_{c}" for c in FEATURES) + " FROM train) "
    + "WHERE size > 0 AND product BETWEEN 5 AND 600000"))
def useful_combinations(spark, sf):
    return external.useful_combinations(train(spark, sf), FEATURES)


# -- encodings -------------------------------------------------------------------------------------

@query("target_encode_kfold", sql("SELECT id, te AS te_mean_status_qty_disc FROM e_oof UNION ALL SELECT id, te FROM e_test",
                                  sql_te("e", ["status", "qty", "disc"])))
def target_encode_kfold(spark, sf):
    cols = ["status", "qty", "disc"]
    tr, te = encoders.target_encode_kfold(train(spark, sf), test(spark, sf), "y", cols, scale=CENTS)
    name = encoders.te_name(cols)
    return _as_double(tr.select("id", name).unionByName(te.select("id", name)), name)


@query("target_encode_nested", sql("SELECT id, outer_fold, part, te AS te_mean_qty_disc FROM e", sql_nested("e", ["qty", "disc"])))
def target_encode_nested(spark, sf):
    out = encoders.target_encode_nested(train(spark, sf), test(spark, sf), "y", ["qty", "disc"], scale=CENTS)
    return _as_double(out, "te_mean_qty_disc")


MANY = [["qty"], ["qty", "disc"], ["status", "qty"], ["status", "qty", "disc"], ["mon", "tax"], ["flag", "line", "mon"]]


@query("target_encode_many", sql(
    "SELECT t.id, " + ", ".join(f"e{i}.te AS {encoders.te_name(c)}" for i, c in enumerate(MANY)) + " FROM f t "
    + " ".join(f"JOIN (SELECT * FROM m{i}_oof UNION ALL SELECT * FROM m{i}_test) e{i} ON e{i}.id = t.id" for i in range(len(MANY))) + " WHERE t.split <> 'ext'",
    *[sql_te(f"m{i}", c) for i, c in enumerate(MANY)]))
def target_encode_many(spark, sf):
    """Six combinations from one roll-up of the folds' sums."""
    tr, te = encoders.target_encode_many(train(spark, sf), test(spark, sf), "y", MANY, scale=CENTS)
    names = [encoders.te_name(c) for c in MANY]
    return _as_double(tr.select("id", *names).unionByName(te.select("id", *names)), *names)


NESTED = [["qty"], ["qty", "disc"], ["status", "mon"]]


@query("target_encode_nested_many", sql(
    "SELECT n0.id, n0.outer_fold, n0.part, " + ", ".join(f"n{i}.te AS {encoders.te_name(c)}" for i, c in enumerate(NESTED)) + " FROM n0 "
    + " ".join(f"JOIN n{i} ON n{i}.id = n0.id AND n{i}.outer_fold = n0.outer_fold AND n{i}.part = n0.part" for i in range(1, len(NESTED))),
    *[sql_nested(f"n{i}", c) for i, c in enumerate(NESTED)]))
def target_encode_nested_many(spark, sf):
    out = encoders.target_encode_nested_many(train(spark, sf), test(spark, sf), "y", NESTED, scale=CENTS)
    return _as_double(out, *[encoders.te_name(c) for c in NESTED])


@query("pair_candidates", sql(
    "SELECT 'arith' AS kind, a.c AS a, b.c AS b FROM d a JOIN d b ON a.place < b.place WHERE a.number AND b.number AND a.n > 1 AND b.n > 1 "
    "UNION ALL SELECT 'combine', a.c, b.c FROM d a JOIN d b ON a.place < b.place WHERE a.n > 1 AND b.n > 1 AND (NOT a.number OR a.n <= 12) AND (NOT b.number OR b.n <= 12) "
    "UNION ALL SELECT 'group', a.c, b.c FROM d a JOIN d b ON a.c <> b.c WHERE a.number AND a.n > 1 AND b.n > 1 AND (NOT b.number OR b.n <= 12)",
    "d AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS c, {str(c not in ('status', 'flag')).upper()} AS number, count(DISTINCT {c}) AS n FROM train"
                                  for i, c in enumerate(FEATURES)) + ")"))
def pair_candidates(spark, sf):
    """Column pairs of each kind, enumerated from types and distinct counts."""
    found = creators.candidate_pairs(train(spark, sf), FEATURES, max_nunique_if_numeric=12)
    return spark.createDataFrame([(kind, a, b) for kind, pairs in found.items() for a, b in pairs], "kind string, a string, b string")


SMOOTH_SQL = """SELECT id, CAST(CAST(coalesce(te, g) AS FLOAT) AS DOUBLE) AS te_mean_qty_disc_tax FROM (
 SELECT t.id, (coalesce(a.s - coalesce(k.s, 0), 0)::DOUBLE / 100.0::DOUBLE + 10.0::DOUBLE * g.g) / nullif((a.n - coalesce(k.n, 0))::DOUBLE + 10.0::DOUBLE, 10.0::DOUBLE) AS te, g.g
 FROM train t JOIN ea a USING (qty, disc, tax) JOIN ek k USING (qty, disc, tax, fold) JOIN gf g USING (fold)
 UNION ALL
 SELECT t.id, (a.s::DOUBLE / 100.0::DOUBLE + 10.0::DOUBLE * w.g) / (a.n::DOUBLE + 10.0::DOUBLE), w.g
 FROM test t LEFT JOIN ea a USING (qty, disc, tax), (SELECT sum(s)::DOUBLE / (100.0::DOUBLE * sum(n)) AS g FROM ek) w)"""


@query("target_encode_smooth", sql(
    SMOOTH_SQL,
    "ek AS (SELECT qty, disc, tax, fold, sum(CAST(round(y * 100) AS BIGINT)) AS s, count(*) AS n FROM train GROUP BY ALL)",
    "ea AS (SELECT qty, disc, tax, sum(s) AS s, sum(n) AS n FROM ek GROUP BY ALL)",
    "gf AS (SELECT r.fold, (sum(k.s) FILTER (WHERE k.fold <> r.fold))::DOUBLE / (100.0::DOUBLE * sum(k.n) FILTER (WHERE k.fold <> r.fold)) AS g "
    "FROM ek k, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r GROUP BY r.fold)"))
def target_encode_smooth(spark, sf):
    cols = ["qty", "disc", "tax"]
    tr, te = encoders.target_encode_kfold(train(spark, sf), test(spark, sf), "y", cols, scale=CENTS, smooth=10, fillna=True)
    name = encoders.te_name(cols)
    return _as_double(tr.select("id", name).unionByName(te.select("id", name)), name)


ENCODED = ["status", "flag", "qty", "disc", "mon"]


@query("frequency_encode", sql(
    "SELECT id, split, " + ", ".join(f"(SELECT n FROM c_{c} k WHERE k.{c} = f.{c}) AS freq_{c}" for c in ENCODED)
    + " FROM f WHERE split <> 'ext'",
    *[f"c_{c} AS (SELECT {c}, count(*) AS n FROM f WHERE split <> 'ext' GROUP BY {c})" for c in ENCODED]))
def frequency_encode(spark, sf):
    cols = ["id", "split", *ENCODED]
    tr, te = encoders.frequency_encode(train(spark, sf).select(*cols), test(spark, sf).select(*cols), ENCODED)
    return tr.unionByName(te).select("id", "split", *[f"freq_{c}" for c in ENCODED])


@query("frequency_encode_external", sql(
    "SELECT id, yr, (SELECT n FROM c_yr k WHERE k.yr = f.yr) AS freq_yr, (SELECT n FROM c_qty k WHERE k.qty = f.qty) AS freq_qty "
    "FROM f WHERE split = 'train'", "c_yr AS (SELECT yr, count(*) AS n FROM ext GROUP BY yr)",
    "c_qty AS (SELECT qty, count(*) AS n FROM ext GROUP BY qty)"))
def frequency_encode_external(spark, sf):
    # no external row has a train year, so freq_yr is NULL throughout
    out = encoders.frequency_encode_external(ext(spark, sf), ["yr", "qty"], train(spark, sf))[0]
    return out.select("id", "yr", "freq_yr", "freq_qty")


@query("groupby_then_mean", sql(
    "SELECT id, split, m AS groupby_then_mean_y_by_mon FROM f LEFT JOIN "
    f"(SELECT mon, {sql_mean()} AS m FROM train GROUP BY mon) USING (mon) WHERE split <> 'ext'"))
def groupby_then_mean(spark, sf):
    cols = ["id", "split", "mon", "y"]
    tr, te = encoders.groupby_then_mean(train(spark, sf).select(*cols), "y", "mon", test(spark, sf).select(*cols), scale=CENTS)
    return tr.unionByName(te).select("id", "split", "groupby_then_mean_y_by_mon")


# -- correlations ----------------------------------------------------------------------------------

NUMERIC = ["line", "qty", "disc", "tax", "mon"]


@query("corr_pearson_target", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr({c}, y), 6) AS corr FROM train" for c in NUMERIC)))
def corr_pearson_target(spark, sf):
    return metrics.corr_pearson_target(train(spark, sf), NUMERIC, "y").withColumn("corr", F.round("corr", 6))


@query("corr_pearson_models", models_sql(" UNION ALL ".join(
    f"SELECT '{m}' AS model, round(corr(m_qty, {m}), 6) AS pearson FROM test_w" for m in ("m_qty_disc",))
    + " UNION ALL SELECT 'y', round(corr(m_qty, y), 6) FROM test_w"))
def corr_pearson_models(spark, sf):
    wide = model_frames(spark, sf)[1]
    return metrics.corr_pearson_models(wide, "m_qty", ["m_qty", "m_qty_disc", "y"]).withColumn("pearson", F.round("pearson", 6))


@query("corr_spearman_models", models_sql(
    "SELECT 'm_qty_disc' AS model, round(corr(a, b), 6) AS spearman FROM ("
    "SELECT rank() OVER (ORDER BY m_qty) + (count(*) OVER (PARTITION BY m_qty) - 1) / 2.0::DOUBLE AS a, "
    "rank() OVER (ORDER BY m_qty_disc) + (count(*) OVER (PARTITION BY m_qty_disc) - 1) / 2.0::DOUBLE AS b FROM test_w)"))
def corr_spearman_models(spark, sf):
    preds = predictions(spark, sf).filter("split = 'test' AND model <> 'm_mean'")
    return metrics.corr_spearman_models(preds, "m_qty", ["m_qty", "m_qty_disc"]).withColumn("spearman", F.round("spearman", 6))


CANDIDATES = {"qty": "qty", "line": "line", "double_qty": "qty * 2", "disc": "disc", "shifted_disc": "disc + 0.25", "mon": "mon"}


@query("drop_correlated", sql(
    "SELECT CAST(position AS INTEGER) AS position, column_name, round(max_corr, 6) AS max_corr, coalesce(max_corr > 0.9999999, false) AS dropped FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{b}' AS column_name, "
        + ("greatest(" + ", ".join(f"abs(corr({CANDIDATES[a]}, {CANDIDATES[b]}))" for a in list(CANDIDATES)[:i]) + ")" if i else "NULL::DOUBLE")
        + " AS max_corr" + (" FROM train" if i else "") for i, b in enumerate(CANDIDATES)) + ")"))
def drop_correlated(spark, sf):
    df = train(spark, sf).select(*[F.expr(e.replace("0.25", "0.25D")).alias(n) for n, e in CANDIDATES.items()])
    return metrics.drop_correlated(df, list(CANDIDATES)).withColumn("max_corr", F.round("max_corr", 6))


# -- scores ----------------------------------------------------------------------------------------

@query("rmsle", models_sql("SELECT " + ", ".join(
    f"round(sqrt(avg(pow(ln(1 + y) - ln(1 + {m}), 2))), 6) AS {m}" for m in MODELS) + " FROM oof_w"))
def rmsle(spark, sf):
    return model_frames(spark, sf)[0].agg(*[F.round(metrics.rmsle(F.col("y"), F.col(m)), 6).alias(m) for m in MODELS])


@query("rmse", models_sql("SELECT " + ", ".join(f"round(sqrt(avg(pow(y - {m}, 2))), 4) AS {m}" for m in MODELS) + " FROM oof_w"))
def rmse(spark, sf):
    return model_frames(spark, sf)[0].agg(*[F.round(metrics.rmse(F.col("y"), F.col(m)), 4).alias(m) for m in MODELS])


@query("segment_scores", models_sql(
    "SELECT coalesce(status, 'all') AS segment, round(sqrt(avg(pow(ln(1 + y) - ln(1 + m_qty), 2))), 6) AS score, count(*) AS rows "
    "FROM oof_w GROUP BY ROLLUP (status)"))
def segment_scores(spark, sf):
    return metrics.segment_scores(model_frames(spark, sf)[0], "status", "y", "m_qty").withColumn("score", F.round("score", 6))


def _auc_sql(c):
    return (f"SELECT '{c}' AS column_name, round((sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) AS auc, "
            "CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM ("
            f"SELECT label, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r FROM adv), "
            "(SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM adv) GROUP BY p, n")


ADV = "adv AS (SELECT *, CASE split WHEN 'train' THEN 1 ELSE 0 END AS label FROM f WHERE split <> 'ext')"
DRIFT = ["qty", "disc", "tax", "mon", "line", "y", "yr"]


@query("auc", sql(_auc_sql("qty").replace("'qty' AS column_name, ", ""), ADV))
def auc(spark, sf):
    df = adversarial_frame(train(spark, sf), test(spark, sf))
    return metrics.auc(df, "label", "qty").withColumn("auc", F.round("auc", 9))


@query("drift_by_feature", sql(" UNION ALL ".join(_auc_sql(c) for c in DRIFT), ADV))
def drift_by_feature(spark, sf):
    df = adversarial_frame(train(spark, sf), test(spark, sf))
    return metrics.drift_by_feature(df, "label", DRIFT).withColumn("auc", F.round("auc", 9))


# -- predictions -----------------------------------------------------------------------------------

@query("fold_mean_predictions", sql(
    "SELECT id, round(avg(te), 4) AS pred FROM e WHERE part = 'test' GROUP BY id", sql_nested("e", ["qty"])))
def fold_mean_predictions(spark, sf):
    nested = encoders.target_encode_nested(train(spark, sf), test(spark, sf), "y", ["qty"], scale=CENTS)
    per_fold = nested.filter("part = 'test'").select("id", "outer_fold", F.col("te_mean_qty").cast("double").alias("pred"))
    return metrics.fold_mean_predictions(per_fold).withColumn("pred", F.round("pred", 4))


@query("blend_predictions", models_sql(
    "SELECT id, round(1.2::DOUBLE * greatest(m_qty, 0) - 0.3::DOUBLE * greatest(m_qty_disc, 0) + 0.1::DOUBLE * greatest(m_mean, 0), 4) AS pred FROM test_w"))
def blend_predictions(spark, sf):
    weights = spark.createDataFrame([("m_qty", 1.2), ("m_qty_disc", -0.3), ("m_mean", 0.1)], "model string, weight double")
    preds = predictions(spark, sf).filter("split = 'test'")
    return store.blend_predictions(preds, weights).withColumn("pred", F.round("pred", 4))


@query("duplicate_rows", sql(
    "SELECT id, copies, copies > 1 AS is_duplicate FROM (SELECT id, count(*) OVER (PARTITION BY status, flag, line, qty, disc) AS copies FROM train)"))
def duplicate_rows(spark, sf):
    df = train(spark, sf).select("id", "status", "flag", "line", "qty", "disc")
    return duplicates.duplicate_rows(df, df.columns[1:]).select("id", "copies", "is_duplicate")
