"""Model runs, selection and blending, on five folds and all features.

Tree runs return facts that SQL can tell too: what was predicted, and whether scores and stops agree with the rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from foldsmith.functions.scalar import sample_weight
from foldsmith.models import ensemble, linear, search, selection, trainers
from foldsmith.operators import encoders, metrics
from foldsmith.plans.registry import query
from foldsmith.plans.standin import CENTS, MODELS, model_frames, models_sql, sql, sql_nested, test, train
from foldsmith.storage import write_buckets

TREES = {"n_estimators": 10, "max_depth": 4, "learning_rate": 0.3}
FEATURES = ["status", "flag", "line", "qty", "disc", "tax", "mon"]
NUMERIC = ["line", "qty", "disc", "tax", "mon"]


def _trainer(**options):
    return trainers.CVTrainer(TREES, n_splits=5, clip_preds=(1.0, None), **options)


def _split_facts(df, split, *more):
    """What SQL can tell of predictions without fitting trees: every id once, none missing, all inside the clip."""
    return df.agg(F.lit(split).alias("split"), F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"),
                  F.count_if(F.col("pred").isNull() | F.isnan("pred")).alias("missing"), F.count_if(F.col("pred") < 1.0).alias("below"), *more)


def _facts(run):
    """Facts of a run's predictions; its score equals the one of its rows and is not far above that of the
    constant prediction (the stand-in's target hardly depends on its features)."""
    score = metrics.rmsle(F.col("y"), F.col("pred"))
    rows = _split_facts(run.oof, "oof", (F.abs(score - F.lit(run.score)) < 1e-9).alias("score_matches"),
                        (score < 1.25 * F.stddev_pop(F.log1p("y"))).alias("near_mean"))
    if run.test is None:
        return rows
    none = F.first(F.lit(None).cast("boolean"))
    return rows.unionByName(_split_facts(run.test, "test", none.alias("score_matches"), none.alias("near_mean")))


_COUNTS = "count(*) AS rows, count(DISTINCT id) AS ids, 0::BIGINT AS missing, 0::BIGINT AS below"
OOF_FACTS = f"SELECT 'oof' AS split, {_COUNTS}, TRUE AS score_matches, TRUE AS near_mean FROM train"
RUN_FACTS = f"{OOF_FACTS} UNION ALL SELECT 'test', {_COUNTS}, NULL::BOOLEAN, NULL::BOOLEAN FROM test"


@query("cv_regress_gbt", sql(RUN_FACTS))
def cv_regress_gbt(spark, sf):
    return _facts(_trainer().train_and_score(train(spark, sf), "y", FEATURES, test(spark, sf)))


# Trees on one feature of few values, deep enough to part them all, predict group means: those SQL can tell.
PARTED = {"n_estimators": 1, "max_depth": 6}
_BY_LINE = """k AS (SELECT r.fit, {keys}, sum({w} * ln(1 + y)) / sum({w}) AS m FROM train t,
  (SELECT CAST(unnest(range(-1, 5)) AS INTEGER) AS fit) r WHERE t.fold <> r.fit GROUP BY r.fit, {keys})"""
_OUT_OF_FOLD = "SELECT t.id, 'oof' AS split, round(exp(k.m) - 1, 2) AS pred FROM train t JOIN k ON k.fit = t.fold AND {same}"
_MEAN_OF_FOLDS = "SELECT t.id, 'test' AS split, round(avg(exp(k.m) - 1), 2) AS pred FROM test t JOIN k ON k.fit >= 0 AND {same} GROUP BY t.id"


def _values(run):
    rows = run.oof.select("id", F.lit("oof").alias("split"), F.round("pred", 2).alias("pred"))
    return rows if run.test is None else rows.unionByName(run.test.select("id", F.lit("test").alias("split"), F.round("pred", 2).alias("pred")))


def _line_sql(same="k.line = t.line", keys="line", w="1", split=True):
    body = _OUT_OF_FOLD.format(same=same) + (" UNION ALL " + _MEAN_OF_FOLDS.format(same=same) if split else "")
    return sql(body, _BY_LINE.format(keys=keys, w=w))


def _parted(**options):
    return trainers.CVTrainer(PARTED, n_splits=5, clip_preds=(1.0, None), **options)


@query("cv_regress_gbt_values", _line_sql())
def cv_regress_gbt_values(spark, sf):
    """Out-of-fold rows, and test rows as the mean over the folds' models, on a feature of seven values."""
    return _values(_parted().train_and_score(train(spark, sf), "y", ["line"], test(spark, sf)))


@query("weighted_fit_values", _line_sql(w="(CASE WHEN t.status = 'O' THEN 2 ELSE 1 END)", split=False))
def weighted_fit_values(spark, sf):
    tr = sample_weight(train(spark, sf), "status", {"O": 2})
    return _values(_parted(weight_col="sample_weight").train_and_score(tr, "y", ["line"]))


@query("cv_by_segment_values", _line_sql("k.line = t.line AND k.status = t.status", "line, status"))
def cv_by_segment_values(spark, sf):
    return _values(trainers.cv_by_segment(_parted(), train(spark, sf), "y", ["line"], "status", test=test(spark, sf)))


@query("refit_full_values", sql("SELECT t.id, round(exp(k.m) - 1, 2) AS pred FROM test t JOIN k ON k.fit = -1 AND k.line = t.line",
                                _BY_LINE.format(keys="line", w="1")))
def refit_full_values(spark, sf):
    return _parted().train_on_full(train(spark, sf), "y", ["line"], test(spark, sf)).select("id", F.round("pred", 2).alias("pred"))


# letters whose order says nothing of the target, and a target that two sets of them tell apart
LETTERS = {1: "q", 2: "c", 3: "x", 4: "a", 5: "m", 6: "h", 7: "t"}
HIGH = ("c", "a", "t")


def _lettered(df):
    letter = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])[F.col("line")]
    return df.withColumn("letter", letter).withColumn("z", F.when(F.col("letter").isin(*HIGH), 1000.0).otherwise(10.0) + F.col("qty"))


_CASE = "CASE line " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LETTERS.items()) + " END"
_SIDES = f"lettered AS (SELECT id, fold, qty, {_CASE} IN {HIGH} AS high FROM {{0}})"


@query("nominal_category", sql(
    """SELECT t.id, round(avg(CASE WHEN o.high THEN 1000.0::DOUBLE ELSE 10.0::DOUBLE END + o.m / o.n), 6) AS pred FROM lettered t
 JOIN (SELECT r.fold, l.high, sum(l.qty)::DOUBLE AS m, count(*) AS n FROM lettered l, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r
   WHERE l.fold <> r.fold GROUP BY r.fold, l.high) o ON o.fold = t.fold AND o.high = t.high GROUP BY t.id""", _SIDES.format("train")))
def nominal_category(spark, sf):
    """One split of an unordered category: depth 1 parts any two sets of levels, so each side's mean comes out."""
    trainer = trainers.CVTrainer({"n_estimators": 1, "max_depth": 1}, metrics.rmse, log_transform_targets=False, n_splits=5)
    return trainer.train_and_score(_lettered(train(spark, sf)), "z", ["letter"]).oof.select("id", F.round("pred", 6).alias("pred"))


# Boosted stumps on one feature of fifty values, in SQL: the state of a fold is a prediction per value, and an iteration takes the
# cut of greatest gain. Steps of 1.8 times the residual overshoot, so that the error of held-out rows turns up again.
STUMPS = {"n_estimators": 40, "max_depth": 1, "learning_rate": 0.9, "max_bin": 64}
ROUNDS, CHUNK, SHOWN = 3, 4, 16
_CELLS = [
    "fits AS (SELECT r.fold, qty, count(*) AS n, sum(ln(1 + y)) AS s FROM train t, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r "
    "WHERE t.fold <> r.fold GROUP BY r.fold, qty)",
    "held AS (SELECT fold, qty, count(*) AS n, sum(ln(1 + y)) AS s, sum(pow(ln(1 + y), 2)) AS q FROM train GROUP BY fold, qty)",
    "p0 AS (SELECT fold, qty, n, s, 0.0::DOUBLE AS p FROM fits)"]


def _stump_sql(i):
    """Iteration ``i``: sums of the residuals per value, the best cut, and the mean residual on either side."""
    scale, step = (1.0, 1.0) if i == 1 else (2.0, STUMPS["learning_rate"])
    run = "OVER (PARTITION BY fold ORDER BY qty)"
    return [f"c{i} AS (SELECT fold, qty, sum(g) {run} AS gl, sum(n) {run} AS nl, sum(g) OVER (PARTITION BY fold) AS ga, sum(n) OVER (PARTITION BY fold) AS na "
            f"FROM (SELECT fold, qty, n, {scale}::DOUBLE * (s - n * p) AS g FROM p{i - 1}))",
            f"b{i} AS (SELECT fold, arg_max(qty, gain) AS cut, arg_max(gl / nl, gain) AS lo, arg_max((ga - gl) / (na - nl), gain) AS hi FROM "
            f"(SELECT *, gl * gl / nl + (ga - gl) * (ga - gl) / (na - nl) AS gain FROM c{i} WHERE nl < na) GROUP BY fold)",
            f"p{i} AS (SELECT p.fold, p.qty, p.n, p.s, p.p + {step}::DOUBLE * CASE WHEN p.qty <= b.cut THEN b.lo ELSE b.hi END AS p FROM p{i - 1} p JOIN b{i} b USING (fold))"]


_ERRORS = " UNION ALL ".join(
    f"SELECT fold, {i} AS iteration, sqrt(sum(h.q - 2 * p.p * h.s + p.p * p.p * h.n) / sum(h.n)) AS error FROM held h JOIN p{i} p USING (fold, qty) GROUP BY fold"
    for i in range(1, SHOWN + 1))
_PATIENCE = [
    f"errors AS ({_ERRORS})",
    "best AS (SELECT fold, iteration, error, error < coalesce(min(error) OVER (PARTITION BY fold ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 1e9) AS gains FROM errors)",
    "since AS (SELECT *, iteration - max(CASE WHEN gains THEN iteration END) OVER (PARTITION BY fold ORDER BY iteration) AS waited FROM best)",
    f"ends AS (SELECT fold, coalesce(min(iteration) FILTER (waited >= {ROUNDS}), {SHOWN}) AS last FROM since GROUP BY fold)"]
_STOP_SQL = f"""SELECT s.fold, CAST(max(s.iteration) FILTER (s.gains) AS INTEGER) AS best_iteration, CAST(ceil(max(e.last) / {CHUNK}.0) * {CHUNK} AS INTEGER) AS trees_fitted,
  round(min(s.error), 9) AS error FROM since s JOIN ends e ON e.fold = s.fold AND s.iteration <= e.last GROUP BY s.fold"""


def _stumps():
    return trainers.CVTrainer(STUMPS, n_splits=5, early_stop_rounds=ROUNDS, chunk=CHUNK)


@query("early_stopping", sql(_STOP_SQL, *_CELLS, *[c for i in range(1, SHOWN + 1) for c in _stump_sql(i)], *_PATIENCE))
def early_stopping(spark, sf):
    """Per fold: the best iteration, the trees fitted until patience ran out (whole chunks), and the error there."""
    found = trainers.early_stopping(_stumps(), train(spark, sf), "y", ["qty"], ROUNDS)
    return spark.createDataFrame([(k, n, fitted, round(error, 9)) for k, n, fitted, error in found],
                                 "fold int, best_iteration int, trees_fitted int, error double")


@query("early_stopping_facts", sql("SELECT CAST(unnest(range(5)) AS INTEGER) AS fold, TRUE AS stops_at_the_best, TRUE AS oof_is_of_the_best, TRUE AS stops_in_time"))
def early_stopping_facts(spark, sf):
    """On all features: the model ends where its validation curve is lowest, out-of-fold rows come from that model, and no more than
    patience and a chunk of trees are fitted behind it."""
    trainer, tr = _trainer(early_stop_rounds=3, chunk=4), train(spark, sf)
    run = trainer.train_and_score(tr, "y", NUMERIC)
    errors = {r["fold"]: r["score"] for r in run.oof.join(tr.select("id", "fold"), "id").groupBy("fold").agg(
        metrics.rmsle(F.col("y"), F.col("pred")).alias("score")).collect()}
    found = []
    for k, (curve, n) in enumerate(zip(trainer.curves, run.best_iterations)):
        found.append((k, curve[n - 1] == min(curve[:n + 3]), abs(errors[k] - curve[n - 1]) < 1e-9, trainer.fitted[k] <= n + 3 + 4))
    return spark.createDataFrame(found, "fold int, stops_at_the_best boolean, oof_is_of_the_best boolean, stops_in_time boolean")


@query("refit_size", sql(f"SELECT CAST(greatest(1, floor(avg(best_iteration) * 1.2)) AS INTEGER) AS trees FROM ({_STOP_SQL})",
                         *_CELLS, *[c for i in range(1, SHOWN + 1) for c in _stump_sql(i)], *_PATIENCE))
def refit_size(spark, sf):
    """The refit on all rows has 1.2 times the mean best iteration of the folds."""
    trainer, tr = _stumps(), train(spark, sf)
    run = trainer.train_and_score(tr, "y", ["qty"])
    trainer.train_on_full(tr, "y", ["qty"], test(spark, sf), run.best_iterations)
    return spark.createDataFrame([(trainer.refit_trees,)], "trees int")


@query("refit_full", sql(f"SELECT 'test' AS split, {_COUNTS} FROM test"))
def refit_full(spark, sf):
    trainer, tr = _trainer(early_stop_rounds=3), train(spark, sf)
    run = trainer.train_and_score(tr, "y", NUMERIC)
    return _split_facts(trainer.train_on_full(tr, "y", NUMERIC, test(spark, sf), run.best_iterations), "test")


RIDGE_SQL = """SELECT o.id, o.y, round(exp((my - w * mx) + w * ln(1 + m_qty)) - 1, 2) AS pred FROM oof_w o JOIN (
 SELECT r.fold, avg(ln(1 + m_qty)) AS mx, avg(ln(1 + y)) AS my,
   covar_pop(ln(1 + m_qty), ln(1 + y)) * count(*) / (var_pop(ln(1 + m_qty)) * count(*) + 1.5::DOUBLE) AS w
 FROM oof_w o, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r WHERE o.fold <> r.fold GROUP BY r.fold) k USING (fold)"""


@query("cv_ridge_stack", models_sql(RIDGE_SQL))
def cv_ridge_stack(spark, sf):
    oof, tst = (df.na.fill(0.0, MODELS) for df in model_frames(spark, sf))
    out, _, _ = linear.cv_ridge_stack(oof, tst, ["m_qty"], "y", alpha=1.5)
    return out.withColumn("pred", F.round("pred", 2))


# the mean model is a constant column, so its weight is 0 and two normal equations are left
RIDGE_ALL_SQL = """SELECT id, split, greatest(1.0::DOUBLE, round(exp(k.i0 + k.w1 * r.x1 + k.w2 * r.x2) - 1, 0)) AS pred
FROM rows_w r JOIN (
 SELECT fit, (d * c - b * e) / (a * c - b * b) AS w1, (a * e - b * d) / (a * c - b * b) AS w2,
   mt - (d * c - b * e) / (a * c - b * b) * m1 - (a * e - b * d) / (a * c - b * b) * m2 AS i0 FROM (
  SELECT f.fit, var_pop(x1) * count(*) + 1.9::DOUBLE AS a, covar_pop(x1, x2) * count(*) AS b, var_pop(x2) * count(*) + 1.9::DOUBLE AS c,
    covar_pop(x1, t) * count(*) AS d, covar_pop(x2, t) * count(*) AS e, avg(t) AS mt, avg(x1) AS m1, avg(x2) AS m2
  FROM rows_w, (SELECT CAST(unnest(range(-1, 5)) AS INTEGER) AS fit) f WHERE split = 'oof' AND fit <> f.fit GROUP BY f.fit)) k
ON r.fit = k.fit"""
RIDGE_ROWS = ("rows_w AS (SELECT id, 'oof' AS split, fold AS fit, ln(1 + coalesce(m_qty, 0)) AS x1, ln(1 + coalesce(m_qty_disc, 0)) AS x2, ln(1 + y) AS t FROM oof_w "
              "UNION ALL SELECT id, 'test', -1, ln(1 + coalesce(m_qty, 0)), ln(1 + coalesce(m_qty_disc, 0)), NULL FROM test_w)")


@query("cv_ridge_stack_all", models_sql(RIDGE_ALL_SQL.replace("AND fit <> f.fit", "AND rows_w.fit <> f.fit"), RIDGE_ROWS))
def cv_ridge_stack_all(spark, sf):
    oof, tst = (df.na.fill(0.0, MODELS) for df in model_frames(spark, sf))
    out, test_out, _ = linear.cv_ridge_stack(oof, tst, MODELS, "y", alpha=1.9, clip=(1.0, None))
    return out.select("id", F.round("pred", 0).alias("pred"), F.lit("oof").alias("split")).unionByName(
        test_out.select("id", F.round("pred", 0).alias("pred"), F.lit("test").alias("split")))


@query("cv_gbt_stack", sql(RUN_FACTS))
def cv_gbt_stack(spark, sf):
    oof, tst = model_frames(spark, sf)
    tr, te = train(spark, sf), test(spark, sf)
    stacked = tr.join(oof.select("id", *MODELS), "id")
    return _facts(_trainer().train_and_score(stacked, "y", [*NUMERIC, *MODELS], te.join(tst.select("id", *MODELS), "id")))


def _with_folded(tr, te):
    """Both frames and their encodings for each outer fold, stored in buckets of the id, so that hooks bring them together without a shuffle."""
    tr, te = (write_buckets(df, "rows") for df in (tr, te))
    return tr, te, write_buckets(encoders.target_encode_nested(tr, te, "y", ["qty", "disc"], scale=CENTS), "folded", ["outer_fold", "part"], deal=False)


@query("folded_training_frame", sql(
    "SELECT t.id, e.outer_fold, e.part, t.qty, t.y, e.te AS te_mean_qty_disc FROM train t JOIN e ON e.id = t.id",
    sql_nested("e", ["qty", "disc"])))
def folded_training_frame(spark, sf):
    tr, _, folded = _with_folded(train(spark, sf).select("id", "fold", "qty", "disc", "y"), test(spark, sf).select("id", "qty", "disc"))
    hook = trainers.with_folded_features(folded, ["te_mean_qty_disc"])
    out = None
    for k in range(5):
        fit, val, _ = hook(tr.filter(F.col("fold") != k), tr.filter(F.col("fold") == k), None, k)
        for part, df in (("train", fit), ("val", val)):
            rows = df.select("id", F.lit(k).alias("outer_fold"), F.lit(part).alias("part"), "qty", "y",
                             F.col("te_mean_qty_disc").cast("double").alias("te_mean_qty_disc"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("cv_with_folded_features", sql(RUN_FACTS))
def cv_with_folded_features(spark, sf):
    tr, te, folded = _with_folded(train(spark, sf).select("id", "fold", "y", *NUMERIC), test(spark, sf).select("id", *NUMERIC))
    hook = trainers.with_folded_features(folded, ["te_mean_qty_disc"])
    return _facts(_trainer(fn_modify_fold_data=hook).train_and_score(tr, "y", [*NUMERIC, "te_mean_qty_disc"], te))


@query("cv_by_segment", sql(RUN_FACTS))
def cv_by_segment(spark, sf):
    return _facts(trainers.cv_by_segment(_trainer(), train(spark, sf), "y", NUMERIC, "status", test=test(spark, sf)))


@query("two_round_outlier_fit", sql(OOF_FACTS))
def two_round_outlier_fit(spark, sf):
    return _facts(trainers.two_round_outlier_fit(_trainer(), train(spark, sf), "y", NUMERIC)[1])


@query("weighted_fit", sql(OOF_FACTS))
def weighted_fit(spark, sf):
    tr = sample_weight(train(spark, sf), "status", {"O": 2})
    return _facts(_trainer(weight_col="sample_weight").train_and_score(tr, "y", NUMERIC))


_STD = "count(*) AS rows, count(DISTINCT id) AS ids, 0::BIGINT AS missing, 0::BIGINT AS below, 0::BIGINT AS bad_std"


@query("predict_mean_std", sql(f"SELECT 'oof' AS split, {_STD}, TRUE AS calibrated FROM train UNION ALL SELECT 'test', {_STD}, NULL::BOOLEAN FROM test"))
def predict_mean_std(spark, sf):
    """Squared out-of-fold residuals are one predicted variance on average, and every deviation is above 0."""
    tr = train(spark, sf)
    oof, tst, _ = trainers.predict_mean_std(_trainer(), tr, "y", NUMERIC, test(spark, sf))
    bad = F.count_if(~(F.coalesce(F.col("pred_std"), F.lit(0.0)) > 0)).alias("bad_std")
    gap = (F.col("y") - F.col("pred")) / F.col("pred_std")
    return _split_facts(oof.join(tr.select("id", "y"), "id"), "oof", bad, F.avg(gap * gap).between(0.999, 1.001).alias("calibrated")).unionByName(
        _split_facts(tst, "test", bad, F.first(F.lit(None).cast("boolean")).alias("calibrated")))


ADVERSARIAL = [*FEATURES, "qty_disc", "qty_tax", "mon_line", "disc_tax"]


def _adversarial(spark, sf):
    sides = [df.withColumns({"qty_disc": F.col("qty") * F.col("disc"), "qty_tax": F.col("qty") * F.col("tax"),
                             "mon_line": F.col("mon") * F.col("line"), "disc_tax": F.col("disc") * F.col("tax")})
             for df in (train(spark, sf), test(spark, sf))]
    return trainers.adversarial_validation(*sides, ADVERSARIAL, TREES)


@query("adversarial_validation", sql(
    "SELECT TRUE AS above_half, (SELECT count(*) FROM train) AS positives, (SELECT count(*) FROM test) AS negatives"))
def adversarial_validation(spark, sf):
    return _adversarial(spark, sf)[0].select((F.col("auc") > 0.5).alias("above_half"), "positives", "negatives")


@query("importance_top_k_rows")
def importance_top_k_rows(spark, sf):
    """Place, feature and importance of the ten features that tell train from test best."""
    top = trainers.importance_top_k(_adversarial(spark, sf)[1], 10).collect()
    return spark.createDataFrame([(i, r["feature"], r["importance"]) for i, r in enumerate(top, 1)], "place int, feature string, importance double")


@query("importance_top_k", "SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS place, TRUE AS not_above_the_one_before")
def importance_top_k(spark, sf):
    top = trainers.importance_top_k(_adversarial(spark, sf)[1], 10).collect()
    shares = [1.0, *[r["importance"] for r in top]]
    return spark.createDataFrame([(i, 0.0 <= shares[i] <= shares[i - 1]) for i in range(1, len(shares))],
                                 "place int, not_above_the_one_before boolean")


CANDIDATES = {"qty": "qty", "line": "line", "disc": "disc", "mon": "mon", "qty_disc": "qty * disc", "qty2": "qty * qty"}


def _candidates(spark, sf):
    return train(spark, sf).select("id", "fold", "y", *[F.expr(e).alias(n) for n, e in CANDIDATES.items()])


def _round_sql():
    out = []
    for name, e in CANDIDATES.items():
        out.append(f"""SELECT 0 AS round, '{name}' AS feature, round(sqrt(avg(pow(ln(1 + y) - (a + b * ({e})), 2))), 6) AS score FROM train JOIN (
 SELECT r.fold, regr_slope(ln(1 + y), {e}) AS b, regr_intercept(ln(1 + y), {e}) AS a FROM train t,
 (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r WHERE t.fold <> r.fold GROUP BY r.fold) USING (fold)""")
    return " UNION ALL ".join(out)


@query("forward_select_first_round", sql(_round_sql()))
def forward_select_first_round(spark, sf):
    df = _candidates(spark, sf)
    _, log = selection.forward_select(list(CANDIDATES), selection.linear_scorer(df, list(CANDIDATES), "y"), max_features=1)
    return selection.log_frame(spark, log).filter("round = 0").select("round", "feature", F.round("score", 6).alias("score"))


def _subset_score(names):
    """Pooled out-of-fold error of the least-squares fit on ``names``, from sums alone: f holds those of the fitted rows, h of the held-out."""
    cov = lambda a, b: f"(f.{_pair(a, b)} - f.s_{a} * f.s_{b} / f.n)"
    n = len(names)
    gram = [[cov(a, b) for b in names] for a in names]
    right = [cov(a, "t") for a in names]

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'+' if k % 2 == 0 else '-'} {m[0][k]} * {det([r[:k] + r[k + 1:] for r in m[1:]])}" for k in range(len(m))) + ")"

    weights = [f"{det([[right[r] if c == k else gram[r][c] for c in range(n)] for r in range(n)])} / {det(gram)} AS w{k}" for k in range(n)]
    intercept = "(f.s_t" + "".join(f" - w{k} * f.s_{a}" for k, a in enumerate(names)) + ") / f.n"
    error = "h.s_t_t - 2 * a * h.s_t + a * a * h.n" + "".join(f" - 2 * w{k} * h.{_pair(a, 't')} + 2 * a * w{k} * h.s_{a}" for k, a in enumerate(names))
    error += "".join(f" + w{i} * w{k} * h.{_pair(a, b)}" for i, a in enumerate(names) for k, b in enumerate(names))
    return (f"SELECT '{'|'.join(sorted(names))}' AS names, sqrt(sum({error}) / sum(h.n)) AS score FROM (SELECT *, {intercept} AS a FROM "
            f"(SELECT *, {', '.join(weights)} FROM fitted f) f) f JOIN held h USING (fold)")


def _pair(a, b):
    return "s_" + "_".join(sorted((a, b)))


_VALUES = {**CANDIDATES, "t": "ln(1 + y)"}
_SUMS = "count(*)::DOUBLE AS n, " + ", ".join([f"sum({a})::DOUBLE AS s_{a}" for a in _VALUES] + [
    f"sum({a}::DOUBLE * {b})::DOUBLE AS {_pair(a, b)}" for i, a in enumerate(_VALUES) for b in list(_VALUES)[i:]])
_SELECTION = [
    "v AS (SELECT fold, " + ", ".join(f"({e})::DOUBLE AS {a}" for a, e in _VALUES.items()) + " FROM train)",
    f"held AS (SELECT fold, {_SUMS} FROM v GROUP BY fold)",
    f"fitted AS (SELECT r.fold, {_SUMS} FROM v JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r ON v.fold <> r.fold GROUP BY r.fold)",
    "scores AS MATERIALIZED (" + " UNION ALL ".join(_subset_score(c) for k in (1, 2, 3) for c in itertools.combinations(CANDIDATES, k)) + ")"]
_RANKED = ("SELECT *, CASE row_number() OVER (ORDER BY score, feature) WHEN 1 THEN 'selected' WHEN count(*) OVER () THEN 'discarded' ELSE 'kept' END AS decision FROM ({0})")
_SELECTION += [
    "r0 AS MATERIALIZED (" + _RANKED.format("SELECT 0 AS round, names AS feature, score, [names] AS chosen FROM scores WHERE names NOT LIKE '%|%'") + ")",
    "r1 AS MATERIALIZED (" + _RANKED.format(
        "SELECT 1 AS round, k.feature, s.score, list_concat(b.chosen, [k.feature]) AS chosen FROM r0 k, r0 b, scores s WHERE k.decision = 'kept' AND b.decision = 'selected' "
        "AND s.names = array_to_string(list_sort(list_concat(b.chosen, [k.feature])), '|')") + ")",
    "r2 AS MATERIALIZED (" + _RANKED.format(
        "SELECT 2 AS round, k.feature, s.score, list_concat(b.chosen, [k.feature]) AS chosen FROM r1 k, r1 b, scores s WHERE k.decision = 'kept' AND b.decision = 'selected' "
        "AND s.names = array_to_string(list_sort(list_concat(b.chosen, [k.feature])), '|')") + ")"]


@query("forward_select", sql("SELECT CAST(round AS INTEGER) AS round, feature, round(score, 6) AS score, decision FROM "
                             "(SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)", *_SELECTION))
def forward_select(spark, sf):
    """The whole log: every candidate's score in three rounds, one feature taken and the worst dropped in each."""
    df = _candidates(spark, sf)
    _, log = selection.forward_select(list(CANDIDATES), selection.linear_scorer(df, list(CANDIDATES), "y"),
                                      discard_worst_n=1, stop_at_max_score=False)
    return selection.log_frame(spark, log).filter("round >= 0").select("round", "feature", F.round("score", 6).alias("score"), "decision")


@query("forward_select_trees")
def forward_select_trees(spark, sf):
    """The log of a selection with tree models: candidates coded and cached once, those of a round fitted side by side."""
    df = _candidates(spark, sf)
    with selection.TreeScorer(trainers.CVTrainer({"n_estimators": 3, "max_depth": 3}, n_splits=5), df, "y", list(CANDIDATES)) as scorer:
        _, log = selection.forward_select(list(CANDIDATES), scorer, discard_worst_n=3, max_features=2, spark=spark, at_once=3)
    return selection.log_frame(spark, log)


@query("param_search", "SELECT CAST(unnest(range(6)) AS INTEGER) AS trial, TRUE AS not_better_than_the_best")
def param_search(spark, sf):
    tr = trainers.stored_rows(train(spark, sf), NUMERIC, ["id", "y"])
    space = {"n_estimators": ("int", 2, 6), "learning_rate": ("log", 0.05, 0.5), "max_depth": ("choice", [2, 3, 4]),
             "subsample": ("float", 0.6, 1.0)}

    def objective(params):
        return trainers.CVTrainer(params, n_splits=5, clip_preds=(1.0, None)).train_and_score(tr, "y", NUMERIC).score

    best, trials = search.param_search(spark, objective, space, n_trials=6)
    rows = trials.collect()
    least = next(r["score"] for r in rows if r["params"] == {k: str(v) for k, v in best.items()})
    return spark.createDataFrame([(r["trial"], r["score"] >= least) for r in rows], "trial int, not_better_than_the_best boolean")


SEARCHED = {"alpha": ("log", 10.0, 1e7), "feature": ("choice", ["qty", "line", "broken"])}
_DRAWS = """draws AS (SELECT trial, 10.0::DOUBLE * pow(1e6, ('0x' || substr(md5('42:' || trial || ':alpha'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS alpha,
  ['qty', 'line', 'broken'][CAST(1 + floor(3 * (('0x' || substr(md5('42:' || trial || ':feature'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS BIGINT)] AS feature
  FROM (SELECT CAST(unnest(range(12)) AS INTEGER) AS trial))"""
_TRIALS = """trials AS (SELECT d.trial, sqrt(avg(pow(ln(1 + t.y) - (k.my + k.w * (CASE d.feature WHEN 'qty' THEN t.qty ELSE t.line END - k.mx)), 2))) AS score FROM train t
  JOIN (SELECT d.trial, r.fold, avg(x) AS mx, avg(ln(1 + y)) AS my, covar_pop(x, ln(1 + y)) * count(*) / (var_pop(x) * count(*) + max(d.alpha)) AS w
    FROM (SELECT fold, y, unnest(['qty', 'line']) AS feature, unnest([qty, line::DOUBLE]) AS x FROM train) v
    JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold) r ON v.fold <> r.fold JOIN draws d ON d.feature = v.feature GROUP BY d.trial, r.fold) k USING (fold)
  JOIN draws d ON d.trial = k.trial GROUP BY d.trial)"""


@query("param_search_ridge", sql(
    "SELECT d.trial, CASE WHEN s.score IS NULL THEN 'failed' ELSE 'done' END AS state, round(s.score, 6) AS score, d.feature, "
    "coalesce(s.trial = (SELECT arg_min(trial, score) FROM trials), FALSE) AS best FROM draws d LEFT JOIN trials s USING (trial)", _DRAWS, _TRIALS))
def param_search_ridge(spark, sf):
    """Twelve trials, four at a time, over a ridge's strength and feature; a third of the draws cannot be fitted and fail."""
    frame = train(spark, sf).select("fold", "y", "qty", F.col("line").cast("double").alias("line"))
    gram = linear.gram_by_fold(frame, ["qty", "line"], "y", "fold")

    def objective(params):
        if params["feature"] == "broken":
            raise KeyError(params["feature"])
        return linear.cv_score(gram, [params["feature"]], params["alpha"])

    best, trials = search.param_search(spark, objective, SEARCHED, 12, at_once=4)
    chosen = F.col("params")["alpha"] == F.lit(str(best["alpha"]))
    return trials.select("trial", "state", F.round("score", 6).alias("score"), F.col("params")["feature"].alias("feature"), chosen.alias("best"))


CLIMB_SQL = """SELECT CAST(step AS INTEGER) AS step, model, weight, round(score, 6) AS score FROM (
 SELECT 0 AS step, model, 1.0::DOUBLE AS weight, score FROM start
 UNION ALL SELECT * FROM (
  SELECT 1 AS step, model, w, sqrt(avg(pow(ln(1 + y) - ln(1 + greatest((1 - w) * base + w * pred, 0)), 2))) AS score
  FROM cells GROUP BY model, w ORDER BY score, model, w LIMIT 1))"""
CLIMB_CTES = [
    "long AS (SELECT id, y, model, pred FROM (SELECT id, y, m_mean, m_qty, m_qty_disc FROM oof_w) UNPIVOT (pred FOR model IN (m_mean, m_qty, m_qty_disc)))",
    "start AS (SELECT model, sqrt(avg(pow(ln(1 + y) - ln(1 + pred), 2))) AS score FROM long GROUP BY model ORDER BY score, model LIMIT 1)",
    "cells AS (SELECT l.y, l.model, l.pred, b.pred AS base, g.w FROM long l JOIN long b ON b.id = l.id AND b.model = (SELECT model FROM start), "
    "(SELECT i / 10.0::DOUBLE AS w FROM range(-5, 6) r(i) WHERE i <> 0) g WHERE l.model <> b.model)"]


def _filled_models(spark, sf):
    return model_frames(spark, sf)[0].na.fill(0.0, MODELS)


@query("hill_climb_first_step", models_sql(CLIMB_SQL, *CLIMB_CTES))
def hill_climb_first_step(spark, sf):
    climb = ensemble.hill_climb(_filled_models(spark, sf), MODELS, "y", tol=0.0, step=0.1, max_steps=1)
    return climb.steps_frame(spark).withColumn("score", F.round("score", 6))


MOST_STEPS = 12


def _climb_sql():
    """The climb in SQL: a state row per step, each from all models and weights mixed into the one before."""
    blend = lambda s, m, w: " + ".join(
        f"((1 - {w}) * {s}.w_{x} + CASE WHEN {m} = '{x}' THEN {w} ELSE 0 END) * o.{x}" for x in MODELS)
    score = "sqrt(avg(pow(ln(1 + o.y) - ln(1 + greatest({0}, 0)), 2)))"
    start = "s0 AS MATERIALIZED (SELECT 0 AS step, m.model, 1.0::DOUBLE AS weight, " + score.format(f"CASE m.model {' '.join(f'WHEN {chr(39)}{x}{chr(39)} THEN o.{x}' for x in MODELS)} END") + " AS score, " + ", ".join(
        f"CASE WHEN m.model = '{x}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w_{x}" for x in MODELS) + f" FROM oof_w o, (SELECT unnest({MODELS}) AS model) m GROUP BY m.model ORDER BY score, model LIMIT 1)"
    ctes = [start]
    for k in range(1, MOST_STEPS + 1):
        p = f"s{k - 1}"
        weights = ", ".join(f"(1 - g.w) * any_value(p.w_{x}) + CASE WHEN m.model = '{x}' THEN g.w ELSE 0 END AS w_{x}" for x in MODELS)
        ctes.append(f"s{k} AS MATERIALIZED (SELECT c.* FROM (SELECT {k} AS step, m.model, g.w AS weight, {score.format(blend('p', 'm.model', 'g.w'))} AS score, {weights} "
                    f"FROM oof_w o, {p} p, (SELECT unnest({MODELS}) AS model) m, (SELECT i / 10.0::DOUBLE AS w FROM range(-5, 6) r(i) WHERE i <> 0) g "
                    f"WHERE NOT (m.model = p.model AND p.step = 0) GROUP BY m.model, g.w ORDER BY score, model, weight LIMIT 1) c, {p} WHERE {p}.score - c.score >= 1e-5)")
    every = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(MOST_STEPS + 1))
    ctes.append(f"steps AS MATERIALIZED ({every})")
    body = ("SELECT 'step' AS kind, CAST(step AS INTEGER) AS step, model, round(weight, 6) AS weight, round(score, 6) AS score FROM steps UNION ALL "
            + " UNION ALL ".join(f"SELECT 'weight', (SELECT CAST(max(step) AS INTEGER) FROM steps), '{x}', round((SELECT arg_max(w_{x}, step) FROM steps), 6), NULL" for x in MODELS))
    return models_sql(body, *ctes)


@query("hill_climb", _climb_sql())
def hill_climb(spark, sf):
    """The whole climb to its end: every step's model, weight and score, and the weights at the end."""
    climb = ensemble.hill_climb(_filled_models(spark, sf), MODELS, "y", tol=1e-5, step=0.1)
    last = climb.steps[-1][0]
    rows = [("step", n, m, round(w, 6), round(score, 6)) for n, m, w, score in climb.steps]
    rows += [("weight", last, m, round(climb.weights[m], 6), None) for m in MODELS]
    return spark.createDataFrame(rows, "kind string, step int, model string, weight double, score double")


@query("hill_climb_facts", "SELECT TRUE AS converged, TRUE AS weights_sum_to_one, TRUE AS score_is_of_the_blend, TRUE AS not_above_the_best_model")
def hill_climb_facts(spark, sf):
    """The full climb: its end, its weights, and its score against the blend's own and the single models'."""
    rows = _filled_models(spark, sf)
    climb = ensemble.hill_climb(rows, MODELS, "y", tol=1e-5)
    blend = sum((F.lit(w) * F.col(m) for m, w in climb.weights.items()), F.lit(0.0))
    own, *single = rows.agg(*[metrics.rmsle(F.col("y"), F.greatest(p, F.lit(0.0))) for p in (blend, *map(F.col, MODELS))]).first()
    return spark.createDataFrame(
        [(climb.converged, abs(sum(climb.weights.values()) - 1) < 1e-9, abs(own - climb.score) < 1e-9, climb.score <= min(single))],
        "converged boolean, weights_sum_to_one boolean, score_is_of_the_blend boolean, not_above_the_best_model boolean")
