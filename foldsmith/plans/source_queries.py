"""Tables, feature store and prediction store."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import functions as F

from foldsmith.functions import scalar
from foldsmith.operators import encoders
from foldsmith.operators.metrics import rmsle
from foldsmith.plans.registry import query
from foldsmith.plans.standin import CENTS, models_sql, predictions, sql, sql_nested, test, train
from foldsmith.sources import feature_store as fs, predictions as store, tables
from foldsmith.storage import scratch_path

# -- tables ----------------------------------------------------------------------------------------


@query("load_frame", "SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_orderpriority, o_totalprice AS y FROM orders")
def load_frame(spark, sf):
    features, target = tables.load_frame(spark, f"{sf}/orders.parquet", id="o_orderkey", target="o_totalprice")
    return features.select("id", "o_custkey", "o_orderstatus", "o_orderpriority").join(target, "id")


@query("load_as_text", "SELECT p_partkey AS id, CAST(p_retailprice AS VARCHAR) AS p_retailprice, CAST(p_size AS VARCHAR) AS p_size FROM part")
def load_as_text(spark, sf):
    return tables.load_as_text(spark, f"{sf}/part.parquet", ["p_retailprice", "p_size"], id="p_partkey").select(
        "id", "p_retailprice", "p_size")


@query("load_external", "SELECT l_linestatus AS status, l_quantity AS qty, l_extendedprice AS y FROM lineitem")
def load_external(spark, sf):
    drops = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
    return tables.load_external(spark, f"{sf}/lineitem.parquet",
                                {"l_linestatus": "status", "l_quantity": "qty", "l_extendedprice": "y"}, drops)


# -- feature store ---------------------------------------------------------------------------------

def _meta(kind, subtype, day, features, **more):
    return {"type": kind, "subtype": subtype, "description": f"{subtype} of {features}", "feature_list": features,
            "created_at": datetime(2025, 5, day), "created_by": "source_queries", "fillna": False, **more}


def _new_store(spark) -> fs.FeatureStore:
    return fs.FeatureStore(spark, scratch_path(spark, "feature-store"))


def _fill_plain(spark, sf: str, made: fs.FeatureStore) -> fs.FeatureStore:
    """Four plain features, one of them saved twice."""
    cols = ["id", "status", "flag", "line", "qty", "disc"]
    tr, te = train(spark, sf).select(*cols), test(spark, sf).select(*cols)
    product = "Multiply_qty_line"

    def build(df):
        df = scalar.autofe_arith(scalar.autofe_combine(df, [("status", "flag")]), [("qty", "line")], ["Multiply"])
        return scalar.masked_by_category(scalar.polynomial_features(df, ["qty", "disc"]), ["qty"], "status", {"F": "F"})

    early = {product: _meta("autofe", "interaction", 1, ["qty", "line"])}
    made.save_many(*(d.withColumn(product, F.col("qty") * F.col("line") + 1) for d in (tr, te)), early)
    made.save_many(build(tr), build(te), {
        "Combine_status_flag": _meta("autofe", "combine", 2, ["status", "flag"]),
        product: _meta("autofe", "interaction", 3, ["qty", "line"], filename_prefix=f"{product}_v2"),
        "poly_qty2_disc": _meta("polynomial", "degree 3", 4, ["qty", "disc"]),
        "masked_qty_x_F": _meta("masked feature", "masked feature by status", 5, ["qty", "status"])})
    return made


def _fill_folded(spark, sf: str, made: fs.FeatureStore) -> fs.FeatureStore:
    """Two folded features, encoded together and written as one family."""
    both = {6: ["qty"], 7: ["qty", "disc"]}
    rows = encoders.target_encode_nested_many(train(spark, sf), test(spark, sf), "y", list(both.values()), scale=CENTS)
    made.save_folded_many(rows, {encoders.te_name(keys): _meta("te", "te_mean without fillna", day, keys, agg="mean", outer_folds=5, inner_folds=4, smooth=0.0)
                                 for day, keys in both.items()})
    return made


@lru_cache(maxsize=4)
def _filled(app: str, spark, sf: str) -> fs.FeatureStore:
    return _fill_folded(spark, sf, _fill_plain(spark, sf, _new_store(spark)))


def filled_store(spark, sf) -> fs.FeatureStore:
    """The store that the reading queries share; the writing ones make their own."""
    return _filled(spark.sparkContext.applicationId, spark, sf)


CATALOG_SQL = """catalog AS (SELECT column_name, filename_prefix, type, subtype, created_at, list_sort(feature_list) AS feature_list, agg, outer_folds FROM (VALUES
 ('Multiply_qty_line', 'Multiply_qty_line', 'autofe', 'interaction', TIMESTAMP '2025-05-01', ['qty', 'line'], NULL, NULL),
 ('Combine_status_flag', 'Combine_status_flag', 'autofe', 'combine', TIMESTAMP '2025-05-02', ['status', 'flag'], NULL, NULL),
 ('Multiply_qty_line', 'Multiply_qty_line_v2', 'autofe', 'interaction', TIMESTAMP '2025-05-03', ['qty', 'line'], NULL, NULL),
 ('poly_qty2_disc', 'poly_qty2_disc', 'polynomial', 'degree 3', TIMESTAMP '2025-05-04', ['qty', 'disc'], NULL, NULL),
 ('masked_qty_x_F', 'masked_qty_x_F', 'masked feature', 'masked feature by status', TIMESTAMP '2025-05-05', ['qty', 'status'], NULL, NULL),
 ('te_mean_qty', 'te_mean_qty', 'te', 'te_mean without fillna', TIMESTAMP '2025-05-06', ['qty'], 'mean', 5),
 ('te_mean_qty_disc', 'te_mean_qty_disc', 'te', 'te_mean without fillna', TIMESTAMP '2025-05-07', ['qty', 'disc'], 'mean', 5))
 AS t(column_name, filename_prefix, type, subtype, created_at, feature_list, agg, outer_folds)),
latest AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY created_at DESC) = 1)"""
PLAIN_PREFIXES = ["Multiply_qty_line", "Combine_status_flag", "Multiply_qty_line_v2", "poly_qty2_disc", "masked_qty_x_F"]


@query("feature_store_write", sql(
    "SELECT feature, split, count(*) AS rows, count(DISTINCT id) AS ids FROM f, (SELECT unnest("
    + str(PLAIN_PREFIXES) + ") AS feature) WHERE split <> 'ext' GROUP BY feature, split"))
def feature_store_write(spark, sf):
    stored = _fill_plain(spark, sf, _new_store(spark)).stored_rows()
    return stored.select(F.col("filename_prefix").alias("feature"), F.regexp_extract("part", "split=(.*)", 1).alias("split"), "rows", "ids")


@query("feature_store_read", sql(
    "SELECT id, split, qty * line AS Multiply_qty_line, status || '_' || flag AS Combine_status_flag, "
    "CAST(CAST(qty * qty * disc AS FLOAT) AS DOUBLE) AS poly_qty2_disc FROM f WHERE split <> 'ext'"))
def feature_store_read(spark, sf):
    names = ["Multiply_qty_line", "Combine_status_flag", "poly_qty2_disc"]
    tr, te = filled_store(spark, sf).read_features(names)
    both = tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
    return both.withColumn("poly_qty2_disc", F.col("poly_qty2_disc").cast("double"))


WIDE = [f"{op}_{a}_{b}" for op in ("Multiply", "Plus", "Minus") for a, b in (("qty", "line"), ("qty", "mon"), ("line", "mon"))]
SQUARES = [f"{c}_{k}" for c in ("qty", "line", "mon") for k in range(1, 5)]


@lru_cache(maxsize=4)
def _wide_store(app: str, spark, sf: str) -> fs.FeatureStore:
    """Two families of 9 and 12 columns."""
    made = _new_store(spark)
    tr, te = (df(spark, sf).select("id", "qty", "line", "mon") for df in (train, test))
    pairs = [("qty", "line"), ("qty", "mon"), ("line", "mon")]
    made.save_many(*(scalar.autofe_arith(d, pairs, ["Multiply", "Plus", "Minus"]) for d in (tr, te)), {n: _meta("autofe", "wide", 8, n.split("_")[1:]) for n in WIDE})
    made.save_many(*(d.select("id", *[(F.col(n.rsplit("_", 1)[0]) * int(n[-1])).alias(n) for n in SQUARES]) for d in (tr, te)),
                   {n: _meta("scaled", "wide", 9, [n.rsplit("_", 1)[0]]) for n in SQUARES})
    return made


def wide_store(spark, sf) -> fs.FeatureStore:
    return _wide_store(spark.sparkContext.applicationId, spark, sf)


_OPS = {"Multiply": "*", "Plus": "+", "Minus": "-"}


@query("feature_store_read_wide", sql(
    "SELECT id, split, " + ", ".join(f"CAST({n.split('_')[1]} {_OPS[n.split('_')[0]]} {n.split('_')[2]} AS DOUBLE) AS {n}" for n in WIDE) + ", "
    + ", ".join(f"{n.rsplit('_', 1)[0]} * {n[-1]} AS {n}" for n in SQUARES) + " FROM f WHERE split <> 'ext'"))
def feature_store_read_wide(spark, sf):
    """21 columns of two families, met bucket by bucket."""
    tr, te = wide_store(spark, sf).read_features([*WIDE, *SQUARES])
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


@query("feature_store_criteria", sql(
    "SELECT id, split, qty * CASE WHEN status = 'F' THEN 1 ELSE 0 END AS masked_qty_x_F, "
    "CAST(CAST(qty * qty * disc AS FLOAT) AS DOUBLE) AS poly_qty2_disc FROM f WHERE split <> 'ext'"))
def feature_store_criteria(spark, sf):
    tr, te = filled_store(spark, sf).read_features(criteria={
        "type": ("polynomial", "masked feature"), "subtype": ("degree 3", "masked feature by status")})
    both = tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
    return both.withColumn("poly_qty2_disc", F.col("poly_qty2_disc").cast("double"))


SIZES_SQL = """sized AS (SELECT c.*, CASE WHEN outer_folds IS NULL THEN n ELSE 5 * n END AS rows
 FROM catalog c, (SELECT count(*) AS n FROM f WHERE split <> 'ext'))"""


def _stored_rows(spark, sf):
    """Stored rows per prefix, plain and folded."""
    return filled_store(spark, sf).stored_rows().groupBy("filename_prefix").agg(F.sum("rows").alias("rows"))


@query("feature_store_latest", sql(
    "SELECT column_name, filename_prefix, created_at, rows FROM latest JOIN sized USING (column_name, filename_prefix, created_at)",
    CATALOG_SQL, SIZES_SQL))
def feature_store_latest(spark, sf):
    chosen = fs.newest(filled_store(spark, sf).catalog()).select("column_name", "filename_prefix", "created_at")
    return chosen.join(_stored_rows(spark, sf), "filename_prefix")


@query("feature_store_order", sql(
    "SELECT row_number() OVER (ORDER BY created_at DESC) AS place, column_name, rows FROM latest JOIN sized "
    "USING (column_name, filename_prefix, created_at)", CATALOG_SQL, SIZES_SQL))
def feature_store_order(spark, sf):
    chosen = fs.newest_first(fs.newest(filled_store(spark, sf).catalog())).select("column_name", "filename_prefix").collect()
    order = spark.createDataFrame([(i, *r) for i, r in enumerate(chosen, start=1)],
                                  "place long, column_name string, filename_prefix string")
    return order.join(_stored_rows(spark, sf), "filename_prefix").select("place", "column_name", "rows")


@query("feature_store_missing", sql(
    "SELECT column_name, count(*) AS rows FROM (SELECT unnest(['masked_qty_x_' || status, 'te_mean_qty', 'bins_' || flag]) AS column_name "
    "FROM train) WHERE column_name NOT IN (SELECT column_name FROM catalog) GROUP BY column_name", CATALOG_SQL))
def feature_store_missing(spark, sf):
    # the names a run over these rows would ask for, with the number of rows that need them
    wanted = train(spark, sf).select(F.explode(F.array(
        F.concat(F.lit("masked_qty_x_"), "status"), F.lit("te_mean_qty"), F.concat(F.lit("bins_"), "flag"))).alias("column_name"))
    wanted = wanted.groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"))
    absent = fs.missing(filled_store(spark, sf).catalog(), [r["column_name"] for r in wanted.select("column_name").collect()])
    return wanted.join(absent, "column_name")


@query("feature_store_overview", sql(
    "SELECT type, subtype, outer_folds IS NOT NULL AS folded, count(*) AS features, max(created_at) AS newest, "
    "CAST(sum(rows) AS BIGINT) AS rows FROM sized GROUP BY ALL", CATALOG_SQL, SIZES_SQL))
def feature_store_overview(spark, sf):
    made = filled_store(spark, sf)
    rows = made.catalog().join(_stored_rows(spark, sf), "filename_prefix").groupBy("type", "subtype").agg(F.sum("rows").alias("rows"))
    return made.overview().join(rows, ["type", "subtype"])


@query("folded_features_read", sql(
    "SELECT a.id, a.outer_fold, a.part, a.te AS te_mean_qty, b.te AS te_mean_qty_disc FROM a JOIN b USING (id, outer_fold, part)",
    sql_nested("a", ["qty"]), sql_nested("b", ["qty", "disc"])))
def folded_features_read(spark, sf):
    rows = filled_store(spark, sf).read_folded(feature_lists=[["disc", "qty"], ["qty"]], agg="mean")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("te_mean_qty", "te_mean_qty_disc")})


@query("folded_features_write", sql(
    "SELECT feature, CAST(o AS INTEGER) AS outer_fold, CASE WHEN split = 'test' THEN 'test' WHEN fold = o THEN 'val' ELSE 'train' END AS part, "
    "count(*) AS rows FROM f, range(5) r(o), (SELECT unnest(['te_mean_qty', 'te_mean_qty_disc']) AS feature) WHERE split <> 'ext' GROUP BY ALL"))
def folded_features_write(spark, sf):
    stored = _fill_folded(spark, sf, _new_store(spark)).stored_rows()
    return stored.select(F.col("filename_prefix").alias("feature"), F.regexp_extract("part", "outer_fold=([0-9]+)", 1).cast("int").alias("outer_fold"),
                         F.regexp_extract("part", "part=(.*)", 1).alias("part"), "rows")


# -- predictions -----------------------------------------------------------------------------------

@query("predictions_write", models_sql("SELECT model, split, id, pred FROM preds"))
def predictions_write(spark, sf):
    path = scratch_path(spark, "predictions")
    rows = predictions(spark, sf).cache()
    try:
        for model, splits in {"m_mean": store.SPLITS[:2], "m_qty": store.SPLITS, "m_qty_disc": store.SPLITS}.items():
            store.predictions_write(path, model, **{
                s: rows.filter((F.col("model") == model) & (F.col("split") == s)) for s in splits})
    finally:
        rows.unpersist()
    return store.predictions_read(spark, path).select("model", "split", "id", "pred")


@query("run_manifest", models_sql(
    "SELECT model, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, round(sqrt(avg(CASE WHEN split = 'oof' THEN pow(ln(1 + pred) - ln(1 + y), 2) END)), 6) AS score, "
    "CAST(count(DISTINCT split) AS BIGINT) AS versions FROM preds LEFT JOIN (SELECT id, y FROM train) USING (id) GROUP BY model"))
def run_manifest(spark, sf):
    """The manifest of three stored runs: their splits, as many versions, and the score that each was stored with."""
    path = scratch_path(spark, "runs")
    rows = predictions(spark, sf).join(train(spark, sf).select("id", "y"), "id", "left").cache()
    try:
        for model, splits in {"m_mean": store.SPLITS[:2], "m_qty": store.SPLITS, "m_qty_disc": store.SPLITS}.items():
            own = rows.filter(F.col("model") == model)
            score = own.filter("split = 'oof'").agg(rmsle(F.col("y"), F.col("pred"))).first()[0]
            for s in splits:  # a later write adds its split to the run
                store.predictions_write(path, model, score, **{s: own.filter(F.col("split") == s)})
    finally:
        rows.unpersist()
    last = store.latest_runs(spark, path)
    return last.select("model", F.array_join(F.array_sort(F.map_keys("versions")), ",").alias("splits"), F.round("score", 6).alias("score"),
                       F.size(F.array_distinct(F.map_values("versions"))).cast("long").alias("versions"))


@query("predictions_load", models_sql(
    "SELECT 'oof' AS kind, model, id, pred FROM preds WHERE split = 'oof' UNION ALL "
    "SELECT 'test', model, id, pred FROM preds WHERE split = 'test_from_full' UNION ALL "
    "SELECT 'test', model, id, pred FROM preds WHERE split = 'test' AND model = 'm_mean'"))
def predictions_load(spark, sf):
    return store.predictions_load(predictions(spark, sf))


@query("predictions_import", sql(
    "SELECT 'external_net' AS model, 'oof' AS split, id, round(exp(ln(1 + y) * 0.99::DOUBLE) - 1, 4) AS pred FROM train"))
def predictions_import(spark, sf):
    made_elsewhere = train(spark, sf).select(F.col("id").alias("row"), (F.log1p("y") * F.lit(0.99)).alias("log_pred"))
    return store.predictions_import(made_elsewhere, "external_net", "oof", "row", "log_pred").withColumn("pred", F.round("pred", 4))


@query("submission_write", models_sql(
    "SELECT id, CASE WHEN m_qty_disc < 20000 THEN 20000.0::DOUBLE WHEN m_qty_disc > 60000 THEN 60000.0::DOUBLE ELSE m_qty_disc END AS price FROM test_w"))
def submission_write(spark, sf):
    path = scratch_path(spark, "submission")
    rows = predictions(spark, sf).filter("split = 'test' AND model = 'm_qty_disc'")
    store.submission_write(rows, path, "price", 20000.0, 60000.0)
    return spark.read.schema("id string, price double").csv(path, header=True)
