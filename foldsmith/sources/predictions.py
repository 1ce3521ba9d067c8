"""Prediction store: long ``(model, split, id, pred)`` rows, partitioned by model, split and version, with a manifest of runs.

Splits are ``oof`` (out-of-fold on train), ``test`` (mean over folds) and ``test_from_full`` (refit). A run writes its splits in
one job and then appends a manifest row; readers take the versions that manifest rows name, so a run that was stopped half
way is never seen, and models are listed without a scan.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from foldsmith.functions.scalar import bounded
from foldsmith.operators.lookup import is_small

SCHEMA = "id string, pred double, model string, split string, version string"
MANIFEST = ("model string, versions map<string,string>, score double, best_iterations array<int>, params map<string,string>, "
            "saved_ns long")
SPLITS = ("oof", "test", "test_from_full")


def _folder(spark: SparkSession, path: str, name: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every run that was stored whole, with its model, versions by split, score, best iterations and parameters."""
    folder, files = _folder(spark, path, "manifest")
    return spark.read.schema(MANIFEST).parquet(str(folder)) if files.exists(folder) else spark.createDataFrame([], MANIFEST)


def latest_runs(spark: SparkSession, path: str) -> DataFrame:
    """The last run of each model."""
    last = W.partitionBy("model").orderBy(F.desc("saved_ns"))
    return manifest(spark, path).withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def committed(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Version of each split of each model; one row a model reaches the driver."""
    return {r["model"]: dict(r["versions"]) for r in latest_runs(spark, path).select("model", "versions").collect()}


def predictions_write(path: str, model: str, score: float | None = None, best_iterations: Sequence[int] | None = None,
                      params: Mapping[str, object] | None = None, **splits: DataFrame) -> None:
    """Store the given splits of one run; running a model again replaces those splits and leaves its others.

    What describes the run goes into the manifest, whose row is written last.
    """
    for split in splits:
        if split not in SPLITS:
            raise ValueError(f"unknown split {split!r}")
    spark, version = next(iter(splits.values())).sparkSession, uuid.uuid4().hex
    rows = reduce(DataFrame.unionByName, [
        df.select(F.col("id").cast("string").alias("id"), F.col("pred").cast("double").alias("pred"), F.lit(model).alias("model"),
                  F.lit(split).alias("split"), F.lit(version).alias("version")) for split, df in splits.items()])
    (rows.hint("rebalance", F.col("split")).write.mode("append").partitionBy("model", "split", "version").parquet(f"{path.rstrip('/')}/rows"))
    versions = committed(spark, path).get(model, {}) | {s: version for s in splits}
    row = (model, versions, None if score is None else float(score), None if best_iterations is None else [int(n) for n in best_iterations],
           None if params is None else {k: str(v) for k, v in params.items()}, time.time_ns())
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")


def predictions_read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the last run of every model, by the manifest; reads prune to its folders."""
    place = [f"{m}/{s}/{v}" for m, versions in committed(spark, path).items() for s, v in versions.items()]
    rows = spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/rows")
    return rows.filter(F.concat_ws("/", "model", "split", "version").isin(place)).drop("version")


def predictions_vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the versions that no model's last run names, and return them."""
    live = {v for versions in committed(spark, path).values() for v in versions.values()}
    top, files = _folder(spark, path, "rows")
    gone = []
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{top.toString()}/model=*/split=*/version=*")):
        version = status.getPath().getName().removeprefix("version=")
        if version not in live:
            files.delete(status.getPath(), True)
            gone.append(version)
    return gone


def predictions_load(predictions: DataFrame, stored: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """OOF rows, and for each model its test rows: from the full refit where it has them, else fold means.

    ``stored`` lists the splits of each model, as `committed` does; without it the rows are scanned for them.
    """
    if stored is None:  # one row per model
        have = predictions.groupBy("model").agg(
            *[F.max(F.when(F.col("split") == s, 1)).isNotNull().alias(s) for s in SPLITS]).filter("oof").collect()
    else:
        have = [{"model": m, **{s: s in splits for s in SPLITS}} for m, splits in sorted(stored.items()) if "oof" in splits]
    bare = sorted(r["model"] for r in have if not (r["test"] or r["test_from_full"]))
    if bare:
        raise ValueError(f"no test predictions for {bare}")
    chosen = [(r["model"], "test_from_full" if r["test_from_full"] else "test") for r in have]
    keep = F.lit(False)
    for model, split in chosen:
        keep = keep | ((F.col("model") == model) & F.col("split").isin("oof", split))
    return predictions.filter(keep).select(
        F.when(F.col("split") == "oof", "oof").otherwise("test").alias("kind"), "model", "id", "pred")


def predictions_import(external: DataFrame, model: str, split: str, id_col: str, pred_col: str,
                       log_scale: bool = True) -> DataFrame:
    """Predictions made elsewhere, brought to the target's scale and to the store's columns."""
    pred = F.expm1(pred_col) if log_scale else F.col(pred_col)
    return external.select(F.lit(model).alias("model"), F.lit(split).alias("split"),
                           F.col(id_col).cast("string").alias("id"), pred.alias("pred"))


def align_models(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """One column per model, by id."""
    if models is None:
        models = sorted(r[0] for r in predictions.select("model").distinct().collect())
    return predictions.groupBy("id").pivot("model", list(models)).agg(F.max("pred"))


def id_mismatch_report(predictions: DataFrame, base_model: str, models: Sequence[str]) -> DataFrame:
    """Ids a model lacks, or has beyond those of the base model."""
    seen = predictions.groupBy("id").agg(
        *[F.count(F.when(F.col("model") == m, 1)).alias(m) for m in dict.fromkeys([base_model, *models])])
    base = F.col(f"`{base_model}`") > 0
    cells = [F.struct(F.lit(m).alias("model"),
                      F.count(F.when(base & (F.col(f"`{m}`") == 0), 1)).alias("missing"),
                      F.count(F.when(~base & (F.col(f"`{m}`") > 0), 1)).alias("extra")) for m in models]
    return seen.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def models_not_used(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    used = weights.filter(F.col("weight") != 0).select("model")
    return predictions.select("model").distinct().join(used, "model", "left_anti")


def blend_predictions(predictions: DataFrame, weights: DataFrame, lower: float | None = 0.0) -> DataFrame:
    """Weighted sum over models by id; the models' predictions are clipped first, weights may be negative."""
    if not is_small(weights):
        raise ValueError("a weight table has one row per model")
    joined = predictions.join(F.broadcast(weights.select("model", "weight")), "model")
    return joined.groupBy("id").agg(F.sum(bounded(F.col("pred"), lower) * F.col("weight")).alias("pred"))


def submission(predictions: DataFrame, target: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    return predictions.select("id", bounded(F.col("pred"), lower, upper).alias(target))


def submission_write(predictions: DataFrame, path: str, target: str, lower: float | None = None,
                     upper: float | None = None) -> None:
    """CSV with a header per part file, clipped to the target's range."""
    submission(predictions, target, lower, upper).write.mode("overwrite").csv(path, header=True)
