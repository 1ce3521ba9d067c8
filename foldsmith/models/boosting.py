"""Boosted regression trees that can go on from where they are, a chunk of trees at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.storage import materialize

# settings of boosting itself; all others are those of its trees
OWN = {"maxIter", "stepSize", "lossType", "seed", "validationTol", "validationIndicatorCol"}
# a chunk's rows are cached; every so many chunks they are written, so that what a lost executor costs stays bounded
CHUNKS_PER_WRITE = 8


@dataclass
class Boosted:
    """``model`` ends at the best iteration; ``curve`` has the error after each of the ``fitted`` trees."""

    model: GBTRegressionModel
    curve: list[float]
    fitted: int


def best_iteration(curve: Sequence[float], rounds: int) -> int:
    """1-based iteration with the lowest error before ``rounds`` iterations without improvement."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif i - best >= rounds:
            break
    return best + 1


def out_of_patience(curve: Sequence[float], rounds: int) -> bool:
    return len(curve) - best_iteration(curve, rounds) >= rounds


def joined(trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float], n_features: int) -> GBTRegressionModel:
    """One boosted model of trees fitted one by one."""
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml
    java_trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    java_weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights)):
        java_trees[i], java_weights[i] = tree._java_obj, float(weight)
    uid = ml.util.Identifiable.randomUID("gbtr")
    return GBTRegressionModel(ml.regression.GBTRegressionModel(uid, java_trees, java_weights, n_features)).setFeaturesCol(
        "features").setPredictionCol("__raw")


def _residual(total: str, loss: str) -> Column:
    """What the next tree is fitted to: the negative gradient of the loss."""
    gap = F.col("__label") - F.col(total)
    return 2.0 * gap if loss == "squared" else F.signum(gap)


def _with_tree(rows: DataFrame, tree: DecisionTreeRegressionModel, number: int, before: str, weight: float) -> DataFrame:
    named = tree.copy().setFeaturesCol("features").setPredictionCol(f"__t{number}")
    return named.transform(rows).withColumn(f"__s{number}", F.col(before) + F.lit(weight) * F.col(f"__t{number}"))


def boost(fit: DataFrame, val: DataFrame, params: Mapping[str, object], rounds: int, evaluate: Callable[[str], Column],
          weight_col: str | None = None, chunk: int = 10) -> Boosted:
    """Fit trees until ``rounds`` iterations pass without a lower error on ``val``, and end the model at the lowest.

    Trees are those that Spark's own boosting fits with the same settings: the first on the label with weight 1, each
    later one on the negative gradient with weight ``stepSize``. Sums of predictions are kept beside the rows, so a further chunk
    costs its own trees and nothing else; after each chunk one pass gives the errors of all its iterations, ``evaluate`` being an
    aggregate over the columns of ``val`` and the named sum. At most the best iteration, ``rounds`` and one chunk of trees are fitted.

    ``fit`` has ``__label`` and ``features`` (and the weights), ``val`` has ``features`` and what ``evaluate`` needs (``y``); both are read once.
    """
    most, step, loss, seed = (params.get(k, v) for k, v in (("maxIter", 20), ("stepSize", 0.1), ("lossType", "squared"), ("seed", 42)))
    options = {"featureSubsetStrategy": "all", **{k: v for k, v in params.items() if k not in OWN}}
    # one seed gives the split candidates of Spark's own boosting; drawn rows or features need another one for each tree
    drawn = float(options.get("subsamplingRate", 1.0)) < 1.0 or options["featureSubsetStrategy"] != "all"
    if weight_col:
        options["weightCol"] = weight_col
    kept = ["__label", "features", *([weight_col] if weight_col else [])]
    start = F.lit(0.0).alias("__sum")
    rows, checked = fit.select(*kept, start).persist(), val.select(*val.columns, start).persist()
    trees: list[DecisionTreeRegressionModel] = []
    weights: list[float] = []
    curve: list[float] = []
    try:
        while len(trees) < most and not (curve and out_of_patience(curve, rounds)):
            first, grown, scored, before = len(trees), rows, checked, "__sum"
            for n in range(first, min(first + chunk, most)):
                learner = RandomForestRegressor(numTrees=1, bootstrap=False, featuresCol="features", labelCol="__target", predictionCol="__raw",
                                                seed=int(seed) + (n if drawn else 0), **options)
                target = F.col("__label") if n == 0 else _residual(before, str(loss))
                trees.append(learner.fit(grown.withColumn("__target", target)).trees[0])
                weights.append(1.0 if n == 0 else float(step))
                grown, scored = (_with_tree(df, trees[-1], n, before, weights[-1]) for df in (grown, scored))
                before = f"__s{n}"
            sums = [f"__s{n}" for n in range(first, len(trees))]
            curve += map(float, scored.agg(*[evaluate(name).alias(name) for name in sums]).first())
            if len(trees) < most and not out_of_patience(curve, rounds):
                write = len(trees) // chunk % CHUNKS_PER_WRITE == 0
                following = [df.select(*columns, F.col(before).alias("__sum")) for df, columns in ((grown, kept), (scored, val.columns))]
                following = [materialize(df) if write else df.persist() for df in following]
                for df in following:
                    df.count()
                for df in (rows, checked):
                    df.unpersist()
                rows, checked = following
    finally:
        rows.unpersist()
        checked.unpersist()
    best = best_iteration(curve, rounds)
    return Boosted(joined(trees[:best], weights[:best], trees[0].numFeatures), curve, len(trees))


def enough_rows(rows: DataFrame, weight_col: str) -> DataFrame:
    """``rows`` repeated, with their weights dealt evenly to the copies, if they are fewer than the levels of a category in ``features``.

    Spark refuses such categories, though trees see only sums of weights. Copies are a power of 2, so these sums stay as they are.
    """
    about = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    widest = max((len(a.get("vals", ())) for a in about.get("nominal", ())), default=0)
    have = rows.limit(widest).count() if widest else 0
    if not 0 < have < widest:
        return rows
    copies = 1 << (-(-widest // have) - 1).bit_length()
    return rows.withColumn(weight_col, F.col(weight_col) / F.lit(float(copies))).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("__copy")


def grow_drawn(rows: DataFrame, params: Mapping[str, object], trees: list[DecisionTreeRegressionModel], numbers: range) -> None:
    """Add the trees ``numbers`` of a boosted sum of squared loss to ``trees``, those before them; each has rows drawn for it alone.

    ``rows`` stand for rows that are equal in ``features``, and have for tree n the weight ``__n_<n>`` of those drawn and the weighted sum
    ``__s_<n>`` of their labels: the gradient is linear in the label, so a drawn set's mean gradient is that of its mean label.
    """
    step, seed = params.get("stepSize", 0.1), int(params.get("seed", 42))
    options = {"featureSubsetStrategy": "all", **{k: v for k, v in params.items() if k not in OWN}, "subsamplingRate": 1.0}
    own_seeds = options["featureSubsetStrategy"] != "all"
    columns, grown, before = ["features", *[f"__{x}_{n}" for n in numbers for x in "ns"]], rows, "__sum"
    if trees:
        grown = joined(trees, tree_weights(len(trees), step), trees[0].numFeatures).transform(rows)
    grown = grown.select(*columns, (F.col("__raw") if trees else F.lit(0.0)).alias(before))
    for n in numbers:
        weight = F.col(f"__n_{n}")
        label = F.col(f"__s_{n}") / weight
        drawn = grown.where(weight > 0).select("features", weight.alias("__weight"), (label if n == 0 else 2.0 * (label - F.col(before))).alias("__target"))
        learner = RandomForestRegressor(numTrees=1, bootstrap=False, featuresCol="features", labelCol="__target", weightCol="__weight", predictionCol="__raw",
                                        seed=seed + (n if own_seeds else 0), **options)
        trees.append(learner.fit(enough_rows(drawn, "__weight")).trees[0])
        grown = _with_tree(grown, trees[-1], n, before, 1.0 if n == 0 else float(step))
        before = f"__s{n}"


def tree_weights(count: int, step: float) -> list[float]:
    """Weights of a boosted sum's trees: the first counts whole, each later one by the step."""
    return [1.0, *[float(step)] * (count - 1)]
