"""Cross-validated boosted trees on Spark ML.

A run needs a frame with ``id``, the target and a fold column.  Out-of-fold rows are scored by models
that never saw them; test rows get the mean over the folds' models, or a refit on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.functions.scalar import bounded, nan_to_null
from foldsmith.models.boosting import boost, enough_rows, grow_drawn, joined, tree_weights
from foldsmith.models.parallel import side_by_side
from foldsmith.operators.metrics import auc, fold_mean_predictions, rmse, rmsle
from foldsmith.operators.sets import adversarial_frame
from foldsmith.operators.folds import kfold
from foldsmith.storage import drop_table, materialize, shuffles_dropped, write_buckets, write_table

# names used by common boosting libraries, accepted beside Spark's own
PARAM_NAMES = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
               "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy",
               "min_child_weight": "minInstancesPerNode", "max_bin": "maxBins", "random_state": "seed"}
# levels of a category that are told apart; the others are one level
LEVELS = 254
MISSING, OTHER = "(missing)", "(other)"
# up to so many rows trees are fitted on the rows themselves, above on one weighted row for all that are equal in all features
FEW_ROWS = 1 << 18
# with more of those, folds are fitted one after the other, as each fills the cluster
MANY_CELLS = 1 << 22
# runs that draw rows for each tree are fitted on cells if they are at most so large a part of the rows
CELLS_PER_ROW = 0.1
# scores that are the root of the mean squared gap between values so changed: sums of a cell give them
GAPS: dict[Callable, Callable[[Column], Column]] = {rmsle: F.log1p, rmse: lambda value: value}

FoldHook = Callable[[DataFrame, DataFrame, DataFrame, int], tuple[DataFrame, DataFrame, DataFrame]]


@dataclass
class RunResult:
    score: float
    best_iterations: list[int]
    oof: DataFrame
    test: DataFrame | None
    models: list = field(default_factory=list)


def spark_params(params: Mapping[str, object]) -> dict[str, object]:
    out = {PARAM_NAMES.get(k, k): v for k, v in params.items()}
    if "featureSubsetStrategy" in out:
        out["featureSubsetStrategy"] = str(out["featureSubsetStrategy"])
    return {"seed": 42, **out}


@dataclass
class Inputs:
    """How columns become one vector, fitted on training rows."""

    features: list[str]
    levels: dict[str, list[str]]
    missing: dict[str, float]

    @property
    def max_bins(self) -> int:
        """Bins that the trees need at least: one for each level of the widest category."""
        return max([32, *(len(v) + 2 for v in self.levels.values())])


def frequent_levels(df: DataFrame, columns: Sequence[str], limit: int, rows: str | None = None) -> dict[str, list[str]]:
    """The ``limit`` most frequent values of each column as text, equal counts by value.

    One pass counts the values of all columns, map-side combined; at most ``limit`` of a column reach the driver. ``rows`` names the
    column that tells how many rows one of ``df`` stands for.
    """
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]))
    one = (F.lit(1) if rows is None else F.col(rows)).cast("long").alias("__one")
    counts = materialize(df.select(pairs.alias("p"), one).where("p.v IS NOT NULL").groupBy("p.c", "p.v").agg(F.sum("__one").alias("n")))
    return {c: [r[0] for r in counts.where(F.col("c") == i).orderBy(F.desc("n"), "v").limit(limit).select("v").collect()]
            for i, c in enumerate(columns)}


def assembler(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = (), max_levels: int = LEVELS,
              rows: str | None = None) -> Inputs:
    """Fit the inputs: text and the columns named in ``categorical`` are categories, a missing number becomes one less than the
    column's least value.

    A category's levels are its ``max_levels`` most frequent values; rarer ones and those not seen in training are one
    level, missing ones another.
    """
    types = dict(df.select(*features).dtypes)
    nominal = [c for c in features if types[c] in ("string", "boolean") or c in categorical]
    numeric = [c for c in features if c not in nominal]
    least = df.agg(*[F.min(nan_to_null(F.col(c).cast("double"))).alias(c) for c in numeric]).first() if numeric else {}
    return Inputs(list(features), frequent_levels(df, nominal, max_levels, rows), {c: -1.0 if least[c] is None else least[c] - 1.0 for c in numeric})


def _coded(column: Column, levels: Sequence[str]) -> Column:
    text = column.cast("string")
    known = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, float(i + 2))])[text] if levels else F.lit(None).cast("double")
    return F.when(text.isNull(), 0.0).otherwise(F.coalesce(known, F.lit(1.0)))


def vectorised(df: DataFrame, stage: Inputs, keep: Sequence[str]) -> DataFrame:
    """The kept columns and the vector; the vector's metadata says which of its places are categories, so trees part their
    levels in any two sets and not by the order of their numbers."""
    kept = [c for c in keep if c in df.columns]
    inputs = []
    for c in stage.features:
        if c in stage.levels:
            values = [MISSING, OTHER, *stage.levels[c]]
            values = [f"{v}" if v not in values[:i] else f"{v} (value)" for i, v in enumerate(values)]
            about = {"ml_attr": {"type": "nominal", "name": f"__in_{c}", "vals": values}}
            inputs.append(_coded(F.col(f"__raw_{c}"), stage.levels[c]).alias(f"__in_{c}", metadata=about))
        else:
            inputs.append(F.coalesce(nan_to_null(F.col(f"__raw_{c}").cast("double")), F.lit(stage.missing[c])).alias(f"__in_{c}"))
    rows = df.select(*kept, *[F.col(c).alias(f"__raw_{c}") for c in stage.features]).select(*kept, *inputs)
    vector = VectorAssembler(inputCols=[f"__in_{c}" for c in stage.features], outputCol="features")
    return vector.transform(rows).select(*kept, "features")


def cells_of(df: DataFrame, features: Sequence[str], *sums: Column) -> DataFrame:
    """One row for all rows that are equal in all ``features``: how many they are (``__rows``) and ``sums`` over them, written once.

    Trees of squared loss (or of a label that is among the features) see only counts and sums of the rows in a node, so they come out of
    these as they come out of the rows.
    """
    return write_table(df.groupBy(*dict.fromkeys(features)).agg(F.count(F.lit(1)).alias("__rows"), *sums), "cells")


def stored_rows(train: DataFrame, features: Sequence[str], columns: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """The ``columns`` and ``features`` of ``train`` written once for runs to share, in a folder per fold; the caller may drop them after the last run.

    Rows that are equal in all features lie together (frequent ones in several files), so that sums over them hardly need a shuffle.
    """
    features = [*dict.fromkeys(features)]
    rows = train.select(*dict.fromkeys([*columns, *features, fold_col]))
    return write_table(rows.hint("rebalance", *features).sortWithinPartitions(fold_col, *features), "train", [fold_col])


@contextmanager
def cached(*frames: DataFrame):
    """Training rows dealt evenly over at least all cores and kept for the many passes of a fit."""
    held = []
    try:
        for df in frames:
            parts = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
            held.append(df.repartition(parts).persist())
        yield held
    finally:
        for df in held:
            df.unpersist()


class CVTrainer:
    """Settings of a run; ``train_and_score`` and ``train_on_full`` may be called with different data."""

    def __init__(self, params: Mapping[str, object], scoring_fn: Callable[[Column, Column], Column] = rmsle,
                 log_transform_targets: bool = True, clip_preds: tuple[float | None, float | None] = (None, None),
                 early_stop: bool = False, early_stop_tol: float = 0.0, early_stop_rounds: int | None = None,
                 eval_metric: Callable[[Column, Column], Column] | None = None, n_splits: int = 5, fold_col: str = "fold",
                 weight_col: str | None = None, outlier_ids: DataFrame | None = None,
                 fn_modify_fold_data: FoldHook | None = None, categorical: Sequence[str] = (), folds_at_once: int = 4,
                 chunk: int = 10):
        self.params, self.scoring_fn = spark_params(params), scoring_fn
        self.log, self.clip, self.n_splits, self.fold_col = log_transform_targets, clip_preds, n_splits, fold_col
        self.early_stop, self.tol, self.rounds = early_stop, early_stop_tol, early_stop_rounds
        self.eval_metric = eval_metric or scoring_fn
        self.categorical, self.folds_at_once, self.chunk = list(categorical), folds_at_once, chunk
        self.curves: list[list[float]] = []
        self.fitted: list[int] = []
        self.weight_col, self.outlier_ids, self.hook = weight_col, outlier_ids, fn_modify_fold_data

    @property
    def stops_early(self) -> bool:
        return bool(self.early_stop or self.rounds)

    def _inputs(self, df: DataFrame, features: Sequence[str]) -> Inputs:
        return assembler(df, features, self.categorical)

    def _options(self, stage: Inputs) -> dict[str, object]:
        return {**self.params, "maxBins": max(int(self.params.get("maxBins", 32)), stage.max_bins)}

    def _learner(self, stage: Inputs, validate: bool, weight_col: str | None = None, **override) -> GBTRegressor:
        options = {**self._options(stage), **override}
        if weight_col := weight_col or self.weight_col:
            options["weightCol"] = weight_col
        if validate:
            options.update(validationIndicatorCol="__val", validationTol=self.tol)
        return GBTRegressor(featuresCol="features", labelCol="__label", predictionCol="__raw", **options)

    def _label(self, df: DataFrame, target: str) -> DataFrame:
        y = F.col(target).cast("double")
        return df.withColumn("__label", F.log1p(y) if self.log else y)

    def _prediction(self, raw: Column) -> Column:
        return bounded(F.expm1(raw) if self.log else raw, *self.clip)

    def _fit_rows(self, df: DataFrame) -> DataFrame:
        if self.outlier_ids is None:
            return df
        return df.join(self.outlier_ids.select("id"), "id", "left_anti")

    # -- cells: sums over the rows that are equal in all features ------------------------------------

    def _cells_do(self) -> bool:
        """Whether the trees need no more of the rows than weighted sums: not where rows are drawn, counted or compared one by one."""
        own = self.params
        return (bool(self.rounds) or not self.early_stop) and str(own.get("lossType", "squared")) == "squared" and float(
            own.get("subsamplingRate", 1.0)) >= 1.0 and int(own.get("minInstancesPerNode", 1)) <= 1

    def _source(self, train: DataFrame, target: str, features: Sequence[str]) -> DataFrame | None:
        """The columns of a run written once, as all passes read them; None where the rows are few or cells do not do."""
        if not self._cells_do():
            return None
        names = dict.fromkeys(["id", target, self.fold_col, *([self.weight_col] if self.weight_col else []), *features])
        source = write_table(train.select(*names), "train")
        if source.count() > FEW_ROWS:
            return source
        drop_table(source)
        return None

    def _cells(self, df: DataFrame, target: str, features: Sequence[str], fits: Mapping[object, Column], held: Mapping[object, Column]) -> DataFrame:
        """Cells of ``df``: for each of ``fits`` (rows to fit on, outliers apart) the weight ``__n`` and the weighted sum of labels ``__s``,
        for each of ``held`` the count ``__c``, mean ``__m`` and squared deviations ``__q`` of the values that the score compares."""
        y = F.col(target).cast("double")
        label, weight = F.log1p(y) if self.log else y, F.col(self.weight_col).cast("double") if self.weight_col else F.lit(1.0)
        kept = F.lit(True)
        if self.outlier_ids is not None:
            df = df.join(self.outlier_ids.select("id").distinct().withColumn("__out", F.lit(True)), "id", "left")
            kept = F.col("__out").isNull()
        sound = label.isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf")) & (weight >= 0) & (weight < float("inf"))
        used = reduce(lambda a, b: a | b, fits.values(), F.lit(False))
        sums = [F.count_if(used & kept & ~F.coalesce(sound, F.lit(False))).alias("__unsound")]
        for k, inside in fits.items():
            sums += [F.sum(F.when(inside & kept, weight)).alias(f"__n{k}"), F.sum(F.when(inside & kept, weight * label)).alias(f"__s{k}")]
        if held:
            compared = GAPS[self.eval_metric](y)
            for k, inside in held.items():
                value = F.when(inside, compared)
                sums += [F.count(value).cast("double").alias(f"__c{k}"), F.avg(value).alias(f"__m{k}"),
                         (F.var_pop(value) * F.count(value)).alias(f"__q{k}")]
        cells = cells_of(df, features, *sums)
        if cells.agg(F.sum("__unsound")).first()[0]:
            raise ValueError("labels must not be missing or infinite, and weights not missing, infinite or negative")
        return cells

    def _cell_inputs(self, cells: DataFrame, features: Sequence[str]) -> tuple[Inputs, DataFrame]:
        """The fitted inputs and the cells' vectors beside their sums."""
        stage = assembler(cells, features, self.categorical, rows="__rows")
        return stage, vectorised(cells, stage, [c for c in cells.columns if c not in features])

    def _cell_fit(self, data: DataFrame, k: object) -> DataFrame:
        weight = F.col(f"__n{k}")
        return data.where(weight > 0).select("features", (F.col(f"__s{k}") / weight).alias("__label"), weight.alias("__weight"))

    def _cell_held(self, data: DataFrame, k: object) -> DataFrame:
        return data.where(F.col(f"__c{k}") > 0).select("features", *[F.col(f"__{f}{k}").alias(f"__{f}") for f in "cmq"])

    def _cell_error(self, total: str) -> Column:
        """Aggregate over held-out cells: the score's mean squared gap with the predictions of the boosted sum ``total``."""
        gap = F.col("__m") - GAPS[self.eval_metric](self._prediction(F.col(total)))
        return F.sum(F.col("__q") + F.col("__c") * gap * gap) / F.sum("__c")

    def _folds_but(self) -> dict[int, Column]:
        return {k: F.col(self.fold_col) != k for k in range(self.n_splits)}

    def _folds(self) -> dict[int, Column]:
        return {k: F.col(self.fold_col) == k for k in range(self.n_splits)}

    def _width(self, cells: DataFrame) -> int:
        return self.folds_at_once if cells.count() <= MANY_CELLS else 1

    def _fit_cells(self, stage: Inputs, fit: DataFrame, held: DataFrame | None, val: DataFrame | None) -> tuple:
        """`_fit` on cells; the errors of a run that stops early come from the held-out cells, or from the rows of ``val`` if there are none."""
        fit = enough_rows(fit, "__weight")
        if not self.rounds:
            model = self._learner(stage, False, "__weight").fit(fit)
            return model, [], model.getNumTrees
        evaluate = (lambda total: self.eval_metric(F.col("y"), self._prediction(F.col(total)))) if held is None else (
            lambda total: F.sqrt(self._cell_error(total)))
        found = boost(fit, val if held is None else held, self._options(stage), self.rounds, evaluate, "__weight", self.chunk)
        return found.model, found.curve, found.fitted

    def cell_scorer(self, train: DataFrame, target: str, features: Sequence[str]) -> tuple[Inputs, DataFrame] | None:
        """Inputs and cells from which `score_cells` scores any of ``features``; None where the rows are few or cells do not do."""
        if not self._cells_do() or self.scoring_fn not in GAPS or self.eval_metric is not self.scoring_fn:
            return None
        cells = self._cells(train, target, features, self._folds_but(), self._folds())
        if cells.agg(F.sum("__rows")).first()[0] <= FEW_ROWS:
            drop_table(cells)
            return None
        return self._cell_inputs(cells, features)

    def _scored_cells(self, data: DataFrame, stage: Inputs, k: int) -> DataFrame:
        held = self._cell_held(data, k)
        model = self._fit_cells(stage, self._cell_fit(data, k), held, None)[0]
        return model.transform(held).select("__c", "__m", "__q", "__raw")

    def score_cells(self, data: DataFrame, stage: Inputs) -> float:
        """The cross-validated score on cells made by `cell_scorer`, also with some of their features only."""
        parts = side_by_side(data.sparkSession, [lambda k=k: self._scored_cells(data, stage, k) for k in range(self.n_splits)], self.folds_at_once, "fold")
        return float(reduce(DataFrame.unionByName, parts).agg(F.sqrt(self._cell_error("__raw"))).first()[0])

    def _run_on_cells(self, source: DataFrame, target: str, features: Sequence[str], test: DataFrame | None) -> tuple:
        rows = source.withColumn("y", F.col(target).cast("double"))
        on_cells = bool(self.rounds) and self.eval_metric in GAPS
        cells = self._cells(rows, target, features, self._folds_but(), self._folds() if on_cells else {})
        stage, vectors = self._cell_inputs(cells, features)
        held_out = {k: vectorised(rows.where(fold), stage, ["id", "y"]) for k, fold in self._folds().items()}
        with cached(vectors) as (data,):
            jobs = [lambda k=k: self._fit_cells(stage, self._cell_fit(data, k), self._cell_held(data, k) if on_cells else None, held_out[k])
                    for k in range(self.n_splits)]
            fits = side_by_side(source.sparkSession, jobs, self._width(cells), "fold")
        scored = [model.transform(held_out[k]).select("id", "y", self._prediction(F.col("__raw")).alias("pred")) for k, (model, *_) in enumerate(fits)]
        oof = write_table(reduce(DataFrame.unionByName, scored), "oof")
        drop_table(cells)
        return oof, None if test is None else self._mean_over_models(test, stage, [f[0] for f in fits]), fits

    # -- cells of runs that draw rows for each tree --------------------------------------------------

    def _drawn_cells_do(self) -> bool:
        """Whether the trees need no more than weighted sums of the rows drawn for each."""
        own = self.params
        return not self.stops_early and str(own.get("lossType", "squared")) == "squared" and 0.0 < float(
            own.get("subsamplingRate", 1.0)) < 1.0 and int(own.get("minInstancesPerNode", 1)) <= 1

    def _drawn_source(self, train: DataFrame, target: str, features: Sequence[str]) -> DataFrame | None:
        """The columns of a run that draws rows, stored (by the caller, or here); None where the rows are few or hardly two are equal in all features."""
        if not self._drawn_cells_do():
            return None
        stored = "scratch" in vars(train)
        source = train if stored else stored_rows(train, features, ["id", target, *([self.weight_col] if self.weight_col else [])], self.fold_col)
        if (rows := source.count()) > FEW_ROWS:
            cells = source.agg(F.approx_count_distinct(F.xxhash64(*dict.fromkeys(features)))).first()[0]
            if cells <= min(MANY_CELLS, CELLS_PER_ROW * rows):
                return source
        if not stored:
            drop_table(source)
        return None

    def _drawn(self, tree: int) -> Column:
        """Whether a row is drawn for a tree: by a hash of seed, tree and id, so not by how the rows are laid out."""
        cut = int(float(self.params["subsamplingRate"]) * 2 ** 64) - 2 ** 63
        return F.xxhash64(F.lit(int(self.params["seed"]) + tree), F.col("id")) < F.lit(cut).cast("long")

    def _run_on_drawn_cells(self, source: DataFrame, target: str, features: Sequence[str], test: DataFrame | None) -> tuple:
        """A run whose trees are fitted each on its own drawn rows, summed up per cell and fold.

        Out-of-fold predictions are worked out as they are read, from ``source``. The score of all held-out rows comes from the cells' sums
        where these give it, else from the predictions.
        """
        rows, names = source.withColumn("y", F.col(target).cast("double")), [*dict.fromkeys(features)]
        every, most = F.col(self.fold_col).isNotNull(), int(self.params.get("maxIter", 20))
        grown: list[list] = [[] for _ in range(self.n_splits)]
        summed = self.scoring_fn in GAPS and self.eval_metric is self.scoring_fn
        stage = held = None
        for first in range(0, most, self.chunk):
            trees = range(first, min(first + self.chunk, most))
            cells = self._cells(rows, target, [*names, self.fold_col], {"": every, **{f"_{n}": self._drawn(n) for n in trees}},
                                {"": every} if summed and not first else {})
            if not first:
                stage, held = assembler(cells, features, self.categorical, rows="__rows"), cells
            fits = F.explode(F.filter(F.array(*map(F.lit, range(self.n_splits))), lambda k: k != F.col(self.fold_col)))
            sums = [f"__{x}_{n}" for n in trees for x in "ns"]
            table = write_table(cells.select(*names, fits.alias("__fit"), *sums).groupBy(*names, "__fit").agg(*[F.sum(c).alias(c) for c in sums]), "drawn", ["__fit"])

            def grow(k: int) -> None:
                with cached(vectorised(table.where(F.col("__fit") == k), stage, sums)) as (data,):
                    grow_drawn(data, self._options(stage), grown[k], trees)

            side_by_side(source.sparkSession, [lambda k=k: grow(k) for k in range(self.n_splits)], self.folds_at_once, "fold")
            for done in (table, *([cells] if first else [])):
                drop_table(done)
        weights = tree_weights(most, self.params.get("stepSize", 0.1))
        models = [joined(trees, weights, trees[0].numFeatures) for trees in grown]
        scored = [model.transform(vectorised(rows.where(fold), stage, ["id", "y"])).select("id", "y", self._prediction(F.col("__raw")).alias("pred"))
                  for model, fold in zip(models, self._folds().values())]
        oof = reduce(DataFrame.unionByName, scored)
        if summed:
            gaps = [model.transform(self._cell_held(vectorised(held.where(fold), stage, held.columns), "")).select("__c", "__m", "__q", "__raw")
                    for model, fold in zip(models, self._folds().values())]
            score = reduce(DataFrame.unionByName, gaps).agg(F.sqrt(self._cell_error("__raw"))).first()[0]
        else:
            score = oof.agg(self.scoring_fn(F.col("y"), F.col("pred"))).first()[0]
        drop_table(held)
        return oof, None if test is None else self._mean_over_models(test, stage, models), [(model, [], most) for model in models], score

    def _fit(self, stage: Inputs, fit: DataFrame, val: DataFrame) -> tuple:
        """One fold's (model, error curve, number of trees fitted).

        With ``early_stop_rounds`` trees are added in chunks until so many iterations bring no lower error of the validation rows by
        ``eval_metric`` (default: the run's score), and the model ends at the best one.
        """
        if self.rounds:
            found = boost(fit, val, self._options(stage), self.rounds, lambda total: self.eval_metric(F.col("y"), self._prediction(F.col(total))),
                          self.weight_col, self.chunk)
            return found.model, found.curve, found.fitted
        if not self.early_stop:
            model = self._learner(stage, False).fit(fit)
        else:
            rows = fit.withColumn("__val", F.lit(False)).unionByName(val.withColumn("__val", F.lit(True)))
            model = self._learner(stage, True).fit(rows)
        return model, [], model.getNumTrees

    def train_and_score(self, train: DataFrame, target: str, features: Sequence[str],
                        test: DataFrame | None = None) -> RunResult:
        """Out-of-fold predictions of train, mean test predictions, and the overall score.

        Folds are fitted side by side. ``curves`` and ``fitted`` then hold each fold's validation errors (with
        ``early_stop_rounds``) and number of trees.
        """
        run = self._shared_frame if self.hook is None else self._frame_per_fold
        oof, test_out, fits, *known = run(train, target, list(features), test)
        models, self.curves, self.fitted = ([f[i] for f in fits] for i in range(3))
        score = known[0] if known else oof.agg(self.scoring_fn(F.col("y"), F.col("pred"))).first()[0]
        return RunResult(score, [m.getNumTrees for m in models], oof, test_out, models)

    def prepared(self, train: DataFrame, target: str, features: Sequence[str]) -> tuple[Inputs, DataFrame]:
        """The fitted inputs and the rows ready for fits: id, target, label, fold, weight and the vector of ``features``."""
        stage = self._inputs(train, list(features))
        return stage, vectorised(self._label(train.withColumn("y", F.col(target).cast("double")), target), stage, self._columns())

    def _scored(self, data: DataFrame, stage: Inputs, k: int) -> DataFrame:
        val = data.filter(F.col(self.fold_col) == k)
        model = self._fit(stage, self._fit_rows(data.filter(F.col(self.fold_col) != k)), val)[0]
        return model.transform(val).select("y", self._prediction(F.col("__raw")).alias("pred"))

    def score_prepared(self, data: DataFrame, stage: Inputs) -> float:
        """The cross-validated score on rows made by `prepared`, also with some of their features only."""
        parts = side_by_side(data.sparkSession, [lambda k=k: self._scored(data, stage, k) for k in range(self.n_splits)], self.folds_at_once, "fold")
        return float(reduce(DataFrame.unionByName, parts).agg(self.scoring_fn(F.col("y"), F.col("pred"))).first()[0])

    def score_by_fold(self, train: DataFrame, target: str, features: Sequence[str], report: Callable[[float], None]) -> float:
        """The score of all folds' rows; folds run one after the other, and ``report`` gets each fold's own error and may raise."""
        if made := self.cell_scorer(train, target, list(features)):
            with cached(made[1]) as (data,):
                parts = []
                for k in range(self.n_splits):
                    parts.append(self._scored_cells(data, made[0], k))
                    report(float(parts[-1].agg(F.sqrt(self._cell_error("__raw"))).first()[0]))
                return float(reduce(DataFrame.unionByName, parts).agg(F.sqrt(self._cell_error("__raw"))).first()[0])
        stage, rows = self.prepared(train, target, features)
        with cached(rows) as (data,):
            parts = []
            for k in range(self.n_splits):
                parts.append(self._scored(data, stage, k))
                report(float(parts[-1].agg(self.scoring_fn(F.col("y"), F.col("pred"))).first()[0]))
            return float(reduce(DataFrame.unionByName, parts).agg(self.scoring_fn(F.col("y"), F.col("pred"))).first()[0])

    def _columns(self, extra: Sequence[str] = ()) -> list[str]:
        return ["id", "y", "__label", self.fold_col, *([self.weight_col] if self.weight_col else []), *extra]

    def _shared_frame(self, train, target, features, test):
        if (source := self._source(train, target, features)) is not None:
            try:
                return self._run_on_cells(source, target, features, test)
            finally:
                drop_table(source)
        if (source := self._drawn_source(train, target, features)) is not None:
            return self._run_on_drawn_cells(source, target, features, test)
        stage, rows = self.prepared(train, target, features)
        with cached(rows) as (data,):
            held_out = [data.filter(F.col(self.fold_col) == k) for k in range(self.n_splits)]
            jobs = [lambda k=k: self._fit(stage, self._fit_rows(data.filter(F.col(self.fold_col) != k)), held_out[k]) for k in range(self.n_splits)]
            fits = side_by_side(train.sparkSession, jobs, self.folds_at_once, "fold")
            scored = [model.transform(val).select("id", "y", self._prediction(F.col("__raw")).alias("pred"))
                      for (model, *_), val in zip(fits, held_out)]
            oof = materialize(reduce(DataFrame.unionByName, scored))
        return oof, None if test is None else self._mean_over_models(test, stage, [f[0] for f in fits]), fits

    def _mean_over_models(self, test, stage, models) -> DataFrame:
        """All models score a row side by side, so the mean over folds needs no shuffle."""
        rows = vectorised(test, stage, ["id"])
        for k, model in enumerate(models):
            rows = model.transform(rows).withColumn(f"__p{k}", self._prediction(F.col("__raw"))).drop("__raw")
        total = sum((F.col(f"__p{k}") for k in range(len(models))), F.lit(0.0))
        return rows.select("id", (total / F.lit(float(len(models)))).alias("pred"))

    def _frame_per_fold(self, train, target, features, test):
        train = train.withColumn("y", F.col(target).cast("double"))

        def prepared(k):  # hooks are the caller's code and run one after the other
            fold = F.col(self.fold_col) == k
            return self.hook(train.filter(~fold), train.filter(fold), test, k)

        def summed(parts):
            """Cells of a fold's rows; None where the rows are few or cells do not do."""
            if not self._cells_do():
                return None
            cells = self._cells(parts[0], target, features, {"": F.lit(True)}, {})
            if cells.agg(F.sum("__rows")).first()[0] > FEW_ROWS:
                return cells
            drop_table(cells)
            return None

        def run(parts, cells):
            if cells is not None:
                return run_on_cells(parts, cells)
            stage = self._inputs(parts[0], features)
            fit, val = (vectorised(self._label(p, target), stage, self._columns()) for p in parts[:2])
            with cached(self._fit_rows(fit), val) as (fit, val):
                found = self._fit(stage, fit, val)
                scored = materialize(found[0].transform(val).select("id", "y", self._prediction(F.col("__raw")).alias("pred")))
            tested = None if test is None else found[0].transform(vectorised(parts[2], stage, ["id"])).select(
                "id", self._prediction(F.col("__raw")).alias("pred"))
            return found, scored, tested

        def run_on_cells(parts, cells):
            on_cells = bool(self.rounds) and self.eval_metric in GAPS
            stage, vectors = self._cell_inputs(cells, features)
            val = parts[1].select(*dict.fromkeys(["id", "y", *features]))
            if self.rounds:  # else it is read once
                val = write_table(val, "val")
            rows = vectorised(val, stage, ["id", "y"])
            held = self._cells(val, "y", features, {}, {"": F.lit(True)}) if on_cells else None
            with cached(vectors) as (data,):
                found = self._fit_cells(stage, self._cell_fit(data, ""), self._cell_held(vectorised(held, stage, held.columns), "") if on_cells else None, rows)
            scored = found[0].transform(rows).select("id", "y", self._prediction(F.col("__raw")).alias("pred"))
            if self.rounds:
                scored = write_table(scored, "oof")
            for table in (cells, *([val] if self.rounds else []), *([held] if on_cells else [])):
                drop_table(table)
            tested = None if test is None else found[0].transform(vectorised(parts[2], stage, ["id"])).select(
                "id", self._prediction(F.col("__raw")).alias("pred"))
            return found, scored, tested

        every = [prepared(k) for k in range(self.n_splits)]
        with shuffles_dropped(train.sparkSession):  # of all rows, so one fold after the other; each fills the cluster
            cells = [summed(p) for p in every]
        runs = side_by_side(train.sparkSession, [lambda p=p, c=c: run(p, c) for p, c in zip(every, cells)], self.folds_at_once, "fold")
        parts, tests = [r[1] for r in runs], [r[2] for r in runs if r[2] is not None]
        large = all(c is not None for c in cells)
        oof = write_buckets(parts[0], "oof", more=parts[1:]) if large and not self.rounds else reduce(DataFrame.unionByName, parts)
        if large and tests:
            tests = [write_buckets(tests[0], "tested", more=tests[1:])]
        return oof, fold_mean_predictions(reduce(DataFrame.unionByName, tests)) if tests else None, [r[0] for r in runs]

    def train_on_full(self, train: DataFrame, target: str, features: Sequence[str], test: DataFrame,
                      best_iterations: Sequence[int] | None = None, factor: float = 1.2) -> DataFrame:
        """Refit on all rows with ``factor`` times the mean best iteration, and predict test."""
        features = list(features)
        trees = {} if not best_iterations else {"maxIter": max(1, int(sum(best_iterations) / len(best_iterations) * factor))}
        cells = self._cells(train, target, features, {"": F.lit(True)}, {}) if self._cells_do() else None
        if cells is not None and cells.agg(F.sum("__rows")).first()[0] > FEW_ROWS:
            stage, vectors = self._cell_inputs(cells, features)
            with cached(self._cell_fit(vectors, "")) as (data,):
                model = self._learner(stage, False, "__weight", **trees).fit(enough_rows(data, "__weight"))
        else:
            stage = self._inputs(train, features)
            rows = vectorised(self._label(train, target), stage, self._columns())
            with cached(self._fit_rows(rows)) as (data,):
                model = self._learner(stage, False, **trees).fit(data)
        self.refit_trees = model.getNumTrees
        return model.transform(vectorised(test, stage, ["id"])).select(
            "id", self._prediction(F.col("__raw")).alias("pred"))


def early_stopping(trainer: CVTrainer, train: DataFrame, target: str, features: Sequence[str],
                   rounds: int) -> list[tuple[int, int, int, float]]:
    """(fold, best iteration, trees fitted, validation error) of a run that stops after ``rounds`` iterations without a gain."""
    trainer.rounds = rounds
    run = trainer.train_and_score(train, target, features)
    return [(k, n, trainer.fitted[k], trainer.curves[k][n - 1]) for k, n in enumerate(run.best_iterations)]


def with_folded_features(folded: DataFrame, columns: Sequence[str]) -> FoldHook:
    """Fold hook that brings each fold's own encoded columns to its train, validation and test part.

    ``folded`` is read once per fold and part: pass a stored table in folders of both (the feature
    store's, or `write_table` by them), so that a read takes its own rows alone. With `write_buckets` for it and the run's frames
    no join shuffles.
    """
    def attach_part(df: DataFrame, fold: int, part: str) -> DataFrame:
        rows = folded.filter((F.col("outer_fold") == fold) & (F.col("part") == part)).select("id", *columns)
        return df.join(rows, "id")

    def hook(train, val, test, fold):
        return (attach_part(train, fold, "train"), attach_part(val, fold, "val"),
                None if test is None else attach_part(test, fold, "test"))
    return hook


def cv_by_segment(trainer: CVTrainer, train: DataFrame, target: str, features: Sequence[str], cat: str,
                  values: Sequence[object] | None = None, test: DataFrame | None = None) -> RunResult:
    """A separate run per category value, NULL being one; predictions are stacked and scored together.

    ``values`` defaults to all of train's.  A row whose value is not among them is an error, as it would get no
    prediction.
    """
    if values is None:
        values = [r[0] for r in train.select(cat).distinct().orderBy(cat).collect()]
    own = [F.col(cat).eqNullSafe(F.lit(v)) for v in values]
    listed = reduce(lambda a, b: a | b, own, F.lit(False))
    for df in (train, test):
        if df is not None and (stray := df.filter(~listed).select(cat).first()):
            raise ValueError(f"no run for {cat} = {stray[0]!r}")
    runs = [trainer.train_and_score(train.filter(v), target, features, None if test is None else test.filter(v)) for v in own]
    oof = reduce(DataFrame.unionByName, [r.oof for r in runs])
    out = None if test is None else reduce(DataFrame.unionByName, [r.test for r in runs])
    score = oof.agg(trainer.scoring_fn(F.col("y"), F.col("pred"))).first()[0]
    return RunResult(score, [n for r in runs for n in r.best_iterations], oof, out, [m for r in runs for m in r.models])


def two_round_outlier_fit(trainer: CVTrainer, train: DataFrame, target: str, features: Sequence[str],
                          test: DataFrame | None = None, q: float = 0.99) -> tuple[RunResult, RunResult, DataFrame]:
    """Fit, leave the rows with the largest out-of-fold errors out of training, fit again."""
    from foldsmith.functions.scalar import residual_filter

    first = trainer.train_and_score(train, target, features, test)
    outliers = write_table(residual_filter(first.oof, "pred", "y", q), "outliers")
    previous, trainer.outlier_ids = trainer.outlier_ids, outliers
    try:
        second = trainer.train_and_score(train, target, features, test)
    finally:
        trainer.outlier_ids = previous
    return first, second, outliers


def predict_mean_std(trainer: CVTrainer, train: DataFrame, target: str, features: Sequence[str],
                     test: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Mean and standard deviation per row: a second run fits the log squared out-of-fold residual.

    The mean of a logarithm lies below the logarithm of the mean, so variances are scaled until the squared out-of-fold
    residual is, on average, one variance.
    """
    mean_run = trainer.train_and_score(train, target, features, test)
    gap = F.col("y") - F.col("pred")
    residual = mean_run.oof.select("id", F.log(gap * gap + F.lit(1e-12)).alias("__log_var"), F.col("pred").alias("__mean"))
    var_trainer = CVTrainer(trainer.params, log_transform_targets=False, scoring_fn=lambda y, p: F.avg((y - p) * (y - p)),
                            n_splits=trainer.n_splits, fold_col=trainer.fold_col)
    var_run = var_trainer.train_and_score(train.join(residual.select("id", "__log_var"), "id"), "__log_var", features, test)

    ratio = F.exp(F.col("y") - F.col("pred"))  # y is the log squared residual, pred the log variance
    scale = var_run.oof.agg(F.avg(ratio)).first()[0]

    def joined(means: DataFrame, logs: DataFrame) -> DataFrame:
        std = F.sqrt(F.exp("pred") * F.lit(float(scale)))
        return means.select("id", "pred").join(logs.select("id", std.alias("pred_std")), "id")

    return joined(mean_run.oof, var_run.oof), joined(mean_run.test, var_run.test), mean_run.score


def feature_importances(models: Sequence, features: Sequence[str], spark) -> DataFrame:
    """Mean importance over the folds' models."""
    means = [float(sum(m.featureImportances[i] for m in models) / len(models)) for i in range(len(features))]
    return spark.createDataFrame(list(zip(features, means)), "feature string, importance double")


def importance_top_k(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def adversarial_validation(train: DataFrame, test: DataFrame, features: Sequence[str], params: Mapping[str, object],
                           n_splits: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classifier of train against test rows: (auc, importances, out-of-fold scores)."""
    features = list(features)
    rows = kfold(adversarial_frame(train.select("id", *features), test.select("id", *features)), n_splits, seed)
    options, spark = spark_params(params), rows.sparkSession
    source = write_table(rows, "adversarial")

    def learner(stage: Inputs, **more) -> GBTClassifier:
        bins = max(int(options.get("maxBins", 32)), stage.max_bins)
        return GBTClassifier(featuresCol="features", labelCol="label", **{**options, "maxBins": bins, **more})

    def scored(models: Sequence, held_out: Sequence[DataFrame]) -> DataFrame:
        parts = [model.transform(val).select("id", "label", vector_to_array("probability")[1].alias("score")) for model, val in zip(models, held_out)]
        return write_table(reduce(DataFrame.unionByName, parts), "adversarial-oof")

    drawn = float(options.get("subsamplingRate", 1.0)) < 1.0 or int(options.get("minInstancesPerNode", 1)) > 1
    if drawn or source.count() <= FEW_ROWS:
        stage = assembler(rows, features)
        with cached(vectorised(rows, stage, ["id", "label", "fold"])) as (data,):
            jobs = [lambda k=k: learner(stage).fit(data.filter(F.col("fold") != k)) for k in range(n_splits)]
            models = side_by_side(spark, jobs, 4, "fold")
            oof = scored(models, [data.filter(F.col("fold") == k) for k in range(n_splits)])
    else:  # rows equal in label and features are one weighted row
        cells = cells_of(source, [*features, "label"], *[F.count_if(F.col("fold") != k).cast("double").alias(f"__n{k}") for k in range(n_splits)])
        stage = assembler(cells, features, rows="__rows")
        with cached(vectorised(cells, stage, ["label", *[f"__n{k}" for k in range(n_splits)]])) as (data,):
            jobs = [lambda k=k: learner(stage, weightCol=f"__n{k}").fit(enough_rows(data.where(F.col(f"__n{k}") > 0), f"__n{k}")) for k in range(n_splits)]
            models = side_by_side(spark, jobs, 4 if cells.count() <= MANY_CELLS else 1, "fold")
        oof = scored(models, [vectorised(source.where(F.col("fold") == k), stage, ["id", "label"]) for k in range(n_splits)])
        drop_table(cells)
    drop_table(source)
    return auc(oof, "label", "score"), feature_importances(models, features, spark), oof
