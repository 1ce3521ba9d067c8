"""Greedy forward selection of features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, Window as W, functions as F

from foldsmith.models.linear import cv_score, gram_by_fold
from foldsmith.models.parallel import side_by_side

Scorer = Callable[[list[str]], float]
LOG_SCHEMA = "round int, feature string, score double, delta double, decision string"


def linear_scorer(df: DataFrame, columns: Sequence[str], target: str, alpha: float = 0.0,
                  fold_col: str = "fold") -> Scorer:
    """Scores any subset of ``columns`` from one aggregate over the table."""
    gram = gram_by_fold(df, columns, target, fold_col)
    return lambda chosen: cv_score(gram, chosen, alpha)


class TreeScorer:
    """Scores any subset of ``candidates`` with a trainer: the candidates are read, coded and cached once, as one vector, and a
    subset is a slice of it. Of many rows the trainer's cells are cached, where they do. Use it as a context, or call ``close``."""

    def __init__(self, trainer, df: DataFrame, target: str, candidates: Sequence[str]):
        self.trainer, self.candidates = trainer, list(candidates)
        made = trainer.cell_scorer(df, target, self.candidates)
        self._score = trainer.score_cells if made else trainer.score_prepared
        self.stage, rows = made or trainer.prepared(df, target, self.candidates)
        if made:
            rows = rows.repartition(max(rows.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))
        self.rows = rows.persist()

    def __call__(self, chosen: list[str]) -> float:
        slicer = VectorSlicer(inputCol="__all", outputCol="features", indices=[self.candidates.index(c) for c in chosen])
        return self._score(slicer.transform(self.rows.withColumnRenamed("features", "__all")).drop("__all"), self.stage)

    def close(self) -> None:
        self.rows.unpersist()

    def __enter__(self) -> "TreeScorer":
        return self

    def __exit__(self, *error) -> None:
        self.close()


def tree_scorer(trainer, df: DataFrame, target: str, candidates: Sequence[str] | None = None) -> Scorer:
    """A scorer of feature subsets by cross-validated trees; with the list of candidates they are prepared only once."""
    if candidates is not None:
        return TreeScorer(trainer, df, target, candidates)
    return lambda chosen: trainer.train_and_score(df, target, chosen).score


def stored_log(spark, path: str) -> list[tuple]:
    """Rows of the rounds that a selection has kept below ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return [tuple(r) for r in spark.read.schema(LOG_SCHEMA).parquet(path).collect()]


def forward_select(all_features: Sequence[str], model_fn: Scorer, original_features: Sequence[str] = (),
                   initial_to_select: Sequence[str] = (), initial_to_discard: Sequence[str] = (),
                   max_features: int | None = None, stop_at_max_score: bool = True,
                   discard_worst_n: int = 0, spark=None, log_path: str | None = None, at_once: int = 1) -> tuple[list[str], list[tuple]]:
    """Add, round by round, the feature with the lowest score (scores are errors).

    Returns the selected features and a log with a row per scored candidate.  The worst
    ``discard_worst_n`` candidates of a round do not come back; without ``stop_at_max_score`` the
    rounds go on past the best score.

    ``at_once`` candidates of a round are scored side by side. With ``log_path`` (and ``spark``) each round's rows are
    appended to a table there, and a later call with the same settings takes the rounds found there over.
    """
    if log_path and spark is None:
        raise ValueError("log_path needs a session")
    kept: dict[int, dict[str, tuple]] = {}
    for row in stored_log(spark, log_path) if log_path else []:
        kept.setdefault(row[0], {})[row[1]] = row

    def store(rows: list[tuple]) -> None:
        if log_path:
            spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(log_path)

    selected = list(initial_to_select)
    pool = [f for f in all_features if f not in selected and f not in initial_to_discard]
    if -1 in kept:
        current = kept[-1]["baseline"][2]
    else:
        current = model_fn([*original_features, *selected]) if original_features or selected else None
        store([(-1, "baseline", current, None, "baseline")])
    log: list[tuple] = [(-1, "baseline", current, None, "baseline")]
    for n in range(len(pool) if max_features is None else max_features):
        if not pool:
            break
        if n in kept:
            if set(kept[n]) != set(pool):
                raise ValueError(f"{log_path} holds another selection: round {n} has candidates {sorted(kept[n])}")
            scores = {f: kept[n][f][2] for f in pool}
        else:
            jobs = [lambda f=f: model_fn([*original_features, *selected, f]) for f in pool]
            scores = dict(zip(pool, side_by_side(spark, jobs, at_once, "candidate") if spark is not None else [job() for job in jobs]))
        order = sorted(pool, key=lambda f: (scores[f], f))
        best = order[0]
        improves = current is None or scores[best] < current
        dropped = [f for f in order[1:][::-1][:discard_worst_n]]
        taken = improves or not stop_at_max_score
        rows = []
        for f in order:
            decision = "selected" if f == best and taken else "discarded" if f in dropped else "kept"
            rows.append((n, f, scores[f], None if current is None else scores[f] - current, decision))
        log += rows
        if n not in kept:
            store(rows)
        if not taken:
            break
        selected.append(best)
        current = scores[best]
        pool = [f for f in pool if f != best and f not in dropped]
    return selected, log


def log_frame(spark, log: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(log), LOG_SCHEMA)


def select_best_discard_worst(round_scores: DataFrame, n_discard: int = 1) -> DataFrame:
    """Mark the best candidate and the ``n_discard`` worst of each round; ties go by name.

    The table has a row per candidate and round, so a round is small.
    """
    best_first = W.partitionBy("round").orderBy("score", "feature")
    worst_first = W.partitionBy("round").orderBy(F.desc("score"), F.desc("feature"))
    return (round_scores.withColumns({"__b": F.row_number().over(best_first), "__w": F.row_number().over(worst_first)})
            .select("round", "feature", "score",
                    F.when(F.col("__b") == 1, "selected").when(F.col("__w") <= n_discard, "discarded")
                    .otherwise("kept").alias("decision")))
