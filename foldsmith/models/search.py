"""Random search over boosting parameters: trials side by side, kept in a table that a later call goes on from."""

from __future__ import annotations

import hashlib
import inspect
import math
import threading
import time
from collections.abc import Callable, Mapping, Sequence
from statistics import mean, median

from pyspark.sql import DataFrame, SparkSession

from foldsmith.models.parallel import side_by_side

SCHEMA = "trial int, state string, score double, params map<string,string>, seconds double, error string, reports array<double>"
DONE, FAILED, PRUNED = "done", "failed", "pruned"


class Pruned(Exception):
    """A trial that is worse than the median of those before it, at the same step."""


def draw(space: Mapping[str, tuple], trial: int, seed: int = 42) -> dict[str, object]:
    """Parameters of one trial: ``("int", lo, hi)``, ``("float", lo, hi)``, ``("log", lo, hi)`` or
    ``("choice", [...])``; each draw depends on seed, trial and name only."""
    out: dict[str, object] = {}
    for name, spec in space.items():
        u = int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) / 2 ** 32
        kind = spec[0]
        if kind == "int":
            out[name] = spec[1] + int(u * (spec[2] - spec[1] + 1))
        elif kind == "float":
            out[name] = spec[1] + u * (spec[2] - spec[1])
        elif kind == "log":
            out[name] = math.exp(math.log(spec[1]) + u * (math.log(spec[2]) - math.log(spec[1])))
        elif kind == "choice":
            out[name] = spec[1][int(u * len(spec[1]))]
        else:
            raise ValueError(f"unknown range {kind!r}")
    return out


def stored_trials(spark: SparkSession, path: str) -> list:
    """Rows of the trials that a search has kept below ``path``; none if there is no such table yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(SCHEMA).parquet(path).orderBy("trial").collect()


def param_search(spark: SparkSession, objective: Callable[..., float], space: Mapping[str, tuple], n_trials: int,
                 timeout: float | None = None, direction: str = "minimize", seed: int = 42, path: str | None = None, at_once: int = 1,
                 warm_up: int = 4) -> tuple[dict, DataFrame]:
    """Best parameters and a row per trial; no trial starts after ``timeout`` seconds.

    ``at_once`` trials run side by side. With ``path`` each trial is appended to a table there as it ends, and a later call with the
    same space and seed takes those over and runs the others; its draws are the same, as they depend on the trial's number. A
    trial that raises is kept as failed, with its error, and passed over. An objective with a second parameter is given
    ``report(value)`` to call after each of its steps (folds): once ``warm_up`` trials are done, a trial whose mean so far is worse
    than the median of theirs after as many steps is dropped.
    """
    started, sign, lock = time.monotonic(), 1.0 if direction == "minimize" else -1.0, threading.Lock()
    rows: dict[int, tuple] = {r["trial"]: tuple(r) for r in (stored_trials(spark, path) if path else [])}
    for trial, row in rows.items():
        if trial < n_trials and row[3] != {k: str(v) for k, v in draw(space, trial, seed).items()}:
            raise ValueError(f"{path} holds another search: trial {trial} has parameters {row[3]}")
    reporting = len(inspect.signature(objective).parameters) > 1

    def hopeless(reports: Sequence[float]) -> bool:
        n = len(reports)
        with lock:
            others = [sign * mean(r[6][:n]) for r in rows.values() if r[1] == DONE and len(r[6]) >= n]
        return len(others) >= warm_up and sign * mean(reports) > median(others)

    def run(trial: int) -> None:
        if timeout is not None and time.monotonic() - started > timeout:
            return
        params, t0 = draw(space, trial, seed), time.monotonic()
        reports: list[float] = []

        def report(value: float) -> None:
            reports.append(float(value))
            if hopeless(reports):
                raise Pruned

        state, score, error = DONE, None, None
        try:
            score = float(objective(params, report) if reporting else objective(params))
        except Pruned:
            state = PRUNED
        except Exception as e:  # a trial may fail for its parameters; the search goes on
            state, error = FAILED, f"{type(e).__name__}: {e}"[:2000]
        row = (trial, state, score, {k: str(v) for k, v in params.items()}, time.monotonic() - t0, error, reports)
        with lock:
            rows[trial] = row
            if path:
                spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    side_by_side(spark, [lambda t=t: run(t) for t in range(n_trials) if t not in rows], at_once, "trial")
    ended = [r for t, r in rows.items() if t < n_trials and r[1] == DONE]
    best = min(ended, key=lambda r: (sign * r[2], r[0]), default=None)
    table = spark.createDataFrame([rows[t] for t in sorted(rows)], SCHEMA)
    return draw(space, best[0], seed) if best else {}, table


def cv_objective(make_trainer: Callable[[dict], object], train: DataFrame, target: str, features: Sequence[str]) -> Callable[..., float]:
    """Objective of a search over a cross-validated trainer: folds one after the other, each fold's error reported."""
    def objective(params: dict, report: Callable[[float], None]) -> float:
        return make_trainer(params).score_by_fold(train, target, features, report)
    return objective
