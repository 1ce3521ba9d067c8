"""Several fits at once from one driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], width: int, pool: str = "fit") -> list[T]:
    """Results of ``jobs`` in their order, up to ``width`` of them running at a time.

    A fit is many short jobs with a driver step between them, so a second one fills the cores that the first leaves
    idle. Threads inherit the caller's job properties; each job has a scheduler pool of its own (used under
    ``spark.scheduler.mode=FAIR``). The first error is raised after the running jobs have ended.
    """
    if width <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]

    def pooled(n: int, job: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{n}")
            return job()
        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(min(width, len(jobs))) as threads:
        return [f.result() for f in [threads.submit(pooled(n, job)) for n, job in enumerate(jobs)]]
