"""Where intermediate tables go.

Tables that are read several times (fitted encoders, range-partitioned value counts) are written
once to the reliable checkpoint folder, so a lost executor costs a re-read and not a re-fit.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldsmith.functions.exact import quoted

_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="foldsmith-")
    return _fallback[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, write it to the checkpoint folder and continue from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def write_table(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Unlike a checkpoint it keeps columns apart, so later reads take those they need, and tells the planner its size. A filter on the
    columns ``by``, a folder for each of their values, reads those folders alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path).select(*[F.col(quoted(c)) for c in df.columns])
    table.scratch = path
    return table


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes begun inside delete their shuffle files when they end; else these stay until the driver happens to collect its garbage.

    A setting of the session, so not for several threads at a time, nor for frames that are collected twice.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_buckets(df: DataFrame, name: str, by: Sequence[str] = (), deal: bool = True, id_col: str = "id", more: Sequence[DataFrame] = ()) -> DataFrame:
    """`write_table` in buckets of the id, as many as the session's shuffle partitions: tables so written are joined on the id without a shuffle.

    Rows that come from such a table already need not be dealt out by id again (``deal``). The frames ``more`` go into the same table, one
    after the other, where a union would be dealt out anew to be grouped by id.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"buckets_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        for rows in (df, *more):
            rows = rows.repartition(buckets, quoted(id_col)) if deal else rows
            (rows.write.mode("append").partitionBy(*by).bucketBy(buckets, id_col).sortBy(id_col).format("parquet").option("compression", "zstd")
             .option("path", path).saveAsTable(table))
    stored = spark.table(table).select(*[F.col(quoted(c)) for c in df.columns])
    stored.scratch = path
    return stored


def drop_table(table: DataFrame) -> None:
    """Delete the files of a `write_table` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
