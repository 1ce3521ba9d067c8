"""Shared pieces: tables in the cluster's folder, batches of texts, ASCII words."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.storage import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read, and the size of the files tells Spark whether the table may
    be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table made by `write_table` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` and all others in a struct ``_row``, so that no name of theirs can clash with a computed one."""
    return df.select(*own, F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns if c not in own)).alias("_row"))


def unpack(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """The columns of the frame that was packed, in their order."""
    return df.select(*(c if c in own else F.col("_row").getField(c).alias(c) for c in columns))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: a zip of it in the shared folder, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "foldsmith")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    path = f"{scratch_path(spark, 'package')}/foldsmith.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(package.getvalue()))
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
