"""Rows that are equal in a set of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldsmith.functions.exact import hashed_bucket
from foldsmith.operators.lookup import attach
from foldsmith.operators.ordering import running_totals
from foldsmith.storage import materialize


def _group_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))


def duplicate_rows(df: DataFrame, cols: Sequence[str], keep: bool = False) -> DataFrame:
    """Add ``copies`` and ``is_duplicate`` (every member of a group of equal rows); ``keep`` filters to them."""
    marked = attach(df, materialize(_group_sizes(df, cols).withColumn("rows", F.col("copies"))), cols, ["copies"],
                    weight="rows").withColumn("is_duplicate", F.col("copies") > 1)
    return marked.filter("is_duplicate") if keep else marked


def duplicate_group_number(df: DataFrame, cols: Sequence[str], classes: int = 5, seed: int = 42, id_col: str = "id",
                           out: str = "unique_no") -> DataFrame:
    """Dense number per group of equal rows, starting after the random classes of single rows.

    Groups are numbered in key order over the table of groups, not over the rows.
    """
    groups = _group_sizes(df, cols).filter("copies > 1").withColumn("one", F.lit(1).cast("long"))
    numbered = materialize(running_totals(groups, cols, ["one"]).select(
        *cols, F.col("copies").alias("rows"), (F.col("one_before") + classes).alias("__number")))
    joined = attach(df, numbered, cols, ["__number"], weight="rows", spread=[id_col])
    single = hashed_bucket(classes, F.lit(seed), F.lit("single"), F.col(id_col)).cast("long")
    return joined.withColumn(out, F.coalesce(F.col("__number"), single)).drop("__number")
