"""Fold numbers as columns, derived from the id so that they do not depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldsmith.functions.exact import hashed_bucket, hashed_number
from foldsmith.operators.ordering import running_totals


def kfold(df: DataFrame, n_splits: int = 5, seed: int = 42, id_col: str = "id", out: str = "fold") -> DataFrame:
    return df.withColumn(out, hashed_bucket(n_splits, F.lit(seed), F.col(id_col)))


def inner_fold(outer: int, inner: int, seed: int = 42, id_col: str = "id"):
    """Inner fold of a row in the training part of ``outer``; shuffled anew for every outer fold."""
    return hashed_bucket(inner, F.lit(seed), F.lit(outer), F.col(id_col))


def kfold_nested(df: DataFrame, outer: int = 5, inner: int = 4, seed: int = 42, id_col: str = "id",
                 fold_col: str = "fold") -> DataFrame:
    """One row per id and outer fold it trains in, with ``outer_fold`` and ``inner_fold``."""
    cells = F.array(*[F.struct(F.lit(o).alias("outer_fold"), inner_fold(o, inner, seed, id_col).alias("inner_fold"))
                      for o in range(outer)])
    return (df.withColumn("cell", F.explode(cells)).filter(F.col("cell.outer_fold") != F.col(fold_col))
            .select(*df.columns, "cell.outer_fold", "cell.inner_fold"))


def kfold_stratified(df: DataFrame, classes: str, n_splits: int = 5, seed: int = 42, id_col: str = "id",
                     out: str = "fold") -> DataFrame:
    """Deal the rows of every class to the folds in turn, starting at a fold that depends on the class."""
    ordered = df.withColumns({"__order": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))),
                              "__one": F.lit(1).cast("long")})
    numbered = running_totals(ordered, ["__order", id_col], ["__one"], by=[classes])
    start = hashed_number(F.lit(seed), F.lit("class"), F.col(classes))
    return numbered.select(*df.columns, F.pmod(F.col("__one_before") + start, F.lit(n_splits)).cast("int").alias(out))
