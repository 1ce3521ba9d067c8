"""Stacking of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def append_external(train: DataFrame, external: DataFrame, id_col: str = "id", flag: str = "is_original") -> DataFrame:
    """External rows below train, flagged, with ids that cannot meet train's."""
    marked = external.withColumns({id_col: F.concat(F.lit("ext:"), F.col(id_col).cast("string")), flag: F.lit(1)})
    return train.withColumns({id_col: F.col(id_col).cast("string"), flag: F.lit(0)}).unionByName(marked)


def append_external_per_fold(train: DataFrame, val: DataFrame, test: DataFrame, external: DataFrame,
                             id_col: str = "id", flag: str = "is_original") -> tuple[DataFrame, DataFrame, DataFrame]:
    """External rows join the training part of a fold only; validation and test are flagged 0."""
    return (append_external(train, external, id_col, flag), val.withColumn(flag, F.lit(0)),
            test.withColumn(flag, F.lit(0)))


def concat_segments(*predictions: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, predictions)


def adversarial_frame(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Train rows labelled 1, test rows labelled 0."""
    return train.withColumn(label, F.lit(1)).unionByName(test.withColumn(label, F.lit(0)))
