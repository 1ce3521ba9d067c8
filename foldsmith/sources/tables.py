"""Reading input tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet carries its schema; a CSV needs a declared one, so that no pass is spent on inference."""
    if path.endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV table needs a declared schema")
        return spark.read.schema(schema).csv(path, header=True)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """Turn NaN in float columns into NULL, the only missing value used further on."""
    cols = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def load_frame(spark: SparkSession, path: str, id: str, target: str | None = None,
               schema: StructType | str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Read a labelled table: features with an ``id`` column, and the target as ``(id, y)``."""
    df = nulls_for_nan(read_table(spark, path, schema)).withColumnRenamed(id, "id")
    if target is None:
        return df, None
    return df.drop(target), df.select("id", F.col(target).alias("y"))


def load_as_text(spark: SparkSession, path: str, text_cols: Sequence[str], id: str | None = None,
                 schema: StructType | str | None = None) -> DataFrame:
    """Read chosen columns as text: declared as text in a CSV, cast in a typed file."""
    if schema is not None and isinstance(schema, StructType):
        text = StructType.fromJson(schema.jsonValue())
        for field in text.fields:
            if field.name in text_cols:
                field.dataType = StructType.fromDDL("x string").fields[0].dataType
        schema = text
    df = read_table(spark, path, schema)
    if id is not None:
        df = df.withColumnRenamed(id, "id")
    return df.withColumns({c: F.col(c).cast("string") for c in text_cols})


def load_external(spark: SparkSession, path: str, renames: Mapping[str, str], drops: Sequence[str],
                  schema: StructType | str | None = None) -> DataFrame:
    """Read the external table under train's column names."""
    df = nulls_for_nan(read_table(spark, path, schema)).drop(*drops)
    return df.withColumnsRenamed(dict(renames))
