"""Aggregates of the external table's target by key combination, and their lookup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foldsmith.functions.exact import mean, mean_of, units
from foldsmith.operators.lattice import Lattice, combos, roll_up
from foldsmith.operators.lookup import attach
from foldsmith.storage import materialize, write_table

# target values of more rows are counted as (key, value) pairs
HOT = 4096
AGGREGATES = ("mean", "max", "min", "nunique")
_PREFIX = {"mean": "map_orig_targets_", "max": "map_orig_targets_max_", "min": "map_orig_targets_min_",
           "nunique": "map_orig_targets_nunique_"}


def feature_name(keys: Sequence[str], agg: str) -> str:
    return _PREFIX[agg] + "_".join(keys)


def _aggregate(target: Column, agg: str, scale: int | None) -> Column:
    if agg == "mean":
        return mean(target, scale)
    return {"max": F.max, "min": F.min, "nunique": F.count_distinct}[agg](target)


def _states(agg: str, scale: int | None) -> dict[str, tuple[Column, str]]:
    """Mergeable states of an aggregate over ``__y``."""
    y = F.col("__y")
    if agg == "mean":
        return {"__s": (F.sum(y.cast("double") if scale is None else units(y, scale)), "sum"), "__n": (F.count(y), "sum")}
    if agg in ("max", "min"):
        return {"__v": ({"max": F.max, "min": F.min}[agg](y), agg)}
    raise ValueError(f"no mergeable states of {agg}")


def _value(agg: str, scale: int | None) -> Column:
    return mean_of(F.col("__s"), F.col("__n"), scale) if agg == "mean" else F.col("__v")


@dataclass
class ExternalAggregates:
    """An aggregate for every key combination: ``table`` has (combo_id, key columns, value)."""

    lattice: Lattice
    table: DataFrame

    def of(self, keys: Sequence[str]) -> DataFrame:
        """(keys, value) of one combination."""
        return self.table.where(F.col("combo_id") == self.lattice.id_of(keys)).select(*keys, "value")

    def attach(self, df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        """Look the value up as the float column ``name``; whether it is broadcast follows from the counted keys."""
        table = self.of(keys).select(*keys, F.col("value").cast("float").alias(name))
        return attach(df, table, keys, [name], n_bytes=self.lattice.bytes_of(keys, 8))


def external_aggregates(external: DataFrame, columns: Sequence[str], target: str, agg: str = "mean", sizes: Sequence[int] | None = None,
                        scale: int | None = None) -> ExternalAggregates:
    """Aggregate of ``target`` for every combination of ``columns``, each from the smallest combination that contains it.

    Means roll up as sums and counts. Distinct counts roll up as counts of the distinct rows of each target value, less those rows whose
    key another row of the same value has before them; so no (key, value) pairs are made for every combination. Only values of more
    than ``HOT`` rows, whose rows are not brought to one task, roll up as such pairs.
    """
    columns = list(columns)
    rows = external.select(*columns, F.col(target).alias("__y"))
    if agg != "nunique":
        lattice = roll_up(rows, columns, _states(agg, scale), sizes)
        return ExternalAggregates(lattice, lattice.table().select("combo_id", *columns, _value(agg, scale).alias("value")))
    rows = rows.select(*[(F.col(c) + 0.0).cast(kind).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes])
    known = rows.where("__y IS NOT NULL")
    hot = write_table(known.groupBy("__y").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > HOT).select(F.col("__y").alias("__hot")), "hot")
    some = hot.count() > 0
    is_hot = F.col("__y") == F.col("__hot")
    others = known.join(F.broadcast(hot), is_hot, "left_anti") if some else known
    lattice_of = Lattice(columns)
    ids = [lattice_of.id_of(c) for c in combos(columns, sizes)]
    met = write_table(others.repartition("__y").sortWithinPartitions("__y").mapInArrow(
        _repeats(columns, ids), StructType([*(rows.schema[c] for c in columns), StructField("__again", ArrayType(IntegerType()))])), "met")
    ones = met.select(*columns, F.lit(1).cast("long").alias("__one"))
    ones = ones.unionByName(rows.where("__y IS NULL").select(*columns, F.lit(0).cast("long").alias("__one")))
    if some:
        ones = ones.unionByName(known.join(F.broadcast(hot), is_hot, "left_semi").select(*columns, F.lit(0).cast("long").alias("__one")))
    lattice = roll_up(ones, columns, {"__u": (F.sum("__one"), "sum")}, sizes)
    again = met.select(F.explode("__again").alias("combo_id"), *columns)
    again = again.select("combo_id", *[F.when(F.col("combo_id").bitwiseAND(1 << i) != 0, F.col(c)).alias(c) for i, c in enumerate(columns)])
    parts = [lattice.table().select("combo_id", *columns, "__u"), again.groupBy("combo_id", *columns).agg((-F.count(F.lit(1))).alias("__u"))]
    if some:
        pairs = roll_up(known.join(F.broadcast(hot), is_hot, "left_semi"), columns, {"__rows": (F.count(F.lit(1)), "sum")}, sizes, always=["__y"])
        parts.append(pairs.table().select("combo_id", *columns, F.lit(1).cast("long").alias("__u")))
    table = reduce(DataFrame.unionByName, parts).groupBy("combo_id", *columns).agg(F.sum("__u").alias("value"))
    return ExternalAggregates(lattice, table)


def _repeats(columns: Sequence[str], ids: Sequence[int]):
    """Task function over rows sorted by ``__y``: of the distinct rows of a target value, the combinations (``__again``) whose keys an
    earlier one of them has too. Such a row adds nothing to the distinct count of those keys."""
    # each combination is made from the one without its last column, so that comes first
    steps = sorted({combo & ((2 << i) - 1) for combo in ids for i in range(len(columns))} - {0})

    def codes(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def finer(coarse: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.unique(coarse * (place.max() + 1) + place, return_inverse=True)[1]

    # no function in here may call itself: such a closure is a cycle, and keeps the arrays of its batch until Python looks for cycles
    def told(table: pa.Table) -> pa.RecordBatch:
        values, places = codes(table["__y"]), [codes(table[c]) for c in columns]
        distinct = np.sort(np.unique(reduce(finer, places, values), return_index=True)[1])
        made, places = {0: values[distinct]}, [place[distinct] for place in places]
        for combo in steps:
            top = combo.bit_length() - 1
            made[combo] = finer(made[combo & ~(1 << top)], places[top])
        again = np.ones((len(distinct), len(ids)), bool)
        for k, combo in enumerate(ids):
            again[np.unique(made[combo], return_index=True)[1], k] = False
        offsets = np.concatenate([[0], np.cumsum(again.sum(axis=1))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(ids, np.int32)[np.nonzero(again)[1]]))
        kept = table.select(columns).take(pa.array(distinct)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in kept.columns), lists], names=[*columns, "__again"])

    def run(batches):
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            own = codes(table["__y"])
            before = np.flatnonzero(own != own[-1]) if len(own) else []
            whole = int(before[-1]) + 1 if len(before) else 0  # the last value may go on in the next batch
            if whole:
                yield told(table.slice(0, whole))
            left = table.slice(whole)
        if left is not None and left.num_rows:
            yield told(left)
    return run


def external_by_combo(external: DataFrame, columns: Sequence[str], target: str, agg: str = "mean",
                      sizes: Sequence[int] | None = None, scale: int | None = None) -> DataFrame:
    """(combo, columns, value): the aggregate of ``target`` for every combination of ``columns``.

    ``combo`` names the columns of a row's combination, the others are NULL.
    """
    found = external_aggregates(external, columns, target, agg, sizes, scale)
    return found.lattice.named(found.table).select("combo", *columns, "value")


def map_quotas(found: ExternalAggregates, *frames: DataFrame) -> DataFrame:
    """(combo, rows, nan_quota, mean): what the lookup of each combination's value gives over all rows of ``frames``.

    The frames are counted by every combination too, and the two tables of counts and values meet on their keys, so no row is
    looked up once for each combination.
    """
    lattice, columns = found.lattice, found.lattice.columns
    sizes = sorted({bin(i).count("1") for i in lattice.rows})
    rows = reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])
    counts = roll_up(rows, columns, {"__rows": (F.count(F.lit(1)), "sum")}, sizes).table()
    values = found.table.select(F.col("combo_id").alias("__combo"), *[F.col(c).alias(f"__of_{c}") for c in columns], "value")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in columns], F.col("combo_id") == F.col("__combo"))
    met = counts.join(values, same, "left").groupBy("combo_id").agg(
        F.sum("__rows").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("__rows")).otherwise(0)).alias("__none"),
        F.sum(F.col("value") * F.col("__rows")).alias("__total"))
    return lattice.named(met).select("combo", "rows", (F.col("__none") / F.col("rows")).alias("nan_quota"),
                                     (F.col("__total") / (F.col("rows") - F.col("__none"))).alias("mean"))


def map_external_agg(external: DataFrame, keys: Sequence[str], target: str, agg: str, *frames: DataFrame,
                     scale: int | None = None, fill: bool = False) -> list[DataFrame]:
    """Look the aggregate up by ``keys``; no match gives NULL, or the overall mean with ``fill``."""
    keys, name = list(keys), feature_name(keys, agg)
    table = materialize(external.groupBy(*keys).agg(
        _aggregate(F.col(target), agg, scale).cast("float").alias(name)))
    out = [attach(df, table, keys, [name]) for df in frames]
    if fill:
        overall = external.agg(mean(F.col(target), scale)).scalar().cast("float")
        out = [df.withColumn(name, F.coalesce(F.col(name), overall)) for df in out]
    return out


def map_external_many(external: DataFrame, requests: Sequence[tuple[Sequence[str], str]], target: str,
                      *frames: DataFrame, scale: int | None = None) -> list[DataFrame]:
    """Several ``(keys, agg)`` lookups; requests on the same keys share one table."""
    by_keys: dict[tuple[str, ...], list[str]] = {}
    for keys, agg in requests:
        by_keys.setdefault(tuple(keys), []).append(agg)
    out = list(frames)
    for keys, aggs in by_keys.items():
        named = [_aggregate(F.col(target), a, scale).cast("float").alias(feature_name(keys, a)) for a in aggs]
        table = materialize(external.groupBy(*keys).agg(*named))
        out = [attach(df, table, keys, [feature_name(keys, a) for a in aggs]) for df in out]
    return out


def nan_quota(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Share of missing values over train and test."""
    both = train.select(col).unionByName(test.select(col))
    return both.agg(F.avg(F.col(col).isNull().cast("int")).alias("nan_quota"), F.count(F.lit(1)).alias("rows"))


def column_nunique(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column as ``(column_name, nunique)`` rows."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nunique")


def useful_combinations(df: DataFrame, columns: Sequence[str], max_nunique: int = 600_000, min_nunique: int = 5,
                        sizes: Sequence[int] | None = None, approximate: bool = False) -> DataFrame:
    """Combinations whose product of distinct counts lies in the given range."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    counts = df.agg(*[count(F.col(c)).cast("double").alias(c) for c in columns])
    rows = []
    for combo in combos(columns, sizes):
        product = F.lit(1.0)
        for c in combo:
            product = product * F.col(c)
        rows.append(F.struct(F.lit("_".join(combo)).alias("combo"), F.lit(len(combo)).alias("size"),
                             product.alias("product")))
    return (counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .filter(F.col("product").between(min_nunique, max_nunique)))


