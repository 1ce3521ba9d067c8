"""Joining a fitted table (one row per key) to a large frame.

A fitted table that is small by measured bytes is broadcast, so the large frame is not shuffled at all.
Beyond the bound the join is a shuffle join in which hot keys are salted: only the keys above
``1/HOT_SHARE`` of all rows, so little is copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.storage import materialize

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 256


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as Spark would hold them, about: text by its length, nested values by their JSON.

    The number is kept with the frame, so a fitted table is measured once, however many frames it is attached to.
    """
    if (known := getattr(df, "measured_bytes", None)) is not None:
        return known
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width += F.coalesce(F.octet_length(value), F.lit(0)) + 16
        elif kind.startswith(("array", "struct", "map")):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
        else:
            width += F.lit(8)
    df.measured_bytes = df.agg(F.sum(width)).first()[0] or 0
    return df.measured_bytes


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES, n_bytes: int | None = None) -> bool:
    """True when the rows of ``df`` measure at most ``max_bytes``; a size known from its fit needs no job."""
    return (measured_bytes(df) if n_bytes is None else n_bytes) <= max_bytes


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[l].eqNullSafe(right[r]) for l, r in pairs])


def _salted(base: DataFrame, table: DataFrame, keys: Sequence[str], weight: str | None,
            spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``__salt``: hot keys are spread over several copies of their table row."""
    counts = (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")) if weight is None
              else table.select(*keys, F.col(weight).alias("__rows")))
    share = counts.agg(F.ceil(F.sum("__rows") / F.lit(float(HOT_SHARE)))).scalar()
    # at most HOT_SHARE keys can hold more than 1/HOT_SHARE of the rows, so this list is bounded
    hot = materialize(counts.filter(F.col("__rows") > share).select(
        *[F.col(k).alias(f"__hot_{k}") for k in keys], F.ceil(F.col("__rows") / share).cast("int").alias("__copies")))

    def with_copies(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(hot), null_safe(df, hot, [(k, f"__hot_{k}") for k in keys]), "left")
        return joined.select(*df.columns, F.coalesce("__copies", F.lit(1)).alias("__copies"))

    base = with_copies(base).withColumn("__salt", F.pmod(F.xxhash64(*spread), F.col("__copies")).cast("int"))
    table = with_copies(table).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return base.drop("__copies"), table.drop("__copies")


def attach(base: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None,
           weight: str | None = None, spread: Sequence[str] | None = None,
           max_broadcast_bytes: int = BROADCAST_BYTES, n_bytes: int | None = None) -> DataFrame:
    """Left join on null-safe ``keys``; ``table`` has at most one row per key and is cheap to re-read.

    ``weight`` names the column of ``table`` with the number of base rows per key, when the table was
    made from the base; otherwise hot keys are counted in the base.  ``spread`` lists the base columns
    that distribute the rows of a hot key (the id, or every column). ``n_bytes`` is the size of ``table``, if known.
    """
    keys = list(keys)
    values = [c for c in table.columns if c not in keys and c != weight] if values is None else list(values)
    keep = base.columns
    small = is_small(table, max_broadcast_bytes, n_bytes)
    on = list(keys)
    if not small:
        spread = list(spread or (["id"] if "id" in keep else keep))
        base, table = _salted(base, table, keys, weight, spread)
        on.append("__salt")
    table = table.select(*[F.col(k).alias(f"__key_{k}") for k in on], *values)
    if small:
        table = F.broadcast(table)
    return base.join(table, null_safe(base, table, [(k, f"__key_{k}") for k in on]), "left").select(*keep, *values)


def align_on_id(base: DataFrame, *features: DataFrame, id_col: str = "id", validate: bool = True) -> DataFrame:
    """Put feature columns beside ``base``; column names must be unique and the id sets equal.

    The id check is one job over the ids alone; pass ``validate=False`` where the writer of the
    frames already guarantees it.
    """
    sides = [base, *features]
    names = list(base.columns) + [c for frame in features for c in frame.columns if c != id_col]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"column names are not unique: {repeated}")
    if validate:
        wrong = unequal_ids(sides, id_col).limit(5).collect()
        if wrong:
            raise ValueError(f"ids differ or repeat, e.g. {[r[id_col] for r in wrong]}")
    return reduce(lambda a, b: a.join(b, id_col, "inner"), sides)


def unequal_ids(frames: Sequence[DataFrame], id_col: str = "id") -> DataFrame:
    """Ids that are not present exactly once in every frame."""
    seen = reduce(DataFrame.unionByName, [f.select(id_col, F.lit(i).alias("frame")) for i, f in enumerate(frames)])
    return (seen.groupBy(id_col).agg(*[F.count(F.when(F.col("frame") == i, 1)).alias(f"in_{i}") for i in range(len(frames))])
            .filter(" OR ".join(f"in_{i} <> 1" for i in range(len(frames)))))


def keep_base_rows(predictions: DataFrame, base_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop prediction rows whose id is not a base id (appended external rows)."""
    return predictions.join(base_ids.select(id_col), id_col, "left_semi")
