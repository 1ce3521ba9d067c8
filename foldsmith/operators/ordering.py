"""Ranks, quantiles and numbering over a global order without a one-task window.

Rows are first reduced to distinct values with their counts.  Those are range-partitioned; every
partition sums its own part and a tiny table of partition totals supplies the offsets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from foldsmith.functions.exact import quoted
from foldsmith.operators.lookup import attach
from foldsmith.storage import materialize, write_table

# a sketch's ranks are off by a share of 1 / ACCURACY at most; brackets reach twice as far to either side
ACCURACY = 10_000
# columns of so few values, and brackets with so few distinct ones, are read whole
FEW, MOST = 100_000, 1_000_000


def running_totals(df: DataFrame, order_by: Sequence[str], weights: Sequence[str],
                   by: Sequence[str] = (), totals: bool = False) -> DataFrame:
    """Add ``<weight>_before``: the sum of ``weight`` over all earlier rows of the same group; with ``totals``
    also ``<weight>_total``, the group's whole sum, which comes from the same table of partition sums.

    ``order_by`` must be unique inside a group, so one heavy value is one row and no group has to
    fit in one task: a large group simply spans many range partitions.
    """
    by, order_by, weights = list(by), list(order_by), list(weights)
    parts = materialize(df.repartitionByRange(*by, *order_by).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "__part").agg(*[F.sum(w).alias(f"__sum_{w}") for w in weights])
    earlier = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(
        W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    # one row per group and range partition; small unless there are very many groups
    offsets = materialize(sums.select(
        *by, "__part", *[F.coalesce(F.sum(f"__sum_{w}").over(earlier), zero).alias(f"__off_{w}") for w in weights],
        *[F.sum(f"__sum_{w}").over(whole).alias(f"{w}_total") for w in weights if totals]))
    all_sums = [f"{w}_total" for w in weights if totals]
    inside = W.partitionBy(*by, "__part").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    counted = parts.withColumns({f"__in_{w}": F.coalesce(F.sum(w).over(inside), zero) for w in weights})
    return attach(counted, offsets, [*by, "__part"], [*[f"__off_{w}" for w in weights], *all_sums], spread=order_by).select(
        *df.columns, *[(F.col(f"__off_{w}") + F.col(f"__in_{w}")).alias(f"{w}_before") for w in weights], *all_sums)


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column_name",
         value: str = "value") -> DataFrame:
    """Numeric columns as ``(keep..., name, value)`` rows; NULL and NaN values are left out."""
    long = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keep), list(columns), name, value)
    return long.filter(F.col(value).isNotNull() & ~F.isnan(value))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of every column with their number of rows and of smaller rows."""
    counts = melt(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, ["value"], ["n"], by=["column_name"])


def _by_running_totals(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """`quantile_row` from all distinct values, range-partitioned."""
    counts = value_counts(df, columns)
    rows = counts.groupBy("column_name").agg(F.sum("n").alias("rows"))
    # one row per column name
    counts = counts.join(F.broadcast(rows), "column_name")

    found = []
    for column in columns:
        own = f"column_name = '{column}'"
        cells = []
        for p in probabilities:
            position = f"({float(p)!r}D * (rows - 1))"
            low, high = (f"max(CASE WHEN {own} AND n_before <= {f}{position} AND {f}{position} < n_before + n THEN value END)"
                         for f in ("floor", "ceil"))
            cells.append(f"struct({low} AS low, {high} AS high, "
                         f"max(CASE WHEN {own} THEN {position} - floor{position} END) AS share)")
        found.append(F.expr(f"array({', '.join(cells)})").alias(column))
    between = "transform({0}, q -> q.low + (q.high - q.low) * q.share) AS {0}"
    return counts.agg(*found).selectExpr(*[between.format(quoted(c)) for c in columns])


def _brackets(facts, i: int, probabilities: Sequence[float], wanted: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint intervals that hold the quantiles of column ``i``: between sketched ones, or the whole of a small column."""
    n, low, high = facts[f"n{i}"], facts[f"a{i}"], facts[f"b{i}"]
    if n <= FEW:
        return [(low, high)] if n else []
    at = dict(zip(wanted, facts[f"q{i}"]))
    out: list[tuple[float, float]] = []
    for p in sorted(probabilities):
        under, over = p - 2 / ACCURACY, p + 2 / ACCURACY
        lo, hi = low if under <= 0 else at[under], high if over >= 1 else at[over]
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _counted(values: DataFrame, brackets: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """(c, outside, value, n): distinct values in the brackets of column ``c``, and rows between them (``outside``: how many
    brackets lie below), in one pass; a task sends sums."""
    bounds = [(np.array([lo for lo, _ in b]), np.array([hi for _, hi in b])) for b in brackets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, (lows, highs) in enumerate(bounds):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                if not len(lows) or not len(x):
                    continue
                below = np.searchsorted(lows, x, "right")
                inside = (below > 0) & (x <= highs[np.maximum(below - 1, 0)])
                value, n = np.unique(x[inside], return_counts=True)
                outside = np.bincount(below[~inside], minlength=len(lows) + 1)
                gaps = np.flatnonzero(outside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value) + len(gaps), c, np.int32)), pa.array([None] * len(value) + gaps.tolist(), pa.int32()),
                     pa.array([*value.tolist(), *[None] * len(gaps)], pa.float64()), pa.array([*n.tolist(), *outside[gaps].tolist()], pa.int64())],
                    names=["c", "outside", "value", "n"])

    told = values.mapInArrow(run, "c int, outside int, value double, n long")
    return told.groupBy("c", "outside", "value").agg(F.sum("n").alias("n"))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles as one row with an array column per input column.

    One pass makes mergeable sketches, whose quantiles bracket the exact ones; a second counts the rows outside the
    brackets and the distinct values inside, which is all that is shuffled. What is left to sort is some ten-thousandths of
    the rows. Should it be more than a million values, or a bracket miss its rank, all distinct values are range-partitioned.
    """
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    spark = df.sparkSession
    number = [F.col(quoted(c)).cast("double") for c in columns]
    values = df.select(*[F.when(~F.isnan(v), v).alias(f"c{i}") for i, v in enumerate(number)])
    wanted = sorted({q for p in probabilities for q in (p - 2 / ACCURACY, p + 2 / ACCURACY) if 0 < q < 1}) or [0.5]
    facts = values.agg(*[f for i in range(len(columns)) for f in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"a{i}"), F.max(f"c{i}").alias(f"b{i}"),
        F.percentile_approx(f"c{i}", F.lit(wanted), ACCURACY).alias(f"q{i}"))]).first()
    brackets = [_brackets(facts, i, probabilities, wanted) for i in range(len(columns))]
    counted = write_table(_counted(values, brackets), "brackets")
    if counted.count() > MOST:
        return _by_running_totals(df, columns, probabilities)
    inside: list[list[tuple[float, int]]] = [[] for _ in columns]
    outside = [[0] * (len(b) + 1) for b in brackets]
    for r in counted.toArrow().to_pylist():
        if r["value"] is None:
            outside[r["c"]][r["outside"]] += r["n"]
        else:
            inside[r["c"]].append((r["value"], r["n"]))
    row = []
    for i in range(len(columns)):
        found, seen, lows = [], 0, [lo for lo, _ in brackets[i]]
        for value, n in sorted(inside[i]):
            before = seen + sum(outside[i][:bisect_right(lows, value)])
            found.append((before, before + n, value))
            seen += n
        starts = [b for b, _, _ in found]

        def at(rank: int) -> float | None:
            k = bisect_right(starts, rank) - 1
            return found[k][2] if k >= 0 and rank < found[k][1] else None

        cells: list[float | None] = []
        for p in probabilities:
            if not facts[f"n{i}"]:
                cells.append(None)
                continue
            position = p * (facts[f"n{i}"] - 1)
            low, high = at(floor(position)), at(ceil(position))
            if low is None or high is None:
                return _by_running_totals(df, columns, probabilities)
            cells.append(low + (high - low) * (position - floor(position)))
        row.append(cells)
    return spark.createDataFrame([tuple(row)], ", ".join(f"{quoted(c)} array<double>" for c in columns))


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles as ``(column_name, q, value)`` rows."""
    probabilities = list(probabilities)
    qs = F.array(*[F.lit(float(p)) for p in probabilities])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.arrays_zip(qs.alias("q"), F.col(c).alias("value")).alias("cells"))
                      for c in columns])
    return (quantile_row(df, columns, probabilities).select(F.explode(cells).alias("r"))
            .select("r.column_name", F.explode("r.cells").alias("c")).select("column_name", "c.q", "c.value"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``(by, value)`` with row count ``n``, 1-based average rank ``rank`` and the group's ``size``."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, [value], ["n"], by=by, totals=True).select(
        *by, value, "n", (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"), F.col("n_total").alias("size"))


def groupby_then_rank(df: DataFrame, value: str, key: str, out: str | None = None) -> DataFrame:
    """Percent rank (average over ties) of ``value`` inside the rows that share ``key``."""
    out = out or f"groupby_then_rank_{value}_by_{key}"
    ranks = average_ranks(df, value, by=[key]).select(key, value, "n", (F.col("rank") / F.col("size")).alias(out))
    return attach(df, materialize(ranks), [key, value], [out], weight="n")


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, code)``: codes 0, 1, ... in value order, in the column's own type; NULL and NaN have none."""
    rows = df.select(F.col(column).alias("value")).filter("value IS NOT NULL")
    if dict(rows.dtypes)["value"] in ("float", "double"):
        rows = rows.filter(~F.isnan("value"))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("one"))
    return running_totals(counts, ["value"], ["one"]).select("value", "n", F.col("one_before").alias("code"))
