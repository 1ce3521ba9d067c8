"""Ordinal bin codes fitted on train: equal width, equal frequency, one-dimensional k-means.

A fit returns the inner edges (at most ``n_bins - 1`` numbers); the code of a value is the number of
inner edges not above it, so values outside the fitted range fall into the first or last bin.  A constant column
has one bin, code 0; a column without values has no edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.operators.ordering import melt, quantile_row
from foldsmith.storage import materialize

STRATEGIES = ("uniform", "quantile", "kmeans")


def code_from_edges(value: Column, edges: Sequence[float]) -> Column:
    below = sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(value.isNotNull() & ~F.isnan(value), below.cast("double"))


def uniform_edges(train: DataFrame, col: str, n_bins: int) -> list[float]:
    return fit_all(train, [(n_bins, "uniform", col)])[n_bins, "uniform", col]


def quantile_edges(train: DataFrame, col: str, n_bins: int) -> list[float]:
    """Edges at multiples of ``1/n_bins``; equal edges are merged."""
    return fit_all(train, [(n_bins, "quantile", col)])[n_bins, "quantile", col]


def kmeans_edges(train: DataFrame, col: str, n_bins: int) -> list[float]:
    """Midpoints between sorted centres after Lloyd rounds over distinct values.

    Centres start at the midpoints of equal-width bins, so no seed is involved; a centre that loses
    all its values stays where it is.  Rounds go on until no centre moves; the cost falls with each, so they end.
    """
    return fit_all(train, [(n_bins, "kmeans", col)])[n_bins, "kmeans", col]


FITS = {"uniform": uniform_edges, "quantile": quantile_edges, "kmeans": kmeans_edges}
Spec = tuple[int, str, str]


def fit_all(train: DataFrame, specs: Sequence[Spec], tol: float = 1e-9) -> dict[Spec, list[float]]:
    """Inner edges of every (n_bins, strategy, column): one pass for all ranges, one for all quantiles, and a table of
    distinct values for all k-means fits, whose rounds run side by side."""
    found: dict[Spec, list[float]] = {}
    ranged = sorted({c for _, s, c in specs if s != "quantile"})
    if ranged:
        # the same values as melt keeps: NaN counts as missing
        known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        ends = train.agg(*[f(known(c)).alias(f"{n}_{i}") for i, c in enumerate(ranged) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        spans = {c: (ends[f"lo_{i}"], ends[f"hi_{i}"]) for i, c in enumerate(ranged)}
    cut = sorted({c for _, s, c in specs if s == "quantile"})
    if cut:
        shares = sorted({i / n for n, s, _ in specs if s == "quantile" for i in range(n + 1)})
        rows = quantile_row(train, cut, shares).first()
    centres: dict[Spec, list[float]] = {}
    for spec in specs:
        n, strategy, c = spec
        if strategy == "quantile":
            at = dict(zip(shares, rows[c]))
            found[spec] = [] if at[0.0] is None else list(dict.fromkeys(at[i / n] for i in range(n + 1)))[1:-1]
            continue
        lo, hi = spans[c]
        if lo is None or lo == hi:
            found[spec] = []
        elif strategy == "uniform":
            found[spec] = [i * ((hi - lo) / n) + lo for i in range(1, n)]
        else:
            centres[spec] = [lo + (i + 0.5) * ((hi - lo) / n) for i in range(n)]
    if centres:
        values = materialize(melt(train, sorted({c for _, _, c in centres})).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
        found |= _lloyd(values, centres, {s: tol * max(1.0, abs(spans[s[2]][1] - spans[s[2]][0])) for s in centres})
    return found


def _middles(centres: Sequence[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def _lloyd(values: DataFrame, centres: dict[Spec, list[float]], tol: dict[Spec, float]) -> dict[Spec, list[float]]:
    """Rounds of all fits that still move, one aggregate each over (column_name, value, n)."""
    spark, moving = values.sparkSession, set(centres)
    while moving:
        table = spark.createDataFrame([(s[2], i, _middles(centres[s])) for i, s in enumerate(centres) if s in moving],
                                      "column_name string, fit int, edges array<double>")
        # a row per fit; values of a column meet its fits only
        coded = values.join(F.broadcast(table), "column_name").withColumn(
            "code", F.size(F.filter("edges", lambda e: e <= F.col("value"))))
        sums = coded.groupBy("fit", "code").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("centre")).collect()
        new = {(r["fit"], r["code"]): r["centre"] for r in sums}
        for i, spec in enumerate(list(centres)):
            if spec in moving:
                after = sorted(new.get((i, k), c) for k, c in enumerate(centres[spec]))
                if max(abs(a - b) for a, b in zip(after, centres[spec])) <= tol[spec]:
                    moving.discard(spec)
                centres[spec] = after
    return {s: _middles(c) for s, c in centres.items()}


def compute_binned(train: DataFrame, test: DataFrame, n_bins: int, strategy: str, col: str,
                   edges: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``bins_<col>_<n_bins>_<strategy>`` to both frames with edges fitted on train."""
    edges = FITS[strategy](train, col, n_bins) if edges is None else edges
    name = f"bins_{col}_{n_bins}_{strategy}"
    code = code_from_edges(F.col(col).cast("double"), edges)
    return train.withColumn(name, code), test.withColumn(name, code)


def all_specs(columns: list[str], bin_counts: range = range(3, 21),
              strategies: tuple[str, ...] = STRATEGIES) -> list[tuple[int, str, str]]:
    """Every (n_bins, strategy, column) of a full binning run."""
    return [(k, s, c) for k in bin_counts for s in strategies for c in columns]
