"""Aggregates for every combination of some columns, each rolled up from the smallest one at hand."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from foldsmith.storage import write_table

# a combination waits for another one to be computed first if that is expected to have fewer than this share of its source's rows
WORTH_WAITING = 0.5
# rows of a source that are not worth another round
LITTLE = 1 << 16

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def combos(columns: Sequence[str], sizes: Sequence[int] | None = None) -> list[tuple[str, ...]]:
    sizes = range(1, len(columns) + 1) if sizes is None else sizes
    return [c for size in sizes for c in combinations(columns, size)]


@dataclass
class Lattice:
    """``parts`` hold (combo_id, columns, states) rows, the columns outside a row's combination being NULL; ``rows`` counts
    the keys of each combination, whose id has a bit per column."""

    columns: list[str]
    parts: list[DataFrame] = field(default_factory=list)
    held: list[set[int]] = field(default_factory=list)
    rows: dict[int, int] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)

    def bytes_of(self, combo: Sequence[str], values: int) -> int:
        """Most bytes that the keys of a combination and ``values`` bytes a row can take, from what was measured when it was fitted."""
        return self.rows[self.id_of(combo)] * (sum(self.widths[c] for c in combo) + values)

    def id_of(self, combo: Sequence[str]) -> int:
        return sum(1 << self.columns.index(c) for c in combo)

    def names_of(self, combo_id: int) -> list[str]:
        return [c for i, c in enumerate(self.columns) if combo_id >> i & 1]

    def table(self, wanted: Sequence[int] | None = None) -> DataFrame:
        """The rows of the wanted combinations (default all), read from the parts that hold them."""
        chosen = set(self.rows if wanted is None else wanted)
        parts = [part if held <= chosen else part.where(F.col("combo_id").isin(*sorted(held & chosen)))
                 for part, held in zip(self.parts, self.held) if held & chosen]
        return reduce(DataFrame.unionByName, parts)

    def named(self, df: DataFrame, name: str = "combo") -> DataFrame:
        """``df`` with the column names of each row's combination, joined by ``_``."""
        used = [F.when(F.col("combo_id").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(self.columns)]
        return df.withColumn(name, F.concat_ws("_", *used))


def roll_up(df: DataFrame, columns: Sequence[str], states: Mapping[str, tuple[Column, str]], sizes: Sequence[int] | None = None,
            always: Sequence[str] = (), wanted: Sequence[Sequence[str]] | None = None) -> Lattice:
    """States of every combination of ``columns`` (of the given sizes, or the ``wanted`` ones); ``always`` lists further keys of all.

    A state is an aggregate over ``df`` and how two of its values merge (``sum``, ``min`` or ``max``). ``df`` is grouped once by all columns.
    After that each combination is summed up from the one with the fewest rows among those computed that contain it,
    in a few rounds: a combination waits while its source is large and a pending one that contains it is expected to be much
    smaller. A round is one aggregate over the sources' rows, each repeated for the combinations that take it, and is written, so
    what a later round reads is small and survives lost executors. Only row counts reach the driver.
    """
    columns, always = list(columns), list(always)
    lattice = Lattice(columns)
    full = (1 << len(columns)) - 1
    sought = {lattice.id_of(c) for c in (combos(columns, sizes) if wanted is None else wanted)}
    text = [c for c, kind in df.select(*columns).dtypes if kind in ("string", "binary")]
    base = write_table(df.groupBy(*columns, *always).agg(*[agg.alias(name) for name, (agg, _) in states.items()])
                       .withColumn("combo_id", F.lit(full)).select("combo_id", *columns, *always, *states), "lattice")
    counts = base.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)],
                      *[F.max(F.octet_length(c)).alias(f"w{i}") for i, c in enumerate(columns) if c in text]).first()
    lattice.widths = {c: 16 + (counts[f"w{i}"] or 0) if c in text else 8 for i, c in enumerate(columns)}
    lattice.parts, lattice.held, lattice.rows = [base], [{full}], {full: counts["rows"]}

    def expected(combo_id: int) -> int:
        size = 1
        for i in range(len(columns)):
            if combo_id >> i & 1:
                size *= counts[f"d{i}"] + 1
        return min(size, counts["rows"])

    pending = sought - {full}
    while pending:
        sources: dict[int, list[int]] = {}
        for combo in sorted(pending):
            source = min((p for p in lattice.rows if p & combo == combo), key=lambda p: (lattice.rows[p], p))
            better = min((expected(q) for q in pending if q & combo == combo and q != combo), default=None)
            if better is None or lattice.rows[source] <= LITTLE or better >= WORTH_WAITING * lattice.rows[source]:
                sources.setdefault(source, []).append(combo)
        targets = F.create_map(*[x for s, ts in sources.items() for x in (F.lit(s), F.array(*map(F.lit, ts)))])
        dealt = lattice.table(list(sources)).withColumn("combo_id", F.explode(targets[F.col("combo_id")]))
        masked = {c: F.when(F.col("combo_id").bitwiseAND(1 << i) != 0, F.col(c)) for i, c in enumerate(columns)}
        part = write_table(dealt.withColumns(masked).groupBy("combo_id", *columns, *always)
                           .agg(*[MERGE[how](name).alias(name) for name, (_, how) in states.items()]), "lattice")
        made = {t for ts in sources.values() for t in ts}
        found = {r["combo_id"]: r["count"] for r in part.groupBy("combo_id").count().collect()}
        lattice.parts.append(part)
        lattice.held.append(made)
        lattice.rows.update({t: found.get(t, 0) for t in made})
        pending -= made
    if full not in sought:
        lattice.rows.pop(full)
    return lattice
