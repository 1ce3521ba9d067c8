"""Order-independent sums and portable hashing.

A sum of doubles depends on the order of the rows, hence on partitioning.  Columns with a fixed
number of decimals are summed as whole units (cents for ``scale=100``) and divided once.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def units(value: Column, scale: int) -> Column:
    """``value`` as a whole number of ``1/scale`` units."""
    return F.round(value * F.lit(float(scale))).cast("long")


def total(value: Column, scale: int | None) -> Column:
    """Aggregate: sum in units when ``scale`` is given, else the plain double sum."""
    return F.sum(value.cast("double") if scale is None else units(value, scale))


def mean_of(total_units: Column, count: Column, scale: int | None, smooth: float = 0.0,
            prior: Column | None = None) -> Column:
    """Mean from a sum made by :func:`total`; NULL when nothing was counted."""
    count = count.cast("double")
    if smooth:
        value = (total_units.cast("double") / F.lit(float(scale or 1)) + F.lit(float(smooth)) * prior) / (
            count + F.lit(float(smooth)))
    else:
        value = total_units.cast("double") / (F.lit(float(scale or 1)) * count)
    return F.when(count > 0, value)


def mean(value: Column, scale: int | None = None) -> Column:
    """Aggregate: mean of ``value``, exact for fixed-decimal columns when ``scale`` is given."""
    if scale is None:
        return F.avg(value)
    return mean_of(total(value, scale), F.count(value), scale)


# The same as text, for plans that hold hundreds of such terms: one parsed expression is far cheaper to
# build than a tree of Column calls.

def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def units_sql(value: str, scale: int | None) -> str:
    return f"cast({value} AS double)" if scale is None else f"cast(round({value} * {float(scale)}D) AS bigint)"


def mean_of_sql(total_units: str, count: str, scale: int | None, smooth: float = 0.0, prior: str | None = None) -> str:
    total, rows = f"cast({total_units} AS double)", f"cast({count} AS double)"
    unit = f"{float(scale or 1)}D"
    value = (f"({total} / {unit} + {float(smooth)}D * {prior}) / ({rows} + {float(smooth)}D)" if smooth
             else f"{total} / ({unit} * {rows})")
    return f"CASE WHEN {count} > 0 THEN {value} END"


def hashed_number(*parts: Column) -> Column:
    """First 32 bits of the md5 of ``a:b:...`` as a long; equal on every engine that has md5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashed_bucket(buckets: int, *parts: Column) -> Column:
    return F.pmod(hashed_number(*parts), F.lit(buckets)).cast("int")


def hashed_uniform(*parts: Column) -> Column:
    """Number in the open interval (0, 1)."""
    return (hashed_number(*parts).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
