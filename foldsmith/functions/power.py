"""Yeo-Johnson power transform."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


WIDEST = 40.0


def transform(value: Column, lam: float) -> Column:
    up = F.log1p(value) if lam == 0 else (F.pow(value + 1, F.lit(lam)) - 1) / F.lit(lam)
    low = 2.0 - lam
    down = -F.log1p(-value) if low == 0 else -(F.pow(F.lit(1.0) - value, F.lit(low)) - 1) / F.lit(low)
    return F.when(value >= 0, up).when(value < 0, down)


def inverse(value: Column, lam: float) -> Column:
    up = F.expm1(value) if lam == 0 else F.pow(value * F.lit(lam) + 1, F.lit(1.0 / lam)) - 1
    low = 2.0 - lam
    down = -F.expm1(-value) if low == 0 else F.lit(1.0) - F.pow(F.lit(1.0) - value * F.lit(low), F.lit(1.0 / low))
    return F.when(value >= 0, up).when(value < 0, down)


def log_likelihoods(df: DataFrame, col: str, grid: Sequence[float]) -> list[float | None]:
    """Profile log likelihood of every exponent of ``grid``, in one pass."""
    y = F.col(col).cast("double")
    rows = df.select(y.alias("y"), (F.signum(y) * F.log1p(F.abs(y))).alias("jacobian"),
                     *[transform(y, g).alias(f"t{i}") for i, g in enumerate(grid)])
    got = rows.agg(F.count("y").alias("n"), F.sum("jacobian").alias("jacobian"),
                   *[F.var_pop(f"t{i}").alias(f"v{i}") for i in range(len(grid))]).first()
    return [None if not got[f"v{i}"] else -0.5 * got["n"] * math.log(got[f"v{i}"]) + (g - 1.0) * got["jacobian"]
            for i, g in enumerate(grid)]


def fit(df: DataFrame, col: str, low: float = -2.0, high: float = 4.0, points: int = 9, rounds: int = 7) -> float:
    """Maximum likelihood exponent: each round scores a whole grid in one pass and narrows around the best.

    While the best exponent is at an end of the grid, the grid moves on by its width; a likelihood that still grows
    ``WIDEST`` away from 1 has no useful optimum and raises.
    """
    done = 0
    while True:
        step = (high - low) / (points - 1)
        grid = [round(low + i * step, 10) for i in range(points)]
        scores = log_likelihoods(df, col, grid)
        known = [(s, -i, g) for i, (s, g) in enumerate(zip(scores, grid)) if s is not None]
        if not known:
            raise ValueError(f"{col} has no spread to fit")
        best = max(known)[2]
        if not done and best in (grid[0], grid[-1]):
            if abs(best - 1) > WIDEST:
                raise ValueError(f"no best exponent for {col} within {WIDEST} of 1")
            low, high = best - (high - low) / 2, best + (high - low) / 2
            continue
        done += 1
        if done == rounds:
            return best
        low, high = best - step, best + step
