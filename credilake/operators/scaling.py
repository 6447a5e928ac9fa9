"""Robust and power scaling with exact statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.functions.arithmetic import num
from credilake.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class RobustScale:
    """Median and interquartile range per column; a zero range counts as one."""

    medians: dict[str, float]
    ranges: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> RobustScale:
        quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        medians = {c: float(q[1] or 0.0) for c, q in quartiles.items()}
        ranges = {c: float((q[2] or 0.0) - (q[0] or 0.0)) for c, q in quartiles.items()}
        return RobustScale(medians, {c: r if r else 1.0 for c, r in ranges.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - num(m)) / num(self.ranges[c]) for c, m in self.medians.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * num(self.ranges[c]) + num(m) for c, m in self.medians.items()})

    def inverse_vector(self, vector: list[float]) -> dict[str, float]:
        """A scaled centre back in original units."""
        return {c: v * self.ranges[c] + self.medians[c] for c, v in zip(self.medians, vector)}

    def select_sql(self) -> dict[str, str]:
        """The same transform as SQL text, for ML pipeline stages."""
        return {c: f"(({c}) - ({m!r}D)) / {self.ranges[c]!r}D" for c, m in self.medians.items()}


def yeo_johnson(c, lam: float):
    """Yeo-Johnson transform of a column for a fixed lambda."""
    up = F.log1p(c) if lam == 0 else (F.pow(c + num(1), num(lam)) - num(1)) / num(lam)
    rest = 2.0 - lam
    down = -F.log1p(-c) if rest == 0 else -(F.pow(num(1) - c, num(rest)) - num(1)) / num(rest)
    return F.when(c >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, columns: list[str], low: float = -4.0, high: float = 4.0, rounds: int = 3) -> dict[str, float]:
    """Lambda per column by profile likelihood: three aggregate passes over ever finer grids.

    Every pass evaluates all columns and grid points at once and returns one row. Out of range powers are
    NULL, and such a lambda is never chosen.
    """
    steps = 16
    spans = {c: (low, high) for c in columns}
    best: dict[str, float] = {}
    for _ in range(rounds):
        grid = {c: [spans[c][0] + (spans[c][1] - spans[c][0]) * i / steps for i in range(steps + 1)] for c in columns}
        aggregates = []
        for i, c in enumerate(columns):
            x = F.col(c).cast("double")
            aggregates += [F.count(x).alias(f"n{i}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j{i}")]
            aggregates += [F.var_pop(yeo_johnson(x, lam)).alias(f"v{i}_{g}") for g, lam in enumerate(grid[c])]
        row = df.agg(*aggregates).first()
        for i, c in enumerate(columns):
            scored = []
            for g, lam in enumerate(grid[c]):
                variance = row[f"v{i}_{g}"]
                if variance is not None and 0 < variance < float("inf"):
                    scored.append((-row[f"n{i}"] / 2 * math.log(variance) + (lam - 1) * row[f"j{i}"], lam))
            best[c] = max(scored)[1] if scored else 1.0
            width = (spans[c][1] - spans[c][0]) / steps
            spans[c] = (best[c] - width, best[c] + width)
    return best


def power_transform(df: DataFrame, lambdas: dict[str, float]) -> DataFrame:
    """Applies the fitted transform and standardises to mean 0 and deviation 1."""
    moved = df.withColumns({c: yeo_johnson(F.col(c).cast("double"), lam) for c, lam in lambdas.items()})
    moments = moved.agg(
        *[F.avg(c).alias(f"m_{c}") for c in lambdas], *[F.stddev_pop(c).alias(f"s_{c}") for c in lambdas]
    ).first()
    return moved.withColumns(
        {
            c: (F.col(c) - num(moments[f"m_{c}"] or 0.0)) / num(moments[f"s_{c}"] or 1.0)
            for c in lambdas
        }
    )
