"""Exact quantiles whose memory does not grow with the table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credilake.functions.arithmetic import num

# Cells that a bracket is cut into per pass, and values that a bracket may hold to be looked at one by one.
CELLS = 256
LISTED_VALUES = 2048


@dataclass
class _Bracket:
    """Values of one column from ``low`` to ``high``: how many lie below it and in it."""

    column: int
    low: float
    high: float
    below: int
    count: int


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], cells: int = CELLS, listed: int = LISTED_VALUES
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, NULL and NaN left out; one list per column.

    The same at every size: the values between a column's extremes are counted in cells, the cells that hold a
    wanted rank are cut again, until each holds few values (or a single one, however often). These are counted
    singly. A pass is one map-side-combined aggregate for all columns; its result has at most ``cells`` rows
    for each rank looked for.
    """
    indexed = range(len(columns))
    values = df.select(
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    first = values.agg(
        *[f(F.col(f"v{i}")).alias(f"{n}{i}") for i in indexed for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    ranks = {
        (i, r): None
        for i in indexed
        if first[f"n{i}"]
        for p in probabilities
        for r in (math.floor(p * (first[f"n{i}"] - 1)), math.ceil(p * (first[f"n{i}"] - 1)))
    }
    open_ = [_Bracket(i, first[f"lo{i}"], first[f"hi{i}"], 0, first[f"n{i}"]) for i in indexed if first[f"n{i}"]]
    small: list[_Bracket] = []
    while open_:
        waiting = []
        for b in open_:
            wanted = [k for k in ranks if k[0] == b.column and b.below <= k[1] < b.below + b.count]
            if not wanted:
                continue
            if b.low == b.high:
                ranks.update(dict.fromkeys(wanted, b.low))
            elif b.count <= listed:
                small.append(b)
            else:
                waiting.append(b)
        open_ = _cut(values, waiting, cells) if waiting else []
    for b, found in zip(small, _listed(values, small)):
        at = b.below
        for value, n in sorted(found):
            for k in ranks:
                if k[0] == b.column and at <= k[1] < at + n:
                    ranks[k] = value
            at += n

    def quantile(i: int, p: float) -> float:
        position = p * (first[f"n{i}"] - 1)
        lower, upper = math.floor(position), math.ceil(position)
        a, b = ranks[i, lower], ranks[i, upper]
        return a if a == b else (upper - position) * a + (position - lower) * b

    return {c: [quantile(i, p) if first[f"n{i}"] else None for p in probabilities] for i, c in enumerate(columns)}


def _inside(b: _Bracket):
    return F.col(f"v{b.column}").between(num(b.low), num(b.high))


def _cut(values: DataFrame, brackets: list[_Bracket], cells: int) -> list[_Bracket]:
    """The non-empty cells of the brackets. Cells are monotone in the value, whatever the rounding, and a
    bracket's own extremes fall into different ones, so that each pass makes progress."""

    def cell(b: _Bracket):
        # halves, so that the width of the widest bracket is finite
        v, low, high = (F.col(f"v{b.column}") / num(2)), num(b.low / 2), num(b.high / 2)
        at = F.least(F.floor((v - low) / (high - low) * num(cells)), F.lit(cells - 1))
        return F.when(F.col(f"v{b.column}") == num(b.high), F.lit(cells)).otherwise(at).cast("int")

    entries = [
        F.when(_inside(b), F.struct(F.lit(j).alias("j"), cell(b).alias("cell"), F.col(f"v{b.column}").alias("v")))
        for j, b in enumerate(brackets)
    ]
    rows = (
        values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.j", "e.cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("e.v").alias("low"), F.max("e.v").alias("high"))
        .collect()
    )
    out = []
    at = {j: b.below for j, b in enumerate(brackets)}
    for r in sorted(rows, key=lambda r: (r["j"], r["cell"])):
        out.append(_Bracket(brackets[r["j"]].column, r["low"], r["high"], at[r["j"]], r["n"]))
        at[r["j"]] += r["n"]
    return out


def _listed(values: DataFrame, brackets: list[_Bracket]) -> list[list[tuple[float, int]]]:
    """The values of each bracket with their counts."""
    out: list[list[tuple[float, int]]] = [[] for _ in brackets]
    if brackets:
        entries = [
            F.when(_inside(b), F.struct(F.lit(j).alias("j"), F.col(f"v{b.column}").alias("v"))) for j, b in enumerate(brackets)
        ]
        exploded = values.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        for r in exploded.groupBy("e.j", "e.v").agg(F.count(F.lit(1)).alias("n")).collect():
            out[r["j"]].append((r["v"], r["n"]))
    return out
