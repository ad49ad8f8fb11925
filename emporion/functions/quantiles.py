"""Exact quantiles from a sketch and a counting pass, without sorting or gathering a column.

The first pass takes, beside count, minimum and maximum, a mergeable sketch of every column
(``percentile_approx``), whose error in rank is at most 1 / ``ACCURACY`` of the rows.  Its values a
little below and above a wanted rank bracket the answer.  The second pass counts rows: the brackets
of a column divide its values into cells, ``BINS`` inside each bracket and one between two, and each
value falls into one cell.  The running sum of the counts names the cell of a rank, with its smallest
and largest value; a cell of one value settles the rank, so a value that fills a third of all rows
needs no special care.  Only ranks whose cell holds several values are counted again, with that
cell as their bracket: a bracket that misses its rank costs a pass, never a wrong answer.

Counts do not depend on the order of rows, so a stage that is run again after a lost executor gives
the same answer; the sketch, which does, only steers.  At most ``BINS`` + 1 rows a rank reach the driver.

Interpolation follows the linear rule of pandas, Spark ``percentile`` and DuckDB
``quantile_cont``: position ``h = (n - 1)·p``, value ``v[⌊h⌋] + (h - ⌊h⌋)·(v[⌈h⌉] - v[⌊h⌋])``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BINS = 4096
ACCURACY = 20_000

Interval = tuple[float, float]


def _joined(intervals: list[Interval]) -> list[Interval]:
    """Sorted intervals, those that overlap as one."""
    out: list[Interval] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _cell(v: Column, brackets: list[Interval]) -> Column:
    """The number of the cell that a value falls into; cells are numbered in the order of values."""
    cell = F.lit(len(brackets) * (BINS + 1))
    for b in range(len(brackets) - 1, -1, -1):
        lo, hi = brackets[b]
        # Halves keep the width finite for values of opposite sign near the largest double.
        place = F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS) if hi / 2 > lo / 2 else F.lit(0)
        place = F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1))
        place = F.when(v == hi, F.lit(BINS - 1)).when(v == lo, F.lit(0)).otherwise(place)
        first = b * (BINS + 1)
        cell = F.when(v < lo, F.lit(first)).when(v <= hi, place + (first + 1)).otherwise(cell)
    return cell.cast("int")


def _values_at(df: DataFrame, brackets: dict[tuple[str, int], Interval]) -> tuple[dict[tuple[str, int], float], int]:
    """Values at 0-based ranks, and the passes that it took.  ``brackets`` maps (column, rank) to an
    interval that probably holds the value."""
    out: dict[tuple[str, int], float] = {}
    left, passes = dict(brackets), 0
    while left:
        passes += 1
        columns = list(dict.fromkeys(c for c, _ in left))
        cells = []
        for i, c in enumerate(columns):
            v = F.col(c).cast("double")
            own = _joined([x for (name, _), x in left.items() if name == c])
            cells.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("column"), _cell(v, own).alias("cell"), v.alias("v"))))
        rows = (
            df.select(F.explode(F.array(*cells)).alias("x"))
            .where("x IS NOT NULL")
            .groupBy("x.column", "x.cell")
            .agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
            .collect()
        )  # at most BINS + 1 rows a rank
        for i, c in enumerate(columns):
            upto = 0
            wanted = sorted(rank for name, rank in left if name == c)
            for r in sorted((r for r in rows if r["column"] == i), key=lambda r: r["cell"]):
                while wanted and wanted[0] < upto + r["n"]:
                    key = (c, wanted.pop(0))
                    left[key] = (r["lo"], r["hi"])
                    if r["lo"] == r["hi"]:
                        out[key] = left.pop(key)[0]
                upto += r["n"]
    return out, passes


def exact_quantiles_of(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several columns (NULLs ignored; None for a column
    without values)."""
    return quantiles_and(df, columns, probs, [])[0]


def quantiles_and(df: DataFrame, columns: list[str], probs: list[float], more: list[Column]) -> tuple[dict[str, list[float | None]], Row]:
    """The quantiles, and the aggregates ``more`` from their first pass."""
    d = [F.col(c).cast("double") for c in columns]
    near = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in probs for side in (-1, 1)]
    sketch = [F.percentile_approx(v, near, ACCURACY).alias("near") for v in d]
    row = df.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), s).alias(f"s{i}") for i, (v, s) in enumerate(zip(d, sketch))
    ], *more).first()
    stats = dict(zip(columns, row))
    brackets = {}
    for c, s in stats.items():
        for j, p in enumerate(probs if s["n"] else []):
            h = (s["n"] - 1) * p
            lo, hi = s["near"][2 * j : 2 * j + 2]
            brackets |= {(c, r): (lo, hi) for r in (math.floor(h), math.ceil(h))}
    value, _ = _values_at(df, brackets)
    out = {}
    for c, s in stats.items():
        out[c] = []
        for p in probs:
            if not s["n"]:
                out[c].append(None)
                continue
            h = (s["n"] - 1) * p
            lo, hi = value[c, math.floor(h)], value[c, math.ceil(h)]
            out[c].append(lo + (h - math.floor(h)) * (hi - lo))
    return out, row


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles of ``column`` (NULLs ignored)."""
    return exact_quantiles_of(df, [column], probs)[column]


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns from the same passes."""
    return {c: q[0] for c, q in exact_quantiles_of(df, columns, [0.5]).items()}


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, column, [0.5])[0]
