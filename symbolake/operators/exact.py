"""Exact sums of doubles: means and deviations that do not depend on how rows are dealt.

Numbers are added without error: each pass takes from all values the part that a
power of two above their sum lets through, whose sum is exact, and goes on with what
is left until nothing is. A task hands on its sum as a few doubles that do not
overlap, one merge per quantity adds those as fractions, and only the final quotient
or root is rounded, once. Squares are carried as product and error, again exactly.
So a mean is that of rational arithmetic, with the same bits for any partitioning.

Values must be finite; a null counts for nothing. Squares lose exactness where they
underflow (values under 1e-150) and are an error where they overflow.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "i int, x double, n long"


def column_sums(values: np.ndarray) -> list[np.ndarray]:
    """Arrays of one number a column, which add up to the exact sum of each column of a matrix."""
    rest, out = np.array(values, float), []
    if not np.isfinite(rest).all():
        raise ValueError("sums need finite numbers")
    room = 2.0 ** math.ceil(math.log2(len(rest) + 2))
    while len(rest) and rest.any():
        most = np.abs(rest).max(0)
        with np.errstate(divide="ignore", over="ignore"):
            high = np.where(most > 0, room * 2.0 ** np.ceil(np.log2(np.where(most > 0, most, 1.0)) + 1), 0.0)
        if not np.isfinite(high).all() or (high[most > 0] < 2.0**-960).any():
            out += [np.array(row) for row in rest]  # too near the ends of the range for a power above: number by number
            break
        taken = (high + rest) - high
        out.append(taken.sum(0))
        rest = rest - taken
    return out


def squares(values: np.ndarray) -> np.ndarray:
    """Products and their errors, which add up to the exact squares."""
    with np.errstate(over="ignore", invalid="ignore"):
        p, big = values * values, values * 134217729.0
        high = big - (big - values)
        low = values - high
        error = ((high * high - p) + 2 * high * low) + low * low
    if not np.isfinite(p).all():
        raise ValueError("squares are too large")
    return np.concatenate([p, np.where(np.isfinite(error), error, 0.0)])


def expansion(total: Fraction) -> list[float]:
    """A few doubles, the largest first, that add up to a sum of doubles."""
    out = []
    while total:
        head = float(total)
        out.append(head)
        if not head:
            raise ArithmeticError("a sum lies below the smallest double")
        total -= Fraction(head)
    return out


def _merged(table: pa.Table) -> pa.Table:
    """The parts of one quantity as the fewest parts."""
    total, n = sum(map(Fraction, table["x"].to_pylist()), Fraction()), sum(table["n"].to_pylist())
    parts = expansion(total) or [0.0]
    return pa.table({"i": pa.array([table["i"][0].as_py()] * len(parts), pa.int32()), "x": pa.array(parts, pa.float64()), "n": pa.array([n] + [0] * (len(parts) - 1), pa.int64())})


def _rows(sums: dict[int, Fraction], n: int) -> pa.RecordBatch:
    parts = [(i, x, n * (k == 0)) for i, total in sums.items() for k, x in enumerate(expansion(total) or [0.0])]
    i, x, count = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(x, pa.float64()), pa.array(count, pa.int64())], ["i", "x", "n"])


def _totals(parts: DataFrame) -> dict[int, tuple[Fraction, int]]:
    """Exact sum and count of each quantity; the driver receives a few rows for each."""
    out: dict[int, tuple[Fraction, int]] = {}
    for r in parts.groupBy("i").applyInArrow(_merged, PARTS).collect():
        total, n = out.get(r["i"], (Fraction(), 0))
        out[r["i"]] = total + Fraction(r["x"]), n + r["n"]
    return out


def moments(rows: DataFrame, column: str) -> tuple[int, Fraction, Fraction]:
    """Count, exact sum and exact sum of squares of a column."""

    def part(batches):
        n, sums = 0, {0: Fraction(), 1: Fraction()}
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(float)
            n += len(x)
            for i, values in ((0, x), (1, squares(x))):
                sums[i] += sum((Fraction(float(s[0])) for s in column_sums(values[:, None])), Fraction())
        yield _rows(sums, n)

    got = _totals(rows.select(F.col(column).cast("double").alias("x")).mapInArrow(part, PARTS))
    (total, n), (square, _) = got.get(0, (Fraction(), 0)), got.get(1, (Fraction(), 0))
    return n, total, square


def mean_and_deviation(rows: DataFrame, column: str) -> tuple[int, float, float]:
    """Count, mean and population deviation of a column, each rounded once."""
    n, total, square = moments(rows, column)
    if not n:
        return 0, math.nan, math.nan
    return n, float(total / n), root((square - total * total / n) / n)


def root(value: Fraction) -> float:
    """The square root of a fraction, by far more digits than a double has."""
    if value <= 0:
        return 0.0
    with localcontext() as c:
        c.prec = 60
        return float((Decimal(value.numerator) / Decimal(value.denominator)).sqrt())


def column_means(matrices, names: DataFrame) -> list[float]:
    """Means of each element of arrays: ``matrices`` turns an Arrow batch of ``names`` into a matrix."""

    def part(batches):
        n, sums = 0, {}
        for batch in batches:
            m = matrices(batch)
            n += len(m)
            for s in column_sums(m):
                for i in np.flatnonzero(s).tolist():
                    sums[i] = sums.get(i, Fraction()) + Fraction(float(s[i]))
            for i in range(m.shape[1] if len(m) else 0):
                sums.setdefault(i, Fraction())
        yield _rows(sums, n)

    got = _totals(names.mapInArrow(part, PARTS))
    return [float(got[i][0] / got[i][1]) for i in sorted(got)]
