"""Sums of doubles that don't depend on how rows are dealt to partitions.

A double below 2**TOP is the sum of LIMBS digits in base 2**BITS, each of which is a small whole number; digits are summed as longs, exactly and in any order, and put
together at the end, always in one order. What lies below 2**(TOP - LIMBS * BITS), 5e-32, is cut from each value. Merging partial sums is
adding longs, so partial aggregation stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, LIMBS, TOP = 26, 8, 104  # up to 2e31; longs hold 1e11 rows


def _whole(x: Column) -> Column:
    """x without its fraction, as a double; from 2**53 on there is none."""
    return F.when(F.abs(x) < F.lit(2.0**53), x.cast("long").cast("double")).otherwise(x)


def _digits(x: Column) -> list[Column]:
    """Every digit comes from x itself: the whole part at its place less that at the place before, both exact."""
    at = lambda k: _whole(x * F.lit(2.0 ** (BITS * (k + 1) - TOP)))
    return [(at(k) - (at(k - 1) * F.lit(2.0**BITS) if k else F.lit(0.0))).cast("long") for k in range(LIMBS)]


def _finite(x: Column) -> Column:
    return F.abs(x) < F.lit(2.0**TOP)


def sums(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: for each name its exact sum and n_<name>, how many values there are. Missing values don't count; values that are infinite, no
    number or beyond 2**TOP make the sum what floating-point addition makes of it."""
    made = df.select(*[c.alias(n) for n, c in columns.items()])
    parts = [c for n in columns for c in (
        *[F.sum(d).alias(f"{n}:{k}") for k, d in enumerate(_digits(F.when(_finite(F.col(f"`{n}`")), F.col(f"`{n}`"))))],
        F.sum(F.when(~_finite(F.col(f"`{n}`")), F.col(f"`{n}`"))).alias(f"{n}:odd"), F.count(f"`{n}`").alias(f"n_{n}"),
    )]
    total = lambda n: reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{n}:{k}`"), F.lit(0)).cast("double") * F.lit(2.0 ** (TOP - BITS * (k + 1))) for k in range(LIMBS)])
    return made.agg(*parts).select(*[c for n in columns for c in (F.coalesce(F.col(f"`{n}:odd`"), total(n)).alias(n), F.col(f"`n_{n}`"))])


def mean_and_deviation(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: m_<name> and s_<name>, the sample deviation, of columns; NULL where there are no or too few values. Squares are taken of what
    is left of the mean, so large values with a small spread lose nothing."""
    col = lambda n: F.col(f"`{n}`")
    first = sums(df, {n: col(n) for n in names})
    means = first.select(*[F.try_divide(n, F.col(f"`n_{n}`").cast("double")).alias(f"m_{n}") for n in names], *[col(f"n_{n}") for n in names])
    rest = df.select(*names).crossJoin(F.broadcast(means))  # one row
    squares = {n: (col(n) - col(f"m_{n}")) * (col(n) - col(f"m_{n}")) for n in names}
    second = sums(rest, squares).select(*[col(n).alias(f"q_{n}") for n in names])
    both = means.crossJoin(F.broadcast(second))  # one row each
    deviation = lambda n: F.when(col(f"n_{n}") > 1, F.sqrt(col(f"q_{n}") / (col(f"n_{n}") - 1)))
    return both.select(*[c for n in names for c in (col(f"m_{n}"), deviation(n).alias(f"s_{n}"))])
