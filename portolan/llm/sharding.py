"""Shards by a Feistel permutation (operator 8).

Rows get global numbers 0..n-1, in an order that only their contents decide. A balanced Feistel network permutes the smallest
power of four that holds n; a value of n or more is sent through again (cycle walking) until it falls below n, which makes it a
permutation of 0..n-1. Row x goes to shard perm(x) % shards, slot perm(x) // shards. So shard sizes differ by one row at most,
slots have no gaps, and place and row follow from each other without any stored table (`place`, and `row_at` back).

The law is `rows`. Null texts count as empty. Repeated rows are rows of their own; which of equal rows gets which number makes no
difference. Null doc_ids are numbered like any other. An empty table gives an empty result. Only doc_id and text are read by
the query; `sharded` keeps all columns and adds shard and slot (replacing columns of that name).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import mix64, own_name, running_total

ROUNDS = 6


def _half_bits(n: int) -> int:
    """Half the bits of the domain; it has under four times n values (four at least)."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> list[np.uint64]:
    return list(mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed << 8)))


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at each x."""
    half = np.uint64(_half_bits(n))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(seed)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (mix64(left ^ key) & low), left
            else:
                left, right = right, left ^ (mix64(right ^ key) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place(row: Column, n: int, seed: int) -> Column:
    """Column form of the permutation."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    return run(row)


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = 8) -> int:
    """The global row number that lies in this slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(rows: DataFrame, order: list[Column | str]) -> tuple[DataFrame, int]:
    """rows with __n, their global number, and how many there are."""
    found, n = _numbered(rows, order)
    return found.select("row.*", F.col("n").alias(own_name(rows.columns, "__n"))), n


def _numbered(rows: DataFrame, order: list[Column | str]) -> tuple[DataFrame, int]:
    """row (a struct of all columns) and n, the row's global number; and how many there are."""
    count = rows.count()
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[(F.col(f"`{o}`") if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    total = running_total(packed, [], [F.col(f"o{i}") for i in range(len(order))], F.lit(1), count)
    return total.select("row", F.col("__before").alias("n")), count


def sharded(rows: DataFrame, order: list[Column | str], shards: int = 24, seed: int = 8) -> DataFrame:
    """rows with shard and slot; `order`: columns or expressions whose values number the rows."""
    found, n = _numbered(rows, order)
    at = found.withColumn("at", place(F.col("n"), n, seed))
    return at.select(
        *[F.col(f"row.`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")],
        (F.col("at") % shards).cast("int").alias("shard"), F.floor(F.col("at") / shards).cast("long").alias("slot"),
    )
