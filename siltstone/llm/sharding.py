"""Reproducible shuffle: a Feistel permutation with cycle walking over row numbers.

Row number x of n rows goes to place p(x); its shard is p(x) mod shards and its
slot p(x) div shards, so shard sizes differ by one at most and slots have no
gaps. Both are computable from x alone, and ``unpermute`` finds the row of any
(shard, slot).

Cases: a null text counts as empty; rows that are equal in all ordering columns
are interchangeable; an empty table gives an empty result; columns of the input
that clash with result columns are replaced by them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import mix
from siltstone.shared import checkpointed

ROUNDS = 8


def _keys(key: str) -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{i}".encode(), digest_size=8).digest(), "big")) for i in range(ROUNDS)]


def _sides(n: int) -> tuple[np.uint64, np.uint64]:
    """A grid of left x right cells, at least n and fewer than n + sqrt(n) + 1."""
    left = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return np.uint64(left), np.uint64(max(1, -(-n // left)))


def _once(x: np.ndarray, n: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    a, b = _sides(n)
    left, right = x // b, x % b
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2 == 0:
            move = mix(right ^ keys[i]) % a
            left = (left + (a - move if back else move)) % a
        else:
            move = mix(left ^ keys[i]) % b
            right = (right + (b - move if back else move)) % b
    return left * b + right


def permute(rows: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The places of row numbers 0..n-1 (or with ``back``, the rows at places)."""
    keys = _keys(key)
    out = _once(rows.astype(np.uint64), n, keys, back)
    while (far := out >= n).any():  # cycle walking: at most sqrt(n) + 1 cells lie outside
        out[far] = _once(out[far], n, keys, back)
    return out.astype(np.int64)


def unpermute(places: np.ndarray, n: int, key: str) -> np.ndarray:
    return permute(places, n, key, back=True)


def number_rows(df: DataFrame, order: list[Column], into: str = "row_number") -> tuple[DataFrame, int]:
    """Adds global row numbers 0..n-1 in the given order, and returns n.

    Rows are dealt out by ranges and sorted inside them; only one count per
    partition comes to the driver.
    """
    part, at = "__part", "__at"
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = {r[part]: r["count"] for r in placed.groupBy(part).count().collect()}
    starts, n = [], 0
    for i in range(max(counts, default=-1) + 1):
        starts.append(n)
        n += counts.get(i, 0)
    start = F.get(F.lit(starts), F.col(part)) if starts else F.lit(0)
    return placed.withColumn(into, (start + F.col(at)).cast("long")).drop(part, at), n


def shard_rows(df: DataFrame, shards: int, key: str, order: list[Column]) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; see the module's text."""
    numbered, n = number_rows(df.drop("shard", "slot"), order, "__row")

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, key))

    return (
        numbered.withColumn("__place", place("__row"))
        .withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.floor(F.col("__place") / shards).cast("long")})
        .drop("__row", "__place")
    )
