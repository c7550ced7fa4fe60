"""Sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, ship

ROUNDS = 6


def _mix(value: np.ndarray, key: int) -> np.ndarray:
    """A round's function: 64-bit multiply-xorshift of a half and the round's key."""
    value = value.astype(np.uint64) + np.uint64(key)
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def permute(rows: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A bijection of 0..total-1.

    The rounds act on a grid of a x b >= total places, a = ceil(sqrt(total)),
    adding a keyed function of one coordinate to the other; a place beyond
    total is sent through again (cycle walking) until it falls inside.
    """
    if total < 2:
        return rows.astype(np.int64)
    a = math.isqrt(total - 1) + 1
    b = -(-total // a)
    keys = [(seed * 0x9E3779B97F4A7C15 + i * 0xD1342543DE82EF95) % (1 << 63) for i in range(ROUNDS)]
    out = rows.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for i, key in enumerate(keys):
            if i % 2:
                right = (right + (_mix(left, key) % np.uint64(b)).astype(np.int64)) % b
            else:
                left = (left + (_mix(right, key) % np.uint64(a)).astype(np.int64)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= total]
    return out


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """Every document's shard and slot under the law ``rows``.

    A document's row number is its place in the order (doc_id, size, checksum);
    the permutation of that number, p, gives shard p mod ``shards`` and slot
    p div ``shards``. So counts differ by one at most, slots have no gaps, and a
    place is computed from the row number, the total and the seed alone. Texts
    stay where they are: only ids, sizes and checksums are sorted.

    Null text: no bytes, size 1, checksum 0. Null ids sort first. Repeated rows
    are rows of their own. An empty table gives an empty result. Other columns
    are not read. Returns doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null), row_number.
    """
    ship(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    rows = cut(slim.repartitionByRange(*order).sortWithinPartitions(*order))
    total = rows.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), total, seed))

    return numbered(rows, "row_number").withColumn("_p", place("row_number")).select(
        *order[:3],
        F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
