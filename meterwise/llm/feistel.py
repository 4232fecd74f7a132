"""Sharding by a keyed permutation: Feistel rounds with cycle walking over global row numbers.

The row number of a document is its rank by (doc_id, text_crc32, size); the permuted number p gives
shard = p mod shards and slot = p div shards, so counts of shards differ by one at most, slots have no gaps, and
both can be computed (and inverted) from the row number, the row count and the key alone.

Nulls: a null doc_id ranks before all others. Repeated rows get row numbers of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm.common import cut, mix, partitions

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, bits: int, key: int, order: range) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    forward = order.step > 0
    for r in order:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
        if forward:
            left, right = right, left ^ (mix(right + salt) & mask)
        else:
            left, right = right ^ (mix(left + salt) & mask), left
    return (left << np.uint64(bits)) | right


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number 0..n-1 in the shuffle (or the way back), always inside 0..n-1.

    A Feistel network permutes the next power of four; values outside 0..n-1 walk on along their cycle.
    """
    bits, order = _half_bits(n), range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = _rounds(np.asarray(x).astype(np.uint64), bits, key, order)
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = _rounds(out[outside], bits, key, order)
    return out.astype(np.int64)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_no (0-based rank by `order`), and the row count.

    Ranges of rows are sorted apart; only one count for each range reaches the driver.
    """
    n = partitions(df.sparkSession)
    runs = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = cut(runs.withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in runs.groupBy(part.alias("p")).count().collect()}
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    starts = df.sparkSession.createDataFrame([(int(p), int(s)) for p, s in first.items()] or [(0, 0)], "p long, s long")
    out = runs.withColumn("_p", part.cast("long")).join(F.broadcast(starts), F.col("_p") == F.col("p"), "left")
    return out.withColumn("row_no", F.col("s") + at).drop("_p", "p", "s", "_id"), total


def shard(docs: DataFrame, shards: int = 8, key: int = 20_260_101) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, row_no, shard, slot of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, total = numbered(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, key))

    rows = rows.withColumn("_place", place("row_no"))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_no",
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
    )


def row_of(shard_no: int, slot: int, shards: int, total: int, key: int = 20_260_101) -> int:
    """The row number that stands at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard_no]), total, key, inverse=True)[0])
