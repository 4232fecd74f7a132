"""What the text operators share: columns, staging, and vectorised byte and word hashing.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text;
* only the named columns are read, so extra columns (also with names an operator uses inside) are harmless;
* rows are taken as they come: repeated rows give repeated results, and an empty table gives an empty result
  of the same schema.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.sources.tables import shared_folder

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cannot take it away."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) of a table of documents, under these names whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


@lru_cache(4)
def byte_values(seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, MASK, 256, dtype=np.uint64) | np.uint64(1)


_grown: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; one pair of arrays is kept, and grows."""
    if not _grown or _grown[0].size < n:
        _grown.clear()
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n + n // 8, b, np.uint64)
            p[0] = 1
            _grown.append(np.multiply.accumulate(p))
    return _grown[0], _grown[1]


def freeing(run):
    """A function over batches that gives memory back at the end; workers live on and serve later stages."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def freed(f):
    """A function of one group's table that gives memory back when it is done."""

    def inner(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            release()

    return inner


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Substrings:
    """Karp-Rabin prefix sums over bytes: the hash of any substring in constant time, wherever it stands."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        powers, self.inverse = _powers(max(4096, data.size + 1))
        self.sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(byte_values(seed)[data] * powers[: data.size], out=self.sums[1:])

    @classmethod
    def of(cls, values: np.ndarray) -> Substrings:
        """Over 64-bit values in place of bytes."""
        out = cls.__new__(cls)
        powers, out.inverse = _powers(max(4096, values.size + 1))
        out.sums = np.zeros(values.size + 1, np.uint64)
        np.cumsum(values * powers[: values.size], out=out.sums[1:])
        return out

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        n = self.sums.size - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n] + np.uint64(k)) if n > 0 else np.zeros(0, np.uint64)


def text_chunks(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) of runs of rows with about `most` bytes; a longer text makes its own run."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(col))
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the words (split at ASCII white space) of a run of texts, and the first word of each text."""
    inside = ~WHITE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True  # a word ends with its text
    before = np.concatenate([[False], inside[:-1]]) if data.size else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if data.size else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def pack(**arrays: np.ndarray) -> dict[str, bytes]:
    return {k: np.ascontiguousarray(v).tobytes() for k, v in arrays.items()}


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers starts[i] .. starts[i] + counts[i] - 1, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)
