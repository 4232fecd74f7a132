"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, and ranks by a distributed radix sort.

Features are all runs of one and two words (lower-cased A-Z; runs of ASCII digits, a-z and all that isn't ASCII), each in the
bucket that the CRC-32 of its bytes gives. A bucket's gain is the scaled logarithm of its smoothed share in the target over
that in the corpus, a document's weight the floored mean gain, its score the weight plus a Gumbel draw seeded by its id. The
highest scores are a sample without replacement in proportion to the weights.

Texts are worked on as arrays: CRCs of all words of a run at once, counts and sums by bucket index. Each task counts its
buckets before anything is shuffled, and the table of gains has as many entries as there are buckets, whatever the corpus.

Ranks come from stable counting-sort passes over the digits of (score downward, doc_id), lowest digit first. A pass counts
digits by partition; prefix sums over (digit, partition) are the offsets; a row's offset plus its place among the equal digits
of its partition is its destination, and with it the partition it moves to. So no task ever sees more than its share of rows,
however many scores tie, and the last destinations are the ranks.

Nulls: a null text has no features and weight 0. A null doc_id draws with the empty id, and ranks before other ids of its
score. Repeated rows score alike and rank one after the other. Empty tables give an empty result; an empty target gives
gains of its smoothing alone. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut, freeing, partitions, text_chunks

BUCKETS = 10_000
DIGIT_BITS = 12
#: Bytes of a word up to which words are hashed together; longer ones go one by one.
SHORT = 48

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ ((t & np.uint32(1)) * np.uint32(0xEDB88320))
    return t


CRC = _crc_table()


def crc_after(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of words, from given registers; the words go on byte by byte, side by side."""
    out = state.copy()
    long = np.flatnonzero(size > SHORT)
    side = np.where(size > SHORT, 0, size)
    order = np.argsort(-side, kind="stable")
    at, register, longer = start[order], state[order], -side[order]
    for k in range(-int(longer[0]) if order.size else 0):
        n = int(np.searchsorted(longer, -k, "left"))  # words of more than k bytes
        r = register[:n]
        register[:n] = CRC[(r ^ data[at[:n] + k]) & np.uint32(255)] ^ (r >> np.uint32(8))
    out[order] = register
    for i in long:
        a = int(start[i])
        out[i] = zlib.crc32(data[a : a + int(size[i])].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(offsets: np.ndarray, data: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of the pairs of a run of texts, the text of each pair, and the first word of each text."""
    data = LOWER[data]
    inside = INSIDE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(data.size, bool), np.zeros(data.size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    size = end - start
    empty = np.full(start.size, 0xFFFFFFFF, np.uint32)
    ones = crc_after(empty, data, start, size)
    blank = CRC[(ones ^ np.uint32(32)) & np.uint32(255)] ^ (ones >> np.uint32(8))
    text = np.repeat(np.arange(offsets.size - 1), np.diff(first))
    pairs = np.flatnonzero(text[1:] == text[:-1]) if start.size else np.zeros(0, np.int64)
    twos = crc_after(blank[pairs], data, start[pairs + 1], size[pairs + 1])
    invert = np.uint32(0xFFFFFFFF)
    return ((ones ^ invert) % np.uint32(buckets)).astype(np.int64), ((twos ^ invert) % np.uint32(buckets)).astype(np.int64), text[pairs], first


def counts(df: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; each task sums its own, Spark the tasks', and the driver sees one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, offsets, data in text_chunks(batch):
                ones, twos, _, _ = features(offsets, data, buckets)
                total += np.bincount(ones, minlength=buckets) + np.bincount(twos, minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(hit, pa.int32()), "n": pa.array(total[hit], pa.int64())})

    rows = df.select("text").where(F.col("text").isNotNull()).mapInArrow(freeing(run), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus) of each bucket."""
    k = corpus.size
    s, t = int(corpus.sum()) + k, int(target.sum()) + k
    return np.array([math.floor(1000 * math.log((y + 1) * s / ((x + 1) * t))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch):
                ones, twos, owner, first = features(offsets, data, gain.size)
                words = np.diff(first)
                sums = np.concatenate([[0], np.cumsum(gain[ones])])
                total = sums[first[1:]] - sums[first[:-1]]
                sums = np.concatenate([[0], np.cumsum(gain[twos])])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                total += sums[at[1:]] - sums[at[:-1]]
                n = words + np.diff(at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(freeing(run), "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(1000 times a Gumbel draw), seeded by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def digits(column: Column, low: int, high: int, down: bool = False) -> list[Column]:
    """The digits of a whole number between low and high, lowest first; null is below all."""
    value = F.coalesce(F.lit(high) - column if down else column - F.lit(low) + 1, F.lit(0)).cast("long")
    n = max(1, -(-(high - low + 1).bit_length() // DIGIT_BITS))
    return [F.shiftright(value, DIGIT_BITS * i).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int") for i in range(n)]


def counting_pass(rows: DataFrame, digit: Column, chunk: int, parts: int) -> DataFrame:
    """rows (part, place) in the order of a digit; equal digits keep their order. part and place follow."""
    rows = rows.withColumn("digit", digit)
    tally = rows.groupBy("digit", "part").agg(F.count(F.lit(1)).alias("n"))
    # as many rows in one window as there are digits, and as many in the others as there are partitions
    by_digit = tally.groupBy("digit").agg(F.sum("n").alias("all"))
    by_digit = by_digit.select("digit", (F.sum("all").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")).alias("smaller"))
    inside = F.sum("n").over(Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = tally.select("digit", "part", inside.alias("before")).join(by_digit, "digit").select("digit", "part", (F.col("smaller") + F.col("before")).alias("offset"))
    rows = rows.withColumn("here", F.row_number().over(Window.partitionBy("part", "digit").orderBy("place")) - 1).join(offsets, ["part", "digit"])
    rows = rows.withColumn("place", F.col("offset") + F.col("here")).drop("digit", "here", "offset", "part")
    return cut(rows.repartitionById(parts, F.floor(F.col("place") / chunk).cast("int")).withColumn("part", F.floor(F.col("place") / chunk).cast("int")))


def radix_ranked(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """df with place, the rank (from 0) of each row by whole-number columns, given as (name, downward); nulls come first.

    Rows that are equal in all keys keep the order that their partitions had.
    """
    parts = partitions(df.sparkSession)
    id_ = F.monotonically_increasing_id()
    rows = cut(df.withColumn("place", id_).withColumn("part", F.spark_partition_id()))
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, (c, _) in enumerate(keys) for k, f in (("low", F.min), ("high", F.max))]).first()
    chunk = max(1, -(-bounds["n"] // parts))
    for i, (name, down) in reversed(list(enumerate(keys))):
        if bounds[f"low{i}"] is not None:
            for digit in digits(F.col(name), bounds[f"low{i}"], bounds[f"high{i}"], down):
                rows = counting_pass(rows, digit, chunk, parts)
    return rows.drop("part")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score of each row, and the rank (from 1) of those drawn: `percent` of the rows with at
    least `min_words` words, the highest scores first, ties to the smaller doc_id."""
    gain = gains(counts(docs, buckets), counts(target, buckets))
    rows = cut(weights(docs, gain).withColumn("score", F.col("weight") + gumbel(seed)))
    able = F.col("n_words") >= min_words
    sorted_rows = radix_ranked(rows.where(able).select("doc_id", "n_features", "weight", "score"), [("score", True), ("doc_id", False)])
    draws = F.lit(percent * rows.where(able).count() // 100)
    drawn = sorted_rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < draws, F.col("place") + 1).alias("rank"))
    return drawn.unionByName(rows.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
