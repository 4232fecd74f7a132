"""Prefix doubling: exact integer ranks, no hashes.

A position's first rank is by its 8 bytes. At each growing offset the pairs (rank here, rank at the offset) are sorted and
numbered anew; equal pairs get the same rank wherever they stand. Positions alone with their pair are unique from then on
and leave. After the last offset positions of one rank start equal strings of `length` bytes.

ranks_in() does that over the bytes that Spark has dealt to one task. ranks() does it over every position of all texts by
Spark's sort alone: the rank at the offset is read by a range window over the document's own positions, the pairs are dealt
into ranges and sorted, and each range numbers its distinct pairs. suffix_dedup.remove_repeats(every_position=True) runs on
it; all positions are shuffled twice for each offset, so it needs many times its input in disk (README has figures).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut, text_chunks

FIRST = 8
#: Ranks of one range of pairs.
ROOM = 1 << 40


def offsets(length: int) -> list[int]:
    """Where the second half of each pair starts: doubling until the last, which ends at the length."""
    out, have = [], FIRST
    while have < length:
        step = min(have, length - have)
        out.append(step)
        have += step
    return out


def _rerank(here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs of ranks, and how often the pair of each rank stands."""
    _, rank, count = np.unique((here << 32) | there, return_inverse=True, return_counts=True)
    return rank, count


def ranks_in(data: np.ndarray, begin: np.ndarray, width: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that start a string of `length` bytes met again in data, and its rank; strings lie within begin, width."""
    rank = np.full(data.size, -1, np.int64)
    end = np.repeat(begin + width, width)
    at = np.flatnonzero(np.arange(data.size) + FIRST <= end)
    value = np.lib.stride_tricks.sliding_window_view(data, FIRST)[at].view(">u8").ravel() if at.size else np.zeros(0)
    value = value.astype(np.uint64)
    _, first, count = np.unique(value, return_inverse=True, return_counts=True)
    keep = count[first] > 1
    at = at[keep]
    rank[at] = first[keep]
    for step in offsets(length):
        # where the string at the offset leaves its body or is unique, the pair is not met again
        at = at[at + step + FIRST <= end[at]]
        at = at[rank[at + step] >= 0]
        new, count = _rerank(rank[at], rank[at + step])
        keep = count[new] > 1
        at, new = at[keep], new[keep]
        rank[:] = -1
        rank[at] = new
    return at, rank[at]


def ranks_of_rows(rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Ranks of rows of bytes (their number divisible by 8), those of one kind (a small integer) among themselves."""
    _, rank = np.unique(rows.view(np.uint64), return_inverse=True)
    rank = rank.reshape(rows.shape[0], -1)
    while rank.shape[1] > 1:
        odd = rank[:, -1:] if rank.shape[1] % 2 else rank[:, :0]
        pairs, _ = _rerank(rank[:, : rank.shape[1] // 2 * 2 : 2].ravel(), rank[:, 1::2].ravel())
        rank = np.hstack([pairs.reshape(rows.shape[0], -1), odd])
    return _rerank(rank[:, 0], kind.astype(np.int64))[0] if rank.size else np.zeros(rows.shape[0], np.int64)


def _positions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, starts, data in text_chunks(batch):
                at = np.arange(data.size)
                size = np.diff(starts)
                doc = np.repeat(np.arange(hi - lo), size)
                pos = at - starts[doc]
                keep = (size[doc] >= length) & (pos + FIRST <= size[doc])
                rank = np.zeros(data.size, np.uint64)
                for j in range(FIRST):
                    rank = (rank << np.uint64(8)) | data[np.minimum(at + j, data.size - 1)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[lo:hi][doc[keep]]), "pos": pa.array(pos[keep].astype(np.int32)), "rank": pa.array(rank[keep].view(np.int64))})

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rank, next): the pair's number in this range. Rows alone with their pair go; one row is held back."""
    rank = TaskContext.get().partitionId() * ROOM
    held, shared = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches(([held] if held is not None else []) + [batch]).combine_chunks()
        here, there = rows.column("rank").to_numpy(), rows.column("next").to_numpy()
        new = (here[1:] != here[:-1]) | (there[1:] != there[:-1])
        number = rank + np.concatenate([[0], np.cumsum(new)])
        before, after = np.concatenate([[shared], ~new]), ~new
        keep = np.flatnonzero(before[:-1] | after)
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id").take(keep).combine_chunks(), "pos": rows.column("pos").take(keep).combine_chunks(), "rank": pa.array(number[:-1][keep], pa.int64())})
        held, shared, rank = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0], bool(before[-1]), int(number[-1])
    if held is not None and shared:
        yield pa.RecordBatch.from_pydict({"doc_id": held.column("doc_id"), "pos": held.column("pos"), "rank": pa.array([rank], pa.int64())})


def ranks(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, pos, rank of the positions that start a string of `length` bytes which starts elsewhere too.

    texts: doc_id (unique) and text, no nulls. Positions of one document and equal pairs meet in one task each, sorted on
    disk; neither is held in memory.
    """
    found = texts.mapInArrow(_positions(length), "doc_id long, pos int, rank long")
    for step in offsets(length):
        ahead = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(step, step)
        pairs = found.withColumn("next", F.first("rank").over(ahead)).where("next is not null")
        # cut, so that ranges which are dealt again after a lost executor still hold the same pairs
        found = cut(pairs.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").mapInArrow(_number, "doc_id long, pos int, rank long"))
    return found


def covered(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, pos of strings of `length` bytes that start in a document with a smaller doc_id too."""
    found = ranks(texts, length)
    first = found.groupBy("rank").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return found.join(first, "rank").where("doc_id > first").select("doc_id", "pos")
