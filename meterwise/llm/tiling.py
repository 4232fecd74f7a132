"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. Rolling Karp-Rabin hashes of five tokens are the seeds of a text.
Spark joins the distinct seeds of documents with those of test items, each with its places, so what a pair shares meets in one
row whose size is the sum of both sides' places, not their product. The longest match of unmarked tokens is marked again and
again until none of five tokens is left (of equally long ones the first in the document, then in the item). Where a pair has
few matching places, neighbouring seeds along each diagonal make its maximal matches; where seeds repeat and there are more
than `CELLS`, hashes of ever shorter runs of seeds are compared instead (the tiles are the same). The tiles don't overlap in the
document or the item, and their order doesn't matter, so reordered passages are found too. A document leaks an item if
the tiles cover at least `threshold` of the item's tokens. An item with fewer than five tokens is matched as a whole.

Documents are read once, whatever the size of the benchmark: a Bloom filter of the items' seeds (16 bits a seed, at most
`BLOOM_BITS`) leaves those positions that may have a partner, and each distinct text is judged once. The items' seeds are
broadcast where their counted size is at most `BROADCAST_BYTES`; beyond, both sides are dealt by (seed, salt).

Result for every row of documents (repeated rows and null ids included, each with a row of its own): doc_id, leaks (item
ids, ascending), coverage and item_id of the best covered item (ties: the least item id; 0.0 and null if no seed is
shared).

Nulls: null and empty texts, and items without tokens or with a null id, leak nothing. Items that repeat count once;
of items with one id and several texts each is tiled, and the best counts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.common import Substrings, cut, documents, freeing, mix, ranges, text_chunks

LEAST = 5
THRESHOLD = 0.5
BLOOM_BITS = 1 << 27
BROADCAST_BYTES = 16 << 20
SALT = 16
INSIDE = np.zeros(256, bool)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POWER = np.uint64(0x9E3779B97F4A7C15)


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts one after the other, and the first token of each."""
    data = LOWER[data]
    if data.size > 1:  # capitals of Latin-1 in two bytes
        tail = data[1:]
        data[1:] = np.where((data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97), tail + 32, tail)
    inside = INSIDE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if data.size else inside
    after = np.concatenate([inside[1:], [False]]) if data.size else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Substrings(data).hash(start, end), np.searchsorted(start, offsets)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of the k tokens from each position on."""
    n = h.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * POWER + h[j : j + n]
    return mix(out)


def tile(matches: list[tuple[int, int, int]], n_doc: int, n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, document start, item start) from maximal matches given alike."""
    used_doc, used_item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    heap = [(-n, p, q) for n, p, q in matches]
    heapq.heapify(heap)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        taken = used_doc[p : p + n] | used_item[q : q + n]
        if not taken.any():
            used_doc[p : p + n] = True
            used_item[q : q + n] = True
            out.append((n, p, q))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), int(p + a), int(q + a)))
    return out


def tiled(pos: np.ndarray, at: np.ndarray, k: int, n_item: int) -> int:
    """Item tokens covered by the greedy tiles of seeds of k tokens at document positions `pos` and item positions `at`."""
    order = np.lexsort((pos, pos - at))
    p, q = pos[order], at[order]
    # a run of seeds on a diagonal is one match
    new = np.flatnonzero(np.concatenate([[True], (np.diff(p - q) != 0) | (np.diff(p) != 1)]))
    length = np.diff(np.append(new, p.size)) + k - 1
    if new.size == 1:
        return int(length[0])
    base = int(p.min())
    return sum(x[0] for x in tile(list(zip(length.tolist(), (p[new] - base).tolist(), q[new].tolist(), strict=True)), int(p.max()) - base + k, n_item, k))


def covered(pos: pa.ListArray, at: pa.ListArray, k: int, n_item: int) -> int:
    """Item tokens covered by the tiles of a pair that shares seeds, each with its places on either side."""
    n_pos, n_at = (x.value_lengths().to_numpy() for x in (pos, at))
    p, q = (x.flatten().to_numpy().astype(np.int64) for x in (pos, at))
    if int(n_pos @ n_at) > CELLS:
        seed = np.arange(n_pos.size)
        return searched(p, np.repeat(seed, n_pos), q, np.repeat(seed, n_at), k)
    # each place of a seed in the document beside each of its places in the item
    each = np.repeat(n_at, n_pos)
    return tiled(np.repeat(p, each), q[ranges(np.repeat(np.cumsum(n_at) - n_at, n_pos), each)], k, n_item)


class Side:
    """The places of shared seeds in a document or an item, in order, those of marked tokens left out."""

    def __init__(self, place: np.ndarray, seed: np.ndarray, k: int):
        order = np.argsort(place, kind="stable")
        self.place, self.k = place[order], k
        self.sums = Substrings.of(mix(seed[order].astype(np.uint64) + np.uint64(1)))
        self.gone = np.zeros(place.size, bool)

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first place of each run of w seeds at places that follow each other, none of them gone."""
        n = self.place.size - w + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        lost = np.concatenate([[0], np.cumsum(self.gone)])
        at = np.flatnonzero((self.place[w - 1 :] - self.place[:n] == w - 1) & (lost[w:] == lost[:n]))
        return self.sums.hash(at, at + w), self.place[at]

    def mark(self, start: int, tokens: int) -> None:
        """Seeds that touch the tokens can't be used any more."""
        self.gone[np.searchsorted(self.place, start - self.k + 1) : np.searchsorted(self.place, start + tokens)] = True


def searched(pos: np.ndarray, pos_seed: np.ndarray, at: np.ndarray, at_seed: np.ndarray, k: int) -> int:
    """Item tokens covered by the greedy tiles, by a search for the longest run of seeds that both sides have."""
    doc, item = Side(pos, pos_seed, k), Side(at, at_seed, k)

    def match(w: int) -> tuple[int, int] | None:
        a, p = doc.windows(w)
        b, q = item.windows(w)
        both = np.isin(a, b)
        if not both.any():
            return None
        first = int(np.argmax(both))
        return int(p[first]), int(q[np.argmax(b == a[first])])

    covered, high = 0, min(pos.size, at.size)
    while high > 0:
        # the longest width that still has a match is between low and high; tiles never grow
        low, best = 0, None
        while low < high:
            w = (low + high + 1) // 2
            found = match(w)
            if found is None:
                high = w - 1
            else:
                low, best = w, found
        if best is None:
            break
        for side, start in ((doc, best[0]), (item, best[1])):
            side.mark(start, low + k - 1)
        covered, high = covered + low + k - 1, low
    return covered


#: Matching places of a pair up to which they are listed one by one.
CELLS = 1 << 12
SEEDS = "seed long, item_id long, version long, at int, k int, n_item int"


def item_seeds(items: DataFrame, least: int = LEAST) -> DataFrame:
    """The seeds of the test items: hash, item (id and text hash), place in the item, width, tokens of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch):
                h, first = tokens(offsets, data)
                size = np.diff(first)
                k = np.minimum(size, least)
                own = [(rolling(h[first[i] : first[i + 1]], int(k[i])) + np.uint64(k[i])) if k[i] else np.zeros(0, np.uint64) for i in range(hi - lo)]
                count = np.array([x.size for x in own])
                row = np.repeat(np.arange(hi - lo), count)
                at = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_pydict({
                    "seed": pa.array(np.concatenate(own).view(np.int64)), "item_id": batch.column("item_id").slice(lo, hi - lo).take(pa.array(row)), "version": batch.column("version").slice(lo, hi - lo).take(pa.array(row)),
                    "at": pa.array(at, pa.int32()), "k": pa.array(k[row], pa.int32()), "n_item": pa.array(size[row], pa.int32()),
                })

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null").withColumn("version", F.xxhash64("text"))
    return rows.dropDuplicates(["item_id", "version"]).mapInArrow(freeing(run), SEEDS)


def _bits(seeds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (seeds & mask).astype(np.int64), ((seeds >> np.uint64(32)) & mask).astype(np.int64)


def bloom(seeds: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of two bits a seed, as bits packed in bytes; Spark sets them, words of 64 reach the driver."""
    size = min(BLOOM_BITS, max(1 << 12, 1 << (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(np.concatenate(_bits(batch.column("seed").to_numpy().view(np.uint64), size)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(bit >> 6), "bits": pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))})

    words = seeds.select("seed").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # BLOOM_BITS / 64 rows at most
    out = np.zeros(size // 64, "<u8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _meet(spark: SparkSession, docs: DataFrame, items: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key) of all documents, and (text_key, item_id, coverage) of each text and item with a common seed."""
    seeds = cut(item_seeds(items, least))
    count, widths = seeds.agg(F.count("*"), F.array_sort(F.collect_set("k"))).first()
    filled = spark.sparkContext.broadcast((bloom(seeds, count), widths))  # BLOOM_BITS / 8 bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, widths = filled.value
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch):
                h, first = tokens(offsets, data)
                seed, pos, text = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for k in widths:
                    r = rolling(h, k) + np.uint64(k)
                    hit = np.arange(r.size)
                    for place in _bits(r, bits.size * 8):
                        hit = hit[(bits[place[hit] >> 3] >> (place[hit] & 7).astype(np.uint8)) & 1 > 0]
                    own = np.searchsorted(first, hit, "right") - 1
                    keep = hit + k <= first[own + 1]
                    seed.append(r[hit[keep]])
                    text.append(own[keep])
                    pos.append(hit[keep] - first[own[keep]])
                seed, pos, text = np.concatenate(seed), np.concatenate(pos), np.concatenate(text)
                order = np.lexsort((pos, seed, text))
                seed, pos, text = seed[order], pos[order], text[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(seed) != 0) | (np.diff(text) != 0)])) if seed.size else np.zeros(0, np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(new, seed.size), pa.int32()), pa.array(pos, pa.int32()))
                ends = pa.array(np.searchsorted(text[new], np.arange(hi - lo + 1)), pa.int32())
                hits = pa.StructArray.from_arrays([pa.array(seed[new].view(np.int64)), places], ["seed", "pos"])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "text_key": batch.column("text_key").slice(lo, hi - lo), "hits": pa.ListArray.from_arrays(ends, hits)})

    rows = documents(docs).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    rows = cut(rows.mapInArrow(freeing(run), "doc_id long, text_key binary, hits array<struct<seed:long,pos:array<int>>>"))
    # equal texts have equal hits, so one of them does; they combine before the shuffle
    texts = rows.where(F.size("hits") > 0).groupBy("text_key").agg(F.any_value("hits").alias("hits"))
    found = texts.select("text_key", F.explode("hits").alias("h")).select("text_key", "h.seed", "h.pos")
    seeds = cut(seeds.groupBy("seed", "item_id", "version", "k", "n_item").agg(F.collect_list("at").alias("at")))
    if count * 64 <= BROADCAST_BYTES:
        met = found.join(F.broadcast(seeds), "seed")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = found.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALT)).cast("int")).join(salted, ["seed", "salt"])
    pairs = met.groupBy("text_key", "item_id", "version", "k", "n_item").agg(F.collect_list(F.struct("pos", "at")).alias("m"))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m")
            ends, shared = m.offsets.to_numpy(), m.values
            pos, at = shared.field(0), shared.field(1)
            k, n = batch.column("k").to_numpy(), batch.column("n_item").to_numpy()
            share = [covered(pos[a:b], at[a:b], int(k[i]), int(n[i])) / int(n[i]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
            yield pa.RecordBatch.from_pydict({"text_key": batch.column("text_key"), "item_id": batch.column("item_id"), "coverage": pa.array(share, pa.float64())})

    return rows, pairs.mapInArrow(freeing(cover), "text_key binary, item_id long, coverage double")


def scores(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """doc_id, leaks, coverage and item_id of every row of documents; items: item_id, text."""
    rows, covered = _meet(docs.sparkSession, docs, items, least)
    best = F.max_by(F.struct("coverage", "item_id"), F.struct("coverage", -F.col("item_id")))
    leaks = F.array_sort(F.collect_set(F.when(F.col("coverage") >= threshold, F.col("item_id"))))
    judged = covered.groupBy("text_key").agg(leaks.alias("leaks"), best.alias("b"))
    # only texts with a common seed have a judgement; the others don't wait for one
    some = rows.where(F.size("hits") > 0).select("doc_id", "text_key").join(judged, "text_key", "left")
    none = F.array().cast("array<long>")
    out = some.select("doc_id", F.coalesce("leaks", none).alias("leaks"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.col("b.item_id").alias("item_id"))
    return out.unionByName(rows.where(F.size("hits") == 0).select("doc_id", none.alias("leaks"), F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id")))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    _, covered = _meet(docs.sparkSession, docs, items, least)
    leaking = cut(covered.where(F.col("coverage") >= threshold).select("text_key").distinct())
    key = "text_key"
    while key in docs.columns:
        key += "_"
    leaking = leaking.withColumnRenamed("text_key", key)
    if leaking.count() * 64 <= BROADCAST_BYTES:
        leaking = F.broadcast(leaking)
    return docs.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))).join(leaking, key, "left_anti").drop(key)
