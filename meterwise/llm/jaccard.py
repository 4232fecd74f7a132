"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (words split at white space; one to four words are one shingle). Two
documents are linked if the Jaccard similarity of their sets is at least the threshold.

1. Each document gets 96 MinHash values. Bands of four of them are dealt by value; documents that meet in a band are
   joined to the first of the band (in each task before the shuffle, then over all tasks), and the connected
   components of these joins are the candidate groups. At 0.8 a pair meets in no band with a chance of 3e-6.
2. In a group, copies of one set are one entry with a count. Entries are dealt in blocks of at most 4096, so a group
   of any size is many tasks. For each pair of blocks the MinHash values of pairs that share a band are compared 32 at
   a time, and pairs whose posterior probability of reaching the threshold (uniform prior) falls below the tolerance
   are dropped. Pairs of a group that is only a chain of band hits are not compared.
3. What is left is verified exactly by shingles. No pairs leave a task: only each entry's number of links and one edge
   to the component it has in the task.

A block sends its entries to other blocks as differences from the shingles that most of it shares.

Result: doc_id, set_id (the smallest doc_id with the same set), class_id (the smallest doc_id of the connected
component of links) and n_links (documents linked to it, copies included) for each distinct doc_id.

Nulls: a null text is empty; documents without words have no links and a class of their own. Rows with one doc_id are
one document, with the text whose set digest is least. Rows with a null doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import Substrings, cut, documents, freeing, mix, partitions, ranges, release, text_chunks, words
from meterwise.llm.components import components

SIZE = 5
THRESHOLD = 0.8
HASHES, BAND, STEP = 96, 4, 32
BLOCK = 4096
#: Shingles of the corpus for each deal of groups.
DEAL = 1 << 20
TOLERANCE = 1e-6
_rng = np.random.default_rng(5)
MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)


def shingles(offsets: np.ndarray, data: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, one text after the other, and where each text starts."""
    start, end, first = words(offsets, data)
    h = Substrings(data).hash(start, end)
    n = np.diff(first)
    row = np.repeat(np.arange(n.size), np.where(n >= size, n - size + 1, np.minimum(n, 1)))
    at = ranges(first[:-1], np.bincount(row, minlength=n.size)) if n.size else row
    width = np.minimum(n, size)[row]
    out = np.zeros(at.size, np.uint64)
    for j in range(size):
        inside = width > j
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + h[at[inside] + j])
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(out.size, bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(n.size + 1))


def minhash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits for each set; sets must not be empty."""
    out = np.empty((first.size - 1, HASHES), np.uint32)
    turned = np.empty_like(values)
    for i in range(HASHES):  # shingle hashes are mixed already, so an odd factor gives another order of them
        np.multiply(values, MULTIPLY[i], out=turned)
        out[:, i] = np.minimum.reduceat(turned, first[:-1]) >> np.uint64(32)
    return out


SIGNED = "doc_id long, n int, key long, keys binary, signature binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, offsets, data in text_chunks(batch):
                values, first = shingles(offsets, data, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                keys = np.zeros(n.size, np.uint64)
                bands = [b""] * n.size
                signatures = [b""] * n.size
                if full.size:
                    keys[full] = mix(np.add.reduceat(mix(values), first[:-1][full]) + n[full].astype(np.uint64))
                    sig = minhash(values, np.append(first[:-1][full], values.size))
                    band = np.zeros((full.size, HASHES // BAND), np.uint64)
                    for j in range(BAND):
                        band = mix(band + sig[:, j::BAND].astype(np.uint64) + np.uint64(j))
                    band = mix(band + np.arange(HASHES // BAND, dtype=np.uint64))
                    low = (sig & np.uint32(0xFFFF)).astype("<u2")
                    for i, f in enumerate(full):
                        bands[f] = band[i].tobytes()
                        signatures[f] = low[i].tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n": pa.array(n, pa.int32()), "key": pa.array(keys.view(np.int64)),
                    "keys": pa.array(bands, pa.binary()), "signature": pa.array(signatures, pa.binary()),
                })

    return run


def _meet_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins inside a task; the first document of each band value goes on to the others' (b null)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
        doc = np.repeat(ids, HASHES // BAND)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(key.size, bool)
        new[1:] = key[1:] != key[:-1]
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if key.size else doc
        pairs = np.unique(np.stack([doc[first != doc], first[first != doc]], 1), axis=0)
        k = np.concatenate([key[new], np.zeros(len(pairs), np.int64)])
        b = np.concatenate([np.zeros(int(new.sum()), np.int64), pairs[:, 1]])
        yield pa.RecordBatch.from_pydict({"key": pa.array(k), "a": pa.array(np.concatenate([doc[new], pairs[:, 0]])), "b": pa.array(b, mask=np.arange(k.size) < new.sum())})


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, a): an edge from each to the first of its key."""
    last_key, last_doc = None, None
    for batch in batches:
        key, doc = batch.column("key").to_numpy(), batch.column("a").to_numpy()
        if not key.size:
            continue
        new = np.ones(key.size, bool)
        new[1:] = key[1:] != key[:-1]
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if last_key is not None and key[0] == last_key:
            first[key == last_key] = last_doc
        last_key, last_doc = key[-1], first[-1]
        hit = first != doc
        pairs = np.unique(np.stack([doc[hit], first[hit]], 1), axis=0)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For 32, 64, 96 compared values, the fewest equal ones at which the posterior still reaches the tolerance."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(logs - logs.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


class Entries:
    """Distinct sets of a block: doc ids, copies, signatures, and shingles as one sorted run for each."""

    def __init__(self, docs: np.ndarray, copies: np.ndarray, signatures: np.ndarray, values: np.ndarray, first: np.ndarray):
        self.docs, self.copies, self.signatures, self.values, self.first = docs, copies, signatures, values, first

    def to_bytes(self) -> dict[str, bytes]:
        """As differences from the shingles that more than half of the entries have."""
        row = np.repeat(np.arange(self.docs.size), np.diff(self.first))
        common, inverse, count = np.unique(self.values, return_inverse=True, return_counts=True)
        most = count * 2 > self.docs.size
        place = np.cumsum(most) - 1
        is_common = most[inverse]
        common = common[most]
        have = np.zeros((self.docs.size, common.size), bool)
        have[row[is_common], place[inverse[is_common]]] = True
        lack_row, lack = np.nonzero(~have)
        return {
            "docs": self.docs.tobytes(), "copies": self.copies.tobytes(), "signatures": self.signatures.tobytes(), "common": common.tobytes(),
            "lack": lack.astype("<u4").tobytes(), "n_lack": np.bincount(lack_row, minlength=self.docs.size).astype("<u4").tobytes(),
            "more": self.values[~is_common].tobytes(), "n_more": np.bincount(row[~is_common], minlength=self.docs.size).astype("<u4").tobytes(),
        }

    @classmethod
    def from_bytes(cls, x: dict[str, bytes]) -> Entries:
        docs = np.frombuffer(x["docs"], np.int64)
        common = np.frombuffer(x["common"], np.uint64)
        have = np.ones((docs.size, common.size), bool)
        have[np.repeat(np.arange(docs.size), np.frombuffer(x["n_lack"], "<u4")), np.frombuffer(x["lack"], "<u4")] = False
        row, at = np.nonzero(have)
        rows = np.concatenate([row, np.repeat(np.arange(docs.size), np.frombuffer(x["n_more"], "<u4"))])
        values = np.concatenate([common[at], np.frombuffer(x["more"], np.uint64)])
        order = np.lexsort((values, rows))
        return cls(docs, np.frombuffer(x["copies"], np.int64), np.frombuffer(x["signatures"], "<u2").reshape(docs.size, HASHES), values[order], np.searchsorted(rows[order], np.arange(docs.size + 1)))


def meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signatures share a band (its four values as one word)."""
    x, y = (np.ascontiguousarray(s).view("<u8") for s in (a, b))
    out = np.zeros((len(a), len(b)), bool)
    for t in range(x.shape[1]):
        values, inverse = np.unique(np.concatenate([x[:, t], y[:, t]]), return_inverse=True)
        left, right = inverse[: len(a)], inverse[len(a) :]
        n_left, n_right = np.bincount(left, minlength=values.size), np.bincount(right, minlength=values.size)
        both = n_left * n_right
        if both.sum() * 16 > out.size:
            for lo in range(0, len(a), 256):
                out[lo : lo + 256] |= left[lo : lo + 256, None] == right[None, :]
            continue
        first = np.cumsum(n_right) - n_right
        own = both[left] > 0
        count = n_right[left[own]]
        out[np.repeat(np.flatnonzero(own), count), np.argsort(right, kind="stable")[ranges(first[left[own]], count)]] = True
    return out


def candidates(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs that share a band stay possible, comparing values in steps; of one block with itself, above the diagonal."""
    out = np.triu(meetings(a, b), 1) if a is b else meetings(a, b)
    if out.sum() * 16 <= out.size:
        i, j = np.nonzero(out)
        equal = np.zeros(i.size, np.int64)
        for n in range(0, HASHES, STEP):
            for lo in range(0, i.size, 1 << 16):
                own = slice(lo, lo + (1 << 16))
                equal[own] += (a[i[own], n : n + STEP] == b[j[own], n : n + STEP]).sum(1)
            stay = equal >= least[n + STEP]
            out[i[~stay], j[~stay]] = False
            i, j, equal = i[stay], j[stay], equal[stay]
        return out
    columns = np.ascontiguousarray(b.T)
    for lo in range(0, len(a), 256):
        tile, frm = a[lo : lo + 256], lo if a is b else 0
        left = out[lo : lo + 256, frm:]
        equal = np.zeros(left.shape, np.uint8)
        for n in range(0, HASHES, STEP):
            for j in range(n, n + STEP):
                equal += tile[:, j, None] == columns[None, j, frm:]
            left &= equal >= least[n + STEP]
            if not left.any():
                break
    return out


def intersections(a: Entries, b: Entries, pairs: np.ndarray) -> np.ndarray:
    """Shared shingles of all pairs (those that matter: pairs)."""
    if pairs.sum() <= 4 * (len(a.docs) + len(b.docs)):
        out = np.zeros(pairs.shape, np.float32)
        for i, j in zip(*np.nonzero(pairs), strict=True):
            x, y = a.values[a.first[i] : a.first[i + 1]], b.values[b.first[j] : b.first[j + 1]]
            at = np.searchsorted(y, x)
            out[i, j] = (y[np.minimum(at, y.size - 1)] == x).sum()
        return out
    both = np.intersect1d(a.values, b.values)
    parts = []
    for e in (a, b):
        row = np.repeat(np.arange(e.docs.size), np.diff(e.first)).astype(np.int32)
        col = np.minimum(np.searchsorted(both, e.values), both.size - 1)
        keep = both[col] == e.values
        order = np.argsort(col[keep], kind="stable")
        parts.append((row[keep][order], col[keep][order]))
    out = np.zeros(pairs.shape, np.float32)
    (ra, ca), (rb, cb) = parts
    count = np.bincount(ca, minlength=both.size) * np.bincount(cb, minlength=both.size)
    fa, fb = np.searchsorted(ca, np.arange(both.size + 1)), np.searchsorted(cb, np.arange(both.size + 1))
    # shingles with few pairs are counted pair by pair, the others by matrix products
    flat = out.reshape(-1)
    rare = np.flatnonzero(count <= 1024)
    for lo in range(0, rare.size, 4096):
        c = rare[lo : lo + 4096]
        na, nb = fa[c + 1] - fa[c], fb[c + 1] - fb[c]
        left, right = np.repeat(ranges(fa[c], na), np.repeat(nb, na)), None
        right = ranges(np.repeat(fb[c], na), np.repeat(nb, na))
        np.add.at(flat, ra[left].astype(np.int64) * pairs.shape[1] + rb[right], 1)
    often = np.flatnonzero(count > 1024)
    for lo in range(0, often.size, 512):
        c = often[lo : lo + 512]
        x, y = np.zeros((len(a.docs), c.size), np.float32), np.zeros((len(b.docs), c.size), np.float32)
        for m, r, f in ((x, ra, fa), (y, rb, fb)):
            n = f[c + 1] - f[c]
            m[r[ranges(f[c], n)], np.repeat(np.arange(c.size), n)] = 1
        for t in range(0, len(x), 1024):
            frm = t if a is b else 0
            out[t : t + 1024, frm:] += x[t : t + 1024] @ y[frm:].T
    return out


def linked(a: Entries, b: Entries, threshold: float, tolerance: float) -> np.ndarray:
    pairs = candidates(a.signatures, b.signatures, least_matches(threshold, tolerance))
    if not pairs.any():
        return pairs
    shared = intersections(a, b, pairs)
    rows, columns = np.diff(a.first), np.diff(b.first)
    for lo in range(0, len(rows), 256):
        part = shared[lo : lo + 256].astype(np.float64)
        # a margin for the float threshold, far below the step from one ratio of such sizes to the next
        pairs[lo : lo + 256] &= part >= (threshold - 1e-9) * (rows[lo : lo + 256, None] + columns[None, :] - part)
    return pairs | pairs.T if a is b else pairs


FOUND = "kind int, doc_id long, value long, root long, block int, docs binary, copies binary, signatures binary, common binary, lack binary, n_lack binary, more binary, n_more binary"
LINKS, EDGE, PAYLOAD = 0, 1, 2
PARTS = ("docs", "copies", "signatures", "common", "lack", "n_lack", "more", "n_more")


def _weigh(links: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The copies that each row links to."""
    return np.concatenate([np.where(links[lo : lo + 256], copies, 0).sum(1) for lo in range(0, len(links), 256)])


def _labels(links: np.ndarray) -> np.ndarray:
    """The least index of each row's component in a symmetric relation."""
    label = np.arange(len(links))
    while True:
        least = label.copy()
        for lo in range(0, len(links), 512):
            tile = links[lo : lo + 512]
            least[lo : lo + 512] = np.minimum(least[lo : lo + 512], np.where(tile, label[None, :], len(links)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _rows(links: list, edges: list, payloads: list) -> pa.Table:
    cols: dict[str, list] = {k.split()[0]: [] for k in FOUND.split(", ")}
    for kind, rows in ((LINKS, links), (EDGE, edges)):
        for docs, values in rows:
            cols["kind"] += [kind] * len(docs)
            cols["doc_id"] += docs.tolist()
            cols["value"] += values.tolist()
    n = len(cols["kind"])
    for k in cols:
        cols[k] += [None] * (n - len(cols[k]))
    for root, block, blocks, parts in payloads:
        for k, v in {"kind": PAYLOAD, "doc_id": None, "value": blocks, "root": root, "block": block, **parts}.items():
            cols[k].append(v)
    types = {"kind": pa.int32(), "block": pa.int32(), "doc_id": pa.int64(), "value": pa.int64(), "root": pa.int64()}
    return pa.table({k: pa.array(v, types.get(k, pa.binary())) for k, v in cols.items()})


def _block(size: int, threshold: float, tolerance: float):
    """All groups that a task was dealt, each whole or one block of a large one."""

    def run(table: pa.Table) -> pa.Table:
        links, edges, payloads = [], [], []
        table = table.sort_by([("root", "ascending"), ("block", "ascending"), ("doc_id", "ascending")])
        docs, roots, blocks, many = (table.column(k).to_numpy() for k in ("doc_id", "root", "block", "blocks"))
        keys, copies = table.column("key").to_numpy(), table.column("copies").to_numpy()
        new = np.ones(docs.size, bool)
        new[1:] = (roots[1:] != roots[:-1]) | (blocks[1:] != blocks[:-1])
        cuts = np.append(np.flatnonzero(new), docs.size)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(lo, hi - lo).select(["text", "signature"]).combine_chunks().to_batches()
            values, count = [], []
            for batch in part:
                for _, _, offsets, data in text_chunks(batch):
                    v, f = shingles(offsets, data, size)
                    values.append(v)
                    count.append(np.diff(f))
            values, first = np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(count))])
            sums = np.add.reduceat(mix(values), first[:-1]) if values.size else np.zeros(hi - lo, np.uint64)
            own = mix(sums + np.diff(first).astype(np.uint64)).view(np.int64) == keys[lo:hi]
            # one row for each document, with the text that was signed
            keep = np.flatnonzero(own)
            keep = keep[np.unique(docs[lo:hi][keep], return_index=True)[1]]
            n = np.diff(first)[keep]
            signatures = np.frombuffer(b"".join(table.column("signature").slice(lo, hi - lo).take(keep).to_pylist()), "<u2").reshape(-1, HASHES)
            e = Entries(docs[lo:hi][keep], copies[lo:hi][keep], signatures, values[ranges(first[keep], n)], np.concatenate([[0], np.cumsum(n)]))
            found = linked(e, e, threshold, tolerance)
            links.append((e.docs, _weigh(found, e.copies)))
            edges.append((e.docs, e.docs[_labels(found)]))
            if many[lo] > 1:
                payloads.append((int(roots[lo]), int(blocks[lo]), int(many[lo]), e.to_bytes()))
        out = _rows(links, edges, payloads)
        release()
        return out

    return run


def _across(threshold: float, tolerance: float):
    """Two blocks of one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (Entries.from_bytes({k: batch.column(f"{side}_{k}")[i].as_py() for k in PARTS}) for side in "ab")
                found = linked(a, b, threshold, tolerance)
                if not found.any():
                    continue
                whole = np.zeros((len(a.docs) + len(b.docs),) * 2, bool)
                whole[: len(a.docs), len(a.docs) :] = found
                whole[len(a.docs) :, : len(a.docs)] = found.T
                docs = np.concatenate([a.docs, b.docs])
                out = _rows([(a.docs, _weigh(found, b.copies)), (b.docs, _weigh(found.T, a.copies))], [(docs, docs[_labels(whole)])], [])
                yield from out.select(["kind", "doc_id", "value"]).to_batches()

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SIZE, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, set_id, class_id, n_links of each document."""
    n = partitions(docs.sparkSession)
    rows = documents(docs).where("doc_id is not null")
    signed = rows.mapInArrow(freeing(_sign(size)), SIGNED)
    signed = cut(signed)
    one = signed.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("n").alias("n"))

    met = signed.where("n > 0").select("doc_id", "keys").mapInArrow(_meet_here, "key long, a long, b long")
    over = met.where("b is null").select("key", "a").repartition(n, "key").sortWithinPartitions("key", "a").mapInArrow(_meet, "a long, b long")
    groups = cut(components(met.where("b is not null").select("a", "b").unionByName(over)))

    # copies of a set share every band, so a set lies in one group
    members = groups.join(one, F.col("node") == F.col("doc_id")).select("doc_id", "root", "key")
    sets = cut(members.groupBy("root", "key").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies")))
    sizes = sets.groupBy("root").agg(F.count("*").alias("m")).where("m > 1")
    entries = sets.join(sizes, "root").select(
        F.col("set_id").alias("doc_id"), "root", "key", "copies", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.pmod(F.xxhash64("set_id"), F.ceil(F.col("m") / block)).cast("int").alias("block")
    )
    signatures = signed.groupBy("doc_id", "key").agg(F.min("signature").alias("signature"))
    entries = entries.join(signatures, ["doc_id", "key"])
    # whole groups share deals, a block of a large group has its own; there are as many deals as the shingles ask for
    total = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(max(8 * n, total // DEAL)))).otherwise(F.xxhash64("root", "block"))
    dealt = entries.join(rows, "doc_id").withColumn("deal", deal)
    found = cut(dealt.repartition(n, "deal").groupBy("deal").applyInArrow(_block(size, threshold, tolerance), FOUND))
    # a block goes to each pair of blocks that it is in; pairs are dealt one by one, however many a group has
    payload = found.where(F.col("kind") == PAYLOAD).select("root", "block", *PARTS, F.explode(F.sequence(F.lit(0), F.col("value").cast("int") - 1)).alias("other"))
    a = payload.where("block < other").select("root", F.col("block").alias("lo"), F.col("other").alias("hi"), *[F.col(k).alias(f"a_{k}") for k in PARTS])
    b = payload.where("block > other").select("root", F.col("other").alias("lo"), F.col("block").alias("hi"), *[F.col(k).alias(f"b_{k}") for k in PARTS])
    pairs = a.join(b, ["root", "lo", "hi"]).select(*[f"{s}_{k}" for s in "ab" for k in PARTS])
    across = pairs.repartition(2 * n).mapInArrow(freeing(_across(threshold, tolerance)), "kind int, doc_id long, value long")
    results = cut(found.where(F.col("kind") != PAYLOAD).select("kind", "doc_id", "value").unionByName(across))
    classes = components(results.where(F.col("kind") == EDGE).select(F.col("doc_id").alias("a"), F.col("value").alias("b")))
    links = results.where(F.col("kind") == LINKS).groupBy(F.col("doc_id").alias("set_id")).agg(F.sum("value").alias("links"))

    of_set = sets.join(links, "set_id", "left").join(classes.select(F.col("node").alias("set_id"), F.col("root").alias("class_id")), "set_id", "left")
    of_set = of_set.select("root", "key", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    placed = members.join(of_set, ["root", "key"]).select("doc_id", "set_id", "class_id", "n_links")
    out = one.select("doc_id").join(placed, "doc_id", "left")
    return out.select("doc_id", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
