"""Exact substring removal by distributed prefix doubling.

Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes. Strings are judged
on the input as UTF-8 bytes, never cross documents, and may overlap.

1. Which positions can be repeats: of each 50-byte string one 20-byte part stands for it (the one with the least hash),
   so equal strings are represented alike by one position in about 15, an anchor. Spark deals anchors by a hash of those
   20 bytes; anchors whose hash is met in one document alone leave. This only leaves out strings that are not repeated:
   a hash in common decides nothing.
2. Prefix doubling decides. An anchor that stays sends the bytes of all strings that it stands for to the task of its
   name, where all strings that may be equal meet. There every position has an integer rank by its 8 bytes; the pair
   (rank here, rank at the offset) is sorted and ranked anew for growing offsets until the ranks are those of 50 bytes,
   and positions alone with their pair leave (prefix_doubling.ranks_in). Bytes that equal those of a smaller document
   as a whole are found beforehand by pairs of ranks as well (ranks_of_rows), in the sending task too, so that a
   common passage does not gather. Strings of a name that is met very often are dealt by their own hash instead.

Ranks are exact: no string is judged by a hash, but for exact copies of a text: they are settled beforehand by their
SHA-256 (all but the first are covered whole, if of 50 bytes on). With every_position=True all positions of all texts are
ranked by Spark's sort (prefix_doubling.ranks), at many times the shuffle.

Nulls: a null text is empty. Rows with a null doc_id neither cover others nor are covered. Repeated rows don't cover
each other; where one doc_id has different texts, the one with the least digest is judged and the others stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.llm import prefix_doubling
from meterwise.llm.common import Substrings, freed, freeing, mix, partitions, ranges, text_chunks

LENGTH = 50
NAME = 20
HOT = 512
#: Bytes of text whose anchors one task ranks at once; there are as many buckets as the corpus asks for.
BUCKET = 1 << 24
#: Bytes of text that are looked at in one go; a task needs some 100 times as many for its arrays.
CHUNK = 1 << 17
#: Bytes that go out in one batch, and that are ranked in one go on the sending side (one kind, if larger).
PIECE = 1 << 20
WIDE = 1 << 20
#: Stands for a null doc_id inside.
NONE = -(1 << 63)
TOP = np.uint64((1 << 64) - 1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] (as far as it goes) for each i, in log(width) passes."""
    out, have = x.copy(), 1
    while have < width and have < x.size:
        step = min(have, width - have)
        out[:-step] = f(out[:-step], out[step:])
        have += step
    return out


class Run:
    """The anchors of a run of texts: positions whose name stands for at least one string of `length` bytes."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, length: int, name: int):
        self.length, self.name, self.offsets, self.data = length, name, offsets, data
        size, n = np.diff(offsets), data.size
        self.subs = Substrings(data)
        self.end = np.repeat(offsets[1:], size)
        self.begin = np.repeat(offsets[:-1], size)
        at = np.arange(n)
        names = np.full(n, TOP)
        every = self.subs.every(name)
        names[: every.size] = np.minimum(every, TOP - np.uint64(1))
        names[at + name > self.end] = TOP
        width = length - name + 1
        least = _slide(names, width, np.minimum)
        whole = at + length <= self.end
        reach = _slide(np.where(whole, least, np.uint64(0))[::-1], width, np.maximum)[::-1]
        self.least, self.whole = least, whole
        self.at = np.flatnonzero((reach == names) & (names != TOP))
        self.names = names[self.at]
        self.doc = np.searchsorted(offsets, self.at, "right") - 1

    def strings(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings that anchors stand for, and the anchor of each."""
        at = self.at[anchors]
        lo = np.maximum(at - (self.length - self.name), self.begin[at])
        pos = ranges(lo, at - lo + 1)
        own = np.repeat(np.arange(anchors.size), at - lo + 1)
        keep = self.whole[pos] & (self.least[pos] == self.names[anchors][own])
        return pos[keep], own[keep]

    def spans(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First start and number of the strings that each anchor stands for; their starts are neighbours."""
        pos, own = self.strings(anchors)
        count = np.bincount(own, minlength=anchors.size)
        return pos[np.cumsum(count) - count], count


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _six(x: np.ndarray) -> np.ndarray:
    """The low 48 bits as three 16-bit columns."""
    return np.ascontiguousarray(x.astype("<u8")).view("<u2").reshape(-1, 4)[:, :3]


def _of_six(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, "<u2").reshape(-1, 3).astype(np.uint64)
    return x[:, 0] | (x[:, 1] << np.uint64(16)) | (x[:, 2] << np.uint64(32))


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _read(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [kind(x) if kind is _of_six else np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _groups(new: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of whole groups (`new`: where one starts) of `most` in size together, or of one group, if larger."""
    edge = np.append(np.flatnonzero(new), new.size)
    done = np.append(0, np.cumsum(size))[edge]
    i = 0
    while i < edge.size - 1:
        j = max(i + 1, int(np.searchsorted(done, done[i] + most, "right")) - 1)
        yield np.arange(edge[i], edge[j])
        i = j


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in columns.items()})


ANCHORS = "bucket long, name binary, doc binary, pos binary, ids binary, flag binary"


PLAIN, MARK, OF_HOT = 0, 1, 2


def _anchors(buckets: int, length: int, name: int, hot: int, most: int = 500_000):
    """Step 1, sending side: anchors go to the task of their name.

    Those of names met more than `hot` times in two documents or more only pass through, dealt evenly; one mark for
    each such name goes to the name's task.
    """

    def send(held: list) -> Iterator[pa.RecordBatch]:
        names, docs, pos = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()  # what was put together is not held twice
        order = np.lexsort((docs, names))
        n, d = names[order], docs[order]
        new = _starts(n)
        at, group = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
        many = ((np.bincount(group, minlength=at.size) > hot) & (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)))[group]
        marks = order[new & many]
        flag = np.empty(n.size, np.uint8)
        flag[order] = np.where(many, OF_HOT, PLAIN)
        del order, n, d, new, at, group, many
        bucket = np.where(flag == OF_HOT, _bucket(mix(names + docs.astype(np.uint64)), buckets), _bucket(names, buckets))
        if marks.size:
            flag = np.concatenate([flag, np.full(marks.size, MARK, np.uint8)])
            bucket = np.concatenate([bucket, _bucket(names[marks], buckets)])
            names, docs, pos = (np.concatenate([x, x[marks]]) for x in (names, docs, pos))
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        del bucket
        out, size = {k: [] for k in ("bucket", "name", "doc", "pos", "ids", "flag")}, 0
        for b in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[b] : cuts[b + 1]]
            ids, index = np.unique(docs[own], return_inverse=True)
            bytes_of = {"name": _six(names[own]), "doc": index.astype(_index_kind(ids.size)), "pos": pos[own], "ids": np.diff(ids, prepend=0).astype("<i8"), "flag": flag[own]}
            out["bucket"].append(int(b))
            for k, v in bytes_of.items():
                out[k].append(np.ascontiguousarray(v).tobytes())
                size += v.nbytes
            if size >= PIECE:
                yield _batch(out)
                out, size = {k: [] for k in out}, 0
        if size:
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi, offsets, data in text_chunks(batch, most=CHUNK):
                r = Run(offsets, data, length, name)
                held.append((r.names, ids[lo:hi][r.doc], (r.at - r.offsets[r.doc]).astype("<u4")))
                count += r.at.size
                del r
                if count >= most:
                    yield from send(held)
                    count = 0
        if count:
            yield from send(held)

    return run


def _index_kind(n: int) -> str:
    return "<u2" if n <= 65_536 else "<u4"


REPLIES = "doc_id long, code long"
ASK, ASK_HOT = 1, 2


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(columns[0].size, bool)
    if new.size:
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return new


def _shared(hot: int):
    """Step 1, receiving side: the anchors of a bucket whose name is met in two documents; hot ones may be 16 x `hot` in all."""

    def run(table: pa.Table) -> pa.Table:
        names, flag, pos = (np.concatenate(_read(table, k, t)) for k, t in (("name", _of_six), ("flag", np.uint8), ("pos", "<u4")))
        ids = [np.cumsum(x) for x in _read(table, "ids", "<i8")]
        docs = np.concatenate([own[np.frombuffer(x, _index_kind(own.size))] for own, x in zip(ids, table.column("doc").to_pylist(), strict=True)])
        code = np.where(flag == OF_HOT, ASK_HOT, 0)
        own = np.flatnonzero(flag != OF_HOT)
        if own.size:
            own = own[np.lexsort((docs[own], names[own]))]
            d, new = docs[own], _starts(names[own])
            at, group = np.flatnonzero(new), np.cumsum(new) - 1
            many = (np.maximum.reduceat((flag[own] == MARK).astype(np.int8), at) > 0) | (np.bincount(group) > 16 * hot)
            shared = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)) | many
            code[own] = np.where(flag[own] == MARK, 0, np.where(many, ASK_HOT, np.where(shared, ASK, 0))[group])
        keep = code > 0
        return pa.table({"doc_id": pa.array(docs[keep], pa.int64()), "code": pa.array(pos[keep].astype(np.int64) * 4 + code[keep], pa.int64())})

    return run


STRINGS = "bucket long, name binary, doc binary, pos binary, count binary, body binary, settled binary"


def _cut(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of data[start : start + width], with zeros at their ends, and which bytes are none of these; data goes on long enough."""
    room = -(-int(width.max(initial=1)) // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(data, room)[start]
    inside = np.arange(room) < width[:, None]
    return rows * inside, inside


class Bodies:
    """Runs of `count` strings with neighbouring starts, from byte `pos` of a document on; their bytes are at `begin` of data.

    joined() gives data an end of zeros, so that rows of equal width can be cut from it.
    """

    def __init__(self, name: np.ndarray, doc: np.ndarray, pos: np.ndarray, count: np.ndarray, length: int, data: np.ndarray, begin: np.ndarray | None = None):
        self.name, self.doc, self.pos, self.count, self.length, self.data = name, doc, pos, count, length, data
        self.width = count + length - 1
        self.begin = np.cumsum(self.width) - self.width if begin is None else begin

    @classmethod
    def joined(cls, parts: list[Bodies]) -> Bodies:
        before = np.cumsum([0] + [p.data.size for p in parts])
        begin = np.concatenate([p.begin + n for p, n in zip(parts, before, strict=False)])
        return cls(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("name", "doc", "pos", "count")), parts[0].length, np.concatenate([p.data for p in parts] + [np.zeros(2 * parts[0].length + 8, np.uint8)]), begin)

    def take(self, own: np.ndarray) -> Bodies:
        """These, their bytes still where they are."""
        return Bodies(self.name[own], self.doc[own], self.pos[own], self.count[own], self.length, self.data, self.begin[own])

    def bytes(self) -> np.ndarray:
        """Their bytes, one body after the other."""
        rows, inside = _cut(self.data, self.begin, self.width)
        return rows[inside]

    def copies(self) -> np.ndarray:
        """Which have the very bytes of one in a smaller document."""
        rank = prefix_doubling.ranks_of_rows(_cut(self.data, self.begin, self.width)[0], self.count)
        least = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, rank, self.doc)
        return self.doc > least[rank]

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """doc and start of the strings that a smaller document has too."""
        begin = np.cumsum(self.width) - self.width
        at, rank = prefix_doubling.ranks_in(self.bytes(), begin, self.width, self.length)
        own = np.searchsorted(begin, at, "right") - 1
        doc = self.doc[own]
        least = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, rank, doc)
        hit = doc > least[rank]
        return doc[hit], (self.pos[own] + at - begin[own])[hit]


def _strings(buckets: int, length: int, name: int, most: int = 1 << 24):
    """Step 2, sending side: the bytes of the strings that anchors stand for, by the anchor's name.

    Of a task's equal ones the first document's goes on; the others are settled and only pass through. Strings of hot
    names go one by one, by a hash of their own.
    """

    def send(held: list[Bodies], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        all_ = Bodies.joined(held)
        held.clear()
        # ranks are worked out where a hash is met again: others can't be equal; a few hashes at a time, so that memory has a bound
        _, index, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[index] > 1)
        again = again[np.argsort(index[again], kind="stable")]
        copy = np.zeros(all_.count.size, bool)
        for own in _groups(_starts(index[again]), all_.width[again], PIECE):
            copy[again[own]] = all_.take(again[own]).copies()
        del index, times, again
        for settled, own in ((1, np.flatnonzero(copy)), (0, np.flatnonzero(~copy))):
            if not own.size:
                continue
            b = _bucket(mix(all_.doc[own].astype(np.uint64)) if settled else all_.name[own], buckets)
            order = np.argsort(b, kind="stable")
            x, cuts = all_.take(own[order]), np.searchsorted(b[order], np.arange(buckets + 1))
            out, size = {k: [] for k in ("bucket", "name", "doc", "pos", "count", "body", "settled")}, 0
            for i in np.flatnonzero(np.diff(cuts)):
                y = x.take(np.arange(cuts[i], cuts[i + 1]))
                row = {"name": b"" if settled else np.ascontiguousarray(_six(y.name)).tobytes(), "doc": _small(y.doc), "pos": y.pos.astype("<u4").tobytes(), "count": y.count.astype(np.uint8).tobytes(), "body": b"" if settled else _small(y.bytes()), "settled": bytes([settled])}
                out["bucket"].append(int(i))
                for k, v in row.items():
                    out[k].append(v)
                    size += len(v)
                if size >= PIECE:
                    yield _batch(out)
                    out, size = {k: [] for k in out}, 0
            if size:
                yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            codes = batch.column("codes")
            for lo, hi, offsets, data in text_chunks(batch, most=CHUNK):
                own = codes.slice(lo, hi - lo)
                count = np.diff(own.offsets.to_numpy()) if own.null_count == 0 else np.array([len(x) if x is not None else 0 for x in own.to_pylist()])
                flat = own.flatten().to_numpy()
                if not flat.size:
                    continue
                row = np.repeat(np.arange(hi - lo), count)
                kind, at = flat % 4, offsets[row] + flat // 4
                r = Run(offsets, data, length, name)
                where = np.searchsorted(r.at, at)
                ask, hot = where[kind == ASK], where[kind == ASK_HOT]
                parts = []
                if ask.size:
                    start, count = r.spans(ask)
                    parts.append((r.names[ask], r.doc[ask], start, count))
                if hot.size:
                    start, own_ = r.strings(hot)
                    parts.append((r.subs.hash(start, start + length), r.doc[hot][own_], start, np.ones(start.size, np.int64)))
                for names, doc, start, count in parts:
                    held.append(Bodies(names, ids[lo:hi][doc], start - offsets[doc], count, length, data, start))
                    hashes.append(r.subs.hash(start, start + count + length - 1))
                    size += data.size + 100 * start.size
                del r
                if size >= most:
                    yield from send(held, hashes)
                    held, hashes, size = [], [], 0
        if held:
            yield from send(held, hashes)

    return run


def _rank_strings(length: int, most: int = 1 << 19):
    """Step 2, receiving side: the strings of a bucket that a smaller document has too, by prefix doubling."""

    def run(table: pa.Table) -> pa.Table:
        found, parts = [], []
        for settled, names, docs, pos, count, body in zip(*(table.column(k).to_pylist() for k in ("settled", "name", "doc", "pos", "count", "body")), strict=True):
            pos, count = np.frombuffer(pos, "<u4").astype(np.int64), np.frombuffer(count, np.uint8).astype(np.int64)
            docs = np.frombuffer(pa.decompress(docs, 8 * count.size, codec="zstd"), np.int64)
            if settled[0]:
                found.append((docs, pos, count))
            else:
                size = int(count.sum()) + count.size * (length - 1)
                parts.append(Bodies(_of_six(names), docs, pos, count, length, np.frombuffer(pa.decompress(body, size, codec="zstd"), np.uint8)))
        if parts:
            every = Bodies.joined(parts)
            every = every.take(np.argsort(every.name, kind="stable"))
            # a few names at a time, so that memory has a bound
            for rows in _groups(_starts(every.name), every.width, most):
                own = every.take(rows)
                copy = own.copies()
                found.append((own.doc[copy], own.pos[copy], own.count[copy]))
                own = own.take(np.flatnonzero(~copy))
                new = _starts(own.name)
                at, group = np.flatnonzero(new), np.cumsum(new) - 1
                several = np.minimum.reduceat(own.doc, at) != np.maximum.reduceat(own.doc, at)
                doc, pos = own.take(np.flatnonzero(several[group])).hits()
                order = np.lexsort((pos, doc))
                doc, pos = doc[order], pos[order]
                # runs of neighbouring starts become one reply, or several if very long
                new = _starts(doc, pos - np.arange(pos.size))
                since = np.arange(pos.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
                first = np.flatnonzero(since % (WIDE - 1) == 0)
                found.append((doc[first], pos[first], np.diff(np.append(first, pos.size))))
        docs, pos, count = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "code": pa.array(pos * WIDE + count, pa.int64())})

    return run


def _remove(length: int):
    """The removed bytes of each text, from what was found; `first` is the smallest doc_id with the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a chunk is a batch of its own on the way out
            for lo, hi, offsets, data in text_chunks(batch, most=CHUNK):
                out: dict[str, list] = {k: [] for k in ("kept_text", "kept_sha256", "starts", "ends")}
                step = np.zeros(data.size + 1, np.int64)
                size = np.diff(offsets)
                n = hi - lo
                copies = batch.column("copy").slice(lo, n).to_numpy(zero_copy_only=False) & (size >= length)
                col = batch.column("spans").slice(lo, n)
                count = np.array([len(x) if x is not None else 0 for x in col.to_pylist()]) if col.null_count else np.diff(col.offsets.to_numpy())
                flat = col.flatten().to_numpy()
                row = np.repeat(np.arange(n), count)
                a = flat // WIDE
                np.add.at(step, offsets[row] + a, 1)
                np.add.at(step, offsets[row] + a + flat % WIDE + length - 1, -1)
                np.add.at(step, offsets[:-1][copies], 1)
                np.add.at(step, offsets[1:][copies], -1)
                gone = np.cumsum(step[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                edge_in = np.zeros(data.size + 1, bool)
                edge_in[offsets] = True  # a run ends with its text
                starts = np.flatnonzero(((edge[:-1] == 1) | edge_in[:-1]) & gone) if data.size else np.zeros(0, np.int64)
                ends = np.flatnonzero(((edge[1:] == -1) | edge_in[1:]) & gone) + 1 if data.size else np.zeros(0, np.int64)
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                spans = np.searchsorted(starts, offsets)
                keep = ~gone
                raw = data[keep].tobytes()
                kept_at = offsets - total[offsets]
                for i in range(n):
                    own = raw[kept_at[i] : kept_at[i + 1]]
                    out["kept_text"].append(own.decode("utf-8", "ignore"))
                    out["kept_sha256"].append(hashlib.sha256(own).hexdigest())
                    s, e = starts[spans[i] : spans[i + 1]] - offsets[i], ends[spans[i] : spans[i + 1]] - offsets[i]
                    out["starts"].append(s)
                    out["ends"].append(e)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(lo, n), "n_bytes": pa.array(size.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                    "n_spans": pa.array(np.diff(spans).astype(np.int64)), "kept_text": pa.array(out["kept_text"], pa.string()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
                    "starts": pa.array(out["starts"], pa.list_(pa.int64())), "ends": pa.array(out["ends"], pa.list_(pa.int64())), "carried": batch.column("carried").slice(lo, n),
                })

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, name: int = NAME, hot: int = HOT, carry: tuple[str, ...] = (), every_position: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256 (of the bytes left), starts and ends of removed spans.

    kept_text is the bytes left as text, without the rest of characters that a span cuts through. `carried` is a
    struct of the columns named in `carry`, as they came.
    """
    n = partitions(docs.sparkSession)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(4 * n, total // BUCKET)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), carried.alias("carried"))
    rows = rows.withColumn("sha", F.sha2("text", 256))
    ids = rows.select("doc_id", "sha").where(F.col("doc_id") != NONE).groupBy("doc_id").agg(F.min("sha").alias("sha"), (F.min("sha") != F.max("sha")).alias("several"))
    least = ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    info = ids.join(least, "sha", "left").where("several or first is not null").select("doc_id", F.col("sha").alias("own"), "first")
    info = info.unionByName(docs.sparkSession.range(1).select(F.lit(NONE).alias("doc_id"), F.lit("").alias("own"), F.lit(None).cast("long").alias("first")))
    # the one shuffle of texts; every later step meets them there, so no filter may slip below it
    texts = rows.repartition(n, "doc_id").join(info, "doc_id", "left")
    judged = (F.col("own").isNull() | (F.col("own") == F.col("sha"))) & (F.col("first").isNull() | (F.col("first") == F.col("doc_id")))
    # all columns go everywhere, so that the shuffle of the texts is one and the same
    if every_position:
        starts = prefix_doubling.covered(texts.where(judged).where(F.col("doc_id") != NONE).select("doc_id", "text"), length)
        spans = starts.select("doc_id", (F.col("pos").cast("long") * WIDE + 1).alias("code"))
    else:
        sent = texts.where(judged).select("doc_id", "text", "carried").mapInArrow(freeing(_anchors(buckets, length, name, hot)), ANCHORS)
        replies = sent.groupBy("bucket").applyInArrow(freed(_shared(hot)), REPLIES)
        codes = replies.groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
        asked = texts.where(judged).join(codes, "doc_id").select("doc_id", "text", "carried", "codes")
        strings = asked.mapInArrow(freeing(_strings(buckets, length, name)), STRINGS)
        spans = strings.groupBy("bucket").applyInArrow(freed(_rank_strings(length)), REPLIES)
    spans = spans.groupBy("doc_id").agg(F.collect_list("code").alias("spans"))
    found = texts.join(spans, "doc_id", "left").select(
        F.nullif("doc_id", F.lit(NONE)).alias("doc_id"), "text", "sha", "carried", F.when(judged, F.col("spans")).alias("spans"),
        F.coalesce((F.col("own") == F.col("sha")) & (F.col("first") < F.col("doc_id")), F.lit(False)).alias("copy"),
    )
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("carried", found.schema["carried"].dataType),
    ])
    out = found.mapInArrow(freeing(_remove(length)), schema)
    return out if carry else out.drop("carried")
