"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of n-grams, longest first: P_k(w|h) = a ML_k(w|h) + (1 - a) P_(k-1)(w|h), down to
the uniform 1 / (V + 1), where V is the number of known tokens. The weight a belongs to the order and to the bucket of the
context's frequency (powers of two); an unseen context has a = 0. Weights are learned by expectation-maximisation on held-out
counts: a fold of the training texts is deleted from the counts, and its events are judged by what the rest counts. Scores
then use the counts of all training texts.

Tokens are runs of bytes that aren't ASCII white space (A-Z lower-cased), and an end for each text. n-grams are known by
62-bit hashes of their tokens and two bits of their order.

Counting. Texts are taken in runs of some megabytes. A run sends each of its distinct n-grams once to the bucket that owns
the n-gram's hash (buckets are ranges of hashes, as many as the corpus asks for), sorted, as differences in byte planes, with
the run's own counts. So a frequent n-gram is one entry for each run, not one for each occurrence, and no key is hot. A bucket
adds up and answers each run in the order of its question. Questions and answers are packed: a row is a pair of run and bucket.
A run's texts and its answers meet by the run's number. That number is made of the partition and the place in it, so `docs`
must give the same partitions each time it is read, as a table of files does; a checksum of each run's n-grams guards that.

Learning. Each run tallies its held-out events as counts (exact up to 16, then to four binary digits), packed, and each step of
the maximisation reads these tallies. The driver holds two numbers for each order and bucket.

Nulls: a null text is an empty one, its end its only token. A null doc_id is neither held out nor deleted, so it trains.
Repeated rows score alike. An empty table gives an empty result; without training texts all mass is uniform. Other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import MASK, Substrings, cut, freed, freeing, mix, partitions, ranges, words

ORDER = 3
RUN_BYTES = 6 << 20
BUCKET_BYTES = 6 << 20
HASH_BYTES = 1 << 20
LEVELS = 32
TRAIN, DELETED, HELD_OUT = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END = np.uint64(0xE7D)
BEGIN = np.uint64(0xBE617)
TWO, THREE = np.uint64(2), np.uint64(3)


# --- runs of texts and their n-grams


def runs(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[tuple[int, int, pa.Table]]:
    """(number, fold, rows) of runs of texts of one fold; they depend on the sequence of rows alone, not on the batches."""
    waiting: dict[int, list[pa.Table]] = {}
    pid, seq = TaskContext.get().partitionId(), {}

    def numbered(fold: int, rows: pa.Table) -> tuple[int, int, pa.Table]:
        seq[fold] = seq.get(fold, -1) + 1
        return (pid << 24 | seq[fold]) * 3 + fold, fold, rows

    for batch in batches:
        folds = batch.column("fold").to_numpy()
        for fold in np.unique(folds).tolist():
            rows = pa.Table.from_batches([batch]).filter(pa.array(folds == fold))
            rows = pa.concat_tables([waiting.pop(fold), rows]) if fold in waiting else rows
            full = np.cumsum(pc.binary_length(rows.column("data")).to_numpy(), dtype=np.int64)
            lo, base = 0, 0
            while rows.num_rows > lo and full[-1] - base >= run_bytes:
                hi = int(np.searchsorted(full, base + run_bytes, "left")) + 1
                yield numbered(fold, rows.slice(lo, hi - lo))
                lo, base = hi, int(full[hi - 1])
            if lo < rows.num_rows:
                waiting[fold] = rows.slice(lo)
    for fold in sorted(waiting):
        yield numbered(fold, waiting[fold])


def joined(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts of a run, one after the other."""
    col = rows.column("data").combine_chunks().cast(pa.large_binary())
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def sequence(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, each with an end, and the first token of each text; texts are hashed a megabyte at a time."""
    tokens, firsts, lo, total = [], [np.zeros(1, np.int64)], 0, 0
    while lo < offsets.size - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + HASH_BYTES, "right")) - 1)
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        start, end, first = words(offsets[lo : hi + 1] - offsets[lo], part)
        tokens.append(np.insert(Substrings(part).hash(start, end), first[1:], mix(np.full(hi - lo, END))))
        firsts.append(first[1:] + np.arange(1, hi - lo + 1) + total)
        lo, total = hi, total + tokens[-1].size
    return np.concatenate(tokens), np.concatenate(firsts)


def grams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """The hash of the k-gram that ends at each token, for k from 1; what stands before a text is a begin."""
    n = tokens.size
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    begin = mix(np.array([BEGIN]))[0]
    out = [tokens]
    for k in range(1, order):
        before = np.full(n, begin)
        there = np.flatnonzero(place >= k)
        before[there] = tokens[there - k]
        # the hash of a k-gram is that of its last token and its context, farther tokens last
        out.append(mix(out[-1] * np.uint64(0x9E3779B97F4A7C15) + before))
    return [(h & ~THREE) | np.uint64(k + 1) for k, h in enumerate(out)]


class Run:
    """The distinct n-grams of a run in order, how often each occurs, and which stands at each token."""

    def __init__(self, rows: pa.Table, order: int):
        offsets, data = joined(rows)
        tokens, self.first = sequence(offsets, data)
        self.order, self.tokens = order, tokens.size
        every = np.concatenate(grams(tokens, self.first, order))
        at = np.argsort(every)
        ordered = every[at]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        self.keys = ordered[new]
        edges = np.append(np.flatnonzero(new), ordered.size)
        del ordered
        self.counts = np.diff(edges)
        self.where = np.empty(every.size, np.int32)
        self.where[at] = np.cumsum(new, dtype=np.int32) - 1

    def check(self) -> int:
        return int(np.bitwise_xor.reduce(self.keys, initial=np.uint64(self.keys.size)).astype(np.int64))

    def by_order(self, values: np.ndarray) -> list[np.ndarray]:
        """What the answers say of the n-grams at each token, order by order."""
        return list(values[self.where].reshape(self.order, self.tokens))


# --- packing


def small(values: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones behind, all deflated: most are ones."""
    big = np.flatnonzero(values >= 255)
    return zlib.compress(np.int64(values.size).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + values[big].astype(np.int64).tobytes(), 1)


def large(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, -1, 8 + n)
    return out


def planes(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, one byte plane after the other; the high planes are all but empty."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def owners(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The first key of each bucket among ascending keys, and the end."""
    bounds = np.array([(MASK // buckets + 1) * b for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [keys.size]])


# --- counting

QUESTION = "bucket int, run long, fold int, check long, keys binary, counts binary"
ANSWER = "run long, bucket int, check long, totals binary, deleted binary, known long, trained long, trained_deleted long"


def questions(texts: DataFrame, order: int, buckets: int, run_bytes: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, fold, rows in runs(batches, run_bytes):
            run = Run(rows, order)
            cuts, check = owners(run.keys, buckets), run.check()
            some = np.flatnonzero(np.diff(cuts)).tolist()
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(some, pa.int32()), "run": pa.array([number] * len(some), pa.int64()), "fold": pa.array([fold] * len(some), pa.int32()), "check": pa.array([check] * len(some), pa.int64()),
                "keys": pa.array([planes(run.keys[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()),
                "counts": pa.array([small(run.counts[cuts[b] : cuts[b + 1]]) if fold != HELD_OUT else b"" for b in some], pa.binary()),
            })

    return texts.mapInArrow(freeing(ask), QUESTION)


def answer(asked: pa.Table) -> pa.Table:
    """Counts in all training texts, and in the deleted ones, of what each run has asked one bucket for."""
    folds = asked.column("fold").to_numpy()
    keys = [unplanes(x.as_buffer()) for x in asked.column("keys")]
    sizes = np.array([k.size for k in keys])
    own = [large(x.as_py()) if f != HELD_OUT else np.zeros(n, np.int64) for x, f, n in zip(asked.column("counts"), folds, sizes, strict=True)]
    every, counts = np.concatenate(keys), np.concatenate(own)
    del keys, own
    at = np.argsort(every, kind="stable")
    ordered = every[at]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    length = np.diff(np.append(new, ordered.size))
    total = np.add.reduceat(counts[at], new)
    deleted = np.add.reduceat(np.where(np.repeat(folds == DELETED, sizes), counts, 0)[at], new)
    unigram = (ordered[new] & THREE) == 1
    stats = [int((unigram & (total > 0)).sum()), int(total[unigram].sum()), int(deleted[unigram].sum())]
    back = np.empty((2, every.size), np.int64)
    back[0, at], back[1, at] = np.repeat(total, length), np.repeat(deleted, length)
    ends = np.cumsum(sizes)
    n, bucket = len(sizes), asked.column("bucket")[0].as_py()
    return pa.table({
        "run": asked.column("run").combine_chunks(), "bucket": pa.array([bucket] * n, pa.int32()), "check": asked.column("check").combine_chunks(),
        "totals": pa.array([small(back[0, e - s : e]) for s, e in zip(sizes, ends, strict=True)], pa.binary()),
        "deleted": pa.array([small(back[1, e - s : e]) if f == DELETED else b"" for s, e, f in zip(sizes, ends, folds, strict=True)], pa.binary()),
        # what holds for the whole bucket stands in its first row
        **{c: pa.array([v] + [0] * (n - 1), pa.int64()) for c, v in zip(("known", "trained", "trained_deleted"), stats, strict=True)},
    })


def with_answers(texts: DataFrame, answers: DataFrame, run_bytes: int, order: int, use: Callable[[Run, pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """use(run, rows, totals, deleted) for each run of texts, its answers put together."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, rows in runs(batches, run_bytes):
            offsets, data = joined(rows)
            ids = rows.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_pydict({
                "run": pa.array([number], pa.int64()), "data": pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()), "sizes": pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "folds": pa.array([rows.column("fold").to_pylist()], pa.list_(pa.int32())),
            })

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("a run of texts has come twice or not at all; docs must give the same partitions each time")
        sizes = left.column("sizes")[0].values.to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
        data = pa.Array.from_buffers(pa.large_binary(), sizes.size, [None, offsets.buffers()[1], pa.decompress(left.column("data")[0].as_buffer(), int(sizes.sum()), "zstd")])
        rows = pa.table({"doc_id": left.column("ids")[0].values, "fold": left.column("folds")[0].values, "data": data})
        run = Run(rows, order)
        right = right.sort_by("bucket")
        if set(right.column("check").to_pylist()) != {run.check()}:
            raise RuntimeError("a run of texts differs from what was counted; docs must give the same partitions each time")
        put = lambda c: np.concatenate([large(x.as_py()) if x.as_py() else np.zeros(0, np.int64) for x in right.column(c)])
        return use(run, rows, put("totals"), put("deleted"))

    packed_runs = texts.mapInArrow(freeing(packed), "run long, data binary, sizes array<long>, ids array<long>, folds array<int>")
    both = packed_runs.groupBy("run").cogroup(answers.select("run", "bucket", "check", "totals", "deleted").groupBy("run"))
    apply = lambda left, right: _release(meet, left, right)
    return both.applyInArrow(apply, schema)


def _release(f: Callable, *tables: pa.Table) -> pa.Table:
    from meterwise.llm.common import release

    try:
        return f(*tables)
    finally:
        release()


# --- the model


def level(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 if unseen, else one more than its binary logarithm."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS - 1)


def contexts(counts: list[np.ndarray], first: np.ndarray, texts: int) -> list[np.ndarray]:
    """How often the context of each token's k-gram occurs, for k from 2: the (k-1)-gram before, or a text's begin."""
    out = []
    for c in counts[:-1]:
        before = np.empty(c.size, c.dtype)
        before[1:] = c[:-1]
        before[first[:-1]] = texts
        out.append(before)
    return out


def coarse(count: np.ndarray) -> np.ndarray:
    """Counts up to 16 as they are, larger ones to four binary digits."""
    shift = np.maximum(np.frexp(count.astype(np.float64))[1] - 4, 0)
    return (count >> shift) << shift


class Mixture:
    """weights[k - 1][level] is the weight of order k where the context's frequency is in that bucket; order 1 has one bucket."""

    def __init__(self, order: int, weights: np.ndarray | None = None):
        self.weights = np.full((order, LEVELS), 0.5) if weights is None else weights
        self.weights[1:, 0] = 0.0  # an unseen context says nothing

    def parts(self, counts: list[np.ndarray], seen: list[np.ndarray], trained: float, known: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probabilities, and each order's share in them (times probability), of events given their counts and contexts."""
        total, shares = np.full(counts[0].size, 1.0 / (known + 1)), []
        for k, c in enumerate(counts):
            context = np.full(c.size, trained) if k == 0 else seen[k - 1]
            a = self.weights[k, 0 if k == 0 else level(context)] * (context > 0)
            own = a * np.divide(c, context, out=np.zeros(c.size), where=context > 0)
            shares = [s * (1 - a) for s in shares] + [own]
            total = own + (1 - a) * total
        return total, shares


def fit(events: DataFrame, order: int, trained: int, known: int, steps: int = 25, tolerance: float = 1e-5) -> Mixture:
    """Weights by expectation-maximisation over tallies of events, a packed row for each run: the counts of each order, the
    contexts from order 2 on, and how often such an event occurs.

    Of the mass that reaches an order in a bucket, the share that it keeps is its new weight, with half an event more on
    either side, so no weight is 0 or 1 for want of events.
    """
    model, last = Mixture(order), None
    for _ in range(steps if trained else 0):

        def expect(batches: Iterator[pa.RecordBatch], model: Mixture = model) -> Iterator[pa.RecordBatch]:
            got, kept, gain = np.zeros((order, LEVELS)), np.zeros((order, LEVELS)), 0.0
            for batch in batches:
                for size, data in zip(batch.column("size").to_pylist(), batch.column("events"), strict=True):
                    rows = np.frombuffer(pa.decompress(data.as_buffer(), size * 2 * order * 4, "zstd"), np.float32).reshape(2 * order, size).astype(np.float64)
                    counts, seen, n = list(rows[:order]), list(rows[order:-1]), rows[-1]
                    p, shares = model.parts(counts, seen, trained, known)
                    gain += float(n @ np.log(p))
                    reach = np.ones(p.size)
                    for k in reversed(range(order)):
                        at = np.zeros(p.size, np.int64) if k == 0 else level(seen[k - 1])
                        mine = shares[k] / p
                        got[k] += np.bincount(at, n * reach, LEVELS)
                        kept[k] += np.bincount(at, n * mine, LEVELS)
                        reach = np.maximum(reach - mine, 0.0)
            hit = np.argwhere(got > 0)
            yield pa.RecordBatch.from_pydict({"k": pa.array([*hit[:, 0], -1], pa.int32()), "level": pa.array([*hit[:, 1], 0], pa.int32()), "got": [*got[got > 0], gain], "kept": [*kept[got > 0], 0.0]})

        weights, now = np.full((order, LEVELS), np.nan), 0.0
        for k, at, got, kept in events.mapInArrow(freeing(expect), "k int, level int, got double, kept double").groupBy("k", "level").agg(F.sum("got"), F.sum("kept")).collect():
            if k < 0:
                now = got
            else:
                weights[k, at] = (kept + 0.5) / (got + 1.0)
        for k in range(order):  # a bucket without events takes after the one below
            weights[k, 0] = 0.5 if np.isnan(weights[k, 0]) else weights[k, 0]
            for at in range(1, LEVELS):
                if np.isnan(weights[k, at]):
                    weights[k, at] = weights[k, at - 1] if at > 1 else 0.5
        model = Mixture(order, weights)
        if last is not None and now - last <= tolerance * abs(last):
            break
        last = now
    return model


def texts_of(docs: DataFrame, fold: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.cast("int").alias("fold"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))


@dataclass
class Learned:
    """A model with the counts it rests on: of all n-grams of the texts it was made from."""

    answers: DataFrame
    model: Mixture
    order: int
    run_bytes: int
    texts: int
    known: int
    trained: int


def learn(docs: DataFrame, fold: Column, order: int = ORDER, run_bytes: int = RUN_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Learned:
    """Count the n-grams of docs and learn the weights. fold says which rows train (0), train after they have served as
    deleted ones to learn the weights (1), or are held out (2): their n-grams are looked up but not counted."""
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    texts = texts_of(docs, fold)
    about = docs.agg(F.sum(F.octet_length("text")), F.count_if(fold == TRAIN), F.count_if(fold == DELETED)).first()
    buckets = max(partitions(docs.sparkSession), -(-(about[0] or 0) // bucket_bytes))
    asked = questions(texts, order, buckets, run_bytes)
    answers = cut(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(freed(answer), ANSWER))
    known, trained, deleted = (int(x or 0) for x in answers.agg(F.sum("known"), F.sum("trained"), F.sum("trained_deleted")).first())
    model = Mixture(order)
    if deleted and trained > deleted:
        n_train = about[1]

        def events(run: Run, rows: pa.Table, totals: np.ndarray, deleted: np.ndarray) -> pa.Table:
            left = run.by_order(totals - deleted)
            columns = np.stack([coarse(x) for x in left + contexts(left, run.first, n_train)])
            distinct, n = np.unique(columns, axis=1, return_counts=True)
            # coarse counts are exact in single precision
            return pa.table({"size": [n.size], "events": pa.array([pa.compress(np.vstack([distinct, n]).astype(np.float32, order="C"), "zstd", asbytes=True)], pa.binary())})

        found = with_answers(texts.where(F.col("fold") == DELETED), answers.where(F.octet_length("deleted") > 0), run_bytes, order, events, "size long, events binary")
        model = fit(cut(found), order, trained - deleted, known)
    return Learned(answers, model, order, run_bytes, about[1] + about[2], known, trained)


def score(docs: DataFrame, fold: Column, learned: Learned) -> DataFrame:
    """doc_id, fold, n_tokens, n_known, train_tokens, base_score, score of each row of the docs that `learned` has counted.

    base_score is the add-one unigram model's log10 probability, score this model's.
    """
    model, known, trained, texts = learned.model, learned.known, learned.trained, learned.texts

    def judge(run: Run, rows: pa.Table, totals: np.ndarray, deleted: np.ndarray) -> pa.Table:
        counts = run.by_order(totals)
        p, _ = model.parts(counts, contexts(counts, run.first, texts), trained, known)
        base = np.log10((counts[0] + 1) / (trained + known + 1))
        by_text = lambda x: np.add.reduceat(x, run.first[:-1])  # noqa: E731  each text has an end
        return pa.table({
            "doc_id": rows.column("doc_id"), "fold": rows.column("fold"), "n_tokens": np.diff(run.first), "n_known": by_text((counts[0] > 0).astype(np.int64)),
            "train_tokens": np.full(rows.num_rows, trained), "base_score": by_text(base), "score": by_text(np.log10(p)),
        })

    schema = "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers(texts_of(docs, fold), learned.answers, learned.run_bytes, learned.order, judge, schema)
