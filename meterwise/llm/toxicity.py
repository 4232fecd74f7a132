"""Toxicity of texts behind a noisy channel.

1. A character language model is counted over all texts: trigrams of a-z, one symbol for every other letter, and the
   word edge.
2. A token that looks disguised (signs or digits among its letters, letters three or more in a row, single letters
   parted by spaces) becomes a lattice: each sign may stand for a letter or for nothing, each run of a letter for one
   or two of it, each gap between single letters for nothing or for the space between words. The Viterbi path through
   the lattice under the language model, weighed with the channel's own costs, is the restored word (or words). Plain
   tokens have one path and need no search. Where nothing but a doubled letter or gaps are odd, the letters may as well
   be meant as they stand ("good", "boob"), so they count as a second reading beside the path's.
3. The restored words and their beginnings (3 to 7 letters, counted over distinct words) are the features of a
   logistic regression with an elastic net, trained on labelled rows by follow-the-regularised-leader.

The trainer sees a sample of at most `sample` labelled rows (the least hashes of doc_id); all counts of the language
model cover every text. Scores depend on the text alone.

Result for each row: doc_id, score (0 to 1), predicted. Nulls: a null text is scored as the empty text, whose score is
the model's intercept. Labels with a null doc_id or label are not used; of several labels of one doc_id the largest is, of several texts the first
in order. Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm import ftrl
from meterwise.llm.common import documents, freed, freeing, text_chunks

SAMPLE = 20_000
FEATURES = 1 << 20
#: What a sign may stand for; every sign may also be a mere separator.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l", "¡": "i",
}
EDGE, OTHER, SYMBOLS = 0, 27, 28
#: Costs (negative natural logs) of the channel: a sign for a letter, for the space between words, for nothing (less
#: likely where the sign is often a letter), a pair of letters for one, a longer run for one or two.
AS_LETTER, AS_SPACE, AS_NOTHING, LETTER_AS_NOTHING, PAIR_TO_ONE, RUN_CUT = 1.0, 1.0, 1.5, 8.0, 6.0, 0.7
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
PARTED = re.compile(r"\w([.\-_*/~])(?:\w\1)+\w")
RUN, PAIR = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
GAP = re.compile(r"[ \t]+")
#: Of a token: equal characters (in a row of single ones, also over the gaps between them), or a gap.
STEP = re.compile(r"(\S)(?: ?\1)*| +")
STRIP = ".,!#%&*?;:\"'=()[]{}<>|~^`/\\-_"
SYMBOL_OF_BYTE = np.zeros(256, np.int64)
SYMBOL_OF_BYTE[97:123] = np.arange(1, 27)
SYMBOL_OF_BYTE[65:91] = np.arange(1, 27)
SYMBOL_OF_BYTE[192:] = OTHER


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else EDGE if c == " " else OTHER


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities of a symbol after two others, from the trigrams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, offsets, data in text_chunks(batch):
                # a text starts and ends at a word edge; bytes that go on a letter are not symbols
                edged = np.insert(data, offsets, 32)
                s = SYMBOL_OF_BYTE[edged[(edged < 128) | (edged >= 192)]]
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = documents(docs).mapInArrow(freeing(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 28^3 rows at most
    n = np.zeros(SYMBOLS**3)
    for gram, k in rows:
        n[gram] = k
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 1
    two = n.sum(0) + 5 * one / one.sum()
    p = n + 5 * (two / two.sum(1, keepdims=True))[None]
    return -np.log(p / p.sum(2, keepdims=True))


def restore(token: str, model: np.ndarray) -> str:
    """The most likely word behind a token of letters and signs, by Viterbi over its lattice."""
    # lattice: for each run of equal characters the ways to read it, (letters, channel cost); texts are linked backwards
    states: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    apart = LETTER_AS_NOTHING if "  " in token else AS_SPACE  # where some gaps are wide, the narrow ones hardly end words
    for run in STEP.finditer(token):
        c, n = run[1], len(run[0])
        if c is None:
            ways = [("", 0.0), (" ", apart)] if n == 1 else [(" ", 0.0), ("", AS_NOTHING)]
        elif c.isalpha():
            n = run[0].count(c)
            ways = [(c, 0.0)] if n == 1 else [(c, PAIR_TO_ONE), (c + c, 0.0)] if n == 2 else [(c, RUN_CUT), (c + c, RUN_CUT)]
            if " " in run[0]:  # one of the gaps may be the space between words
                ways += [(x, apart + (n > 2) * RUN_CUT) for x in (f"{c} {c}", f"{c}{c} {c}", f"{c} {c}{c}")[: 1 if n == 2 else 3]]
        else:
            n = run[0].count(c)
            ways = [("", LETTER_AS_NOTHING if c in STANDS_FOR else AS_NOTHING), (" ", AS_SPACE + (c in STANDS_FOR) * 3.0)]
            for letter in STANDS_FOR.get(c, ""):
                ways.append((letter, AS_LETTER + 0.5 * (n - 1)))
                if n > 1:
                    ways.append((letter * 2, AS_LETTER + 0.5 * (n - 1)))
        nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, text) in states.items():
            for letters, own in ways:
                x, y, total = a, b, cost + own
                for letter in letters:
                    z = symbol(letter)
                    total += model[x, y, z]
                    x, y = y, z
                if (x, y) not in nxt or total < nxt[x, y][0]:
                    nxt[x, y] = (total, (text, letters))
        states = nxt
    text, out = min(((cost + model[a, b, EDGE], text) for (a, b), (cost, text) in states.items()), key=lambda s: s[0])[1], []
    while text:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


def restored(token: str, model: np.ndarray) -> str:
    """A token without the signs around it, restored if it looks disguised; no letters: empty."""
    around = STRIP + " " if " " in token else STRIP  # a row of single characters has gaps
    core = token.strip(around)
    bare = core.rstrip("$ " if " " in token else "$")
    if core.count("$", len(bare)) > 2 or not bare:  # three and more are ornament, one or two may be letters
        core = bare.strip(around)
    if not core or core.isalpha() and RUN.search(core) is None:
        return core
    if not any(c.isalpha() for c in core):
        return ""
    if parted := PARTED.fullmatch(core.replace(" ", "")):  # single letters parted by one and the same sign
        core = core.replace(parted[1], "") if " " not in core else row(core.replace(parted[1], " ").strip())
    return restore(core, model)


def row(spaced: str) -> str:
    """A row of single characters with one space in its narrowest gaps and two in wider ones."""
    gaps = [len(g) for g in GAP.findall(spaced)]
    return "".join(c + ("" if g is None else " " if g == min(gaps) else "  ") for c, g in zip(spaced.split(), [*gaps, None], strict=True))


def readings(token: str, model: np.ndarray) -> list[str]:
    """The distinct words of a token; a plain one with doubled letters is read as it stands and through the lattice."""
    word = restored(token, model)
    out = word.split()
    if word.isalpha() and PAIR.search(word):
        out += restore(word, model).split()
    return list(dict.fromkeys(out))


def features(word: str) -> list[int]:
    """Hashed features of a restored token: its words and their beginnings."""
    out = []
    for w in word.split():
        out.append(zlib.crc32(w.encode()) % FEATURES)
        out += [zlib.crc32(("^" + w[:k]).encode()) % FEATURES for k in range(3, 8) if len(w) > k]
    return out


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens; a row of single characters parted by spaces is more: with its gaps, without them, parted by the wide ones alone."""
    text = text.lower()
    every = text.split()
    out = set(every)
    if b"\1\1\1" in bytes(map((1).__eq__, map(len, every))):  # no three in a row: no match
        for m in SPACED.finditer(text):
            if any(c.isalpha() for c in m[0]):
                own = row(m[0])
                out |= {own, own.replace(" ", ""), *(x.replace(" ", "") for x in own.split("  "))}
    return out


class Cache:
    """What was worked out for tokens lately."""

    def __init__(self, make, most: int = 150_000):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __getitem__(self, token: str):
        got = self.young.get(token)
        if got is None:
            got = self.old.get(token)
            if got is None:
                got = self.make(token)
            self.young[token] = got
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
        return got


def _words(text: str, cache: Cache) -> set:
    return set().union(*(cache[t] for t in tokens(text)))


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> ftrl.Model:
    """labels: doc_id, toxic. The labelled sample is bounded, so one task can hold it."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")  # at most `sample` rows of 12 bytes
    # a repeated doc_id gives one row to the trainer, so that its bound holds
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(lambda t: readings(t, model))
        for batch in batches:
            index, value = [], []
            for text in batch.column("text").to_pylist():
                hashed = np.array([f for w in _words(text, cache) for f in features(w)], np.int32)
                at, n = np.unique(hashed, return_counts=True)
                index.append(at.tobytes())
                value.append(np.minimum(n, 65_535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "index": pa.array(index, pa.binary()), "value": pa.array(value, pa.binary())})

    def fit(table: pa.Table) -> pa.Table:
        # rows stay where they came in, as packed integers; the trainer makes doubles of one row at a time
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        index, value = ([np.frombuffer(x.as_buffer(), kind) for x in table.column(k)] for k, kind in (("index", np.int32), ("value", np.uint16)))
        m = ftrl.train([(index[i], value[i]) for i in order], table.column("toxic").to_numpy()[order], 2, FEATURES, alpha=0.1, l1=3.0, l2=0.1, epochs=3)
        w = m.weights[:, 1] - m.weights[:, 0]
        return pa.table({"feature": np.append(m.features, -1), "weight": np.append(w, m.intercept[1] - m.intercept[0])})

    found = rows.mapInArrow(freeing(extract), "doc_id long, toxic int, index binary, value binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(freed(fit), "feature long, weight double").collect()
    got = sorted((f, w) for f, w in found if f >= 0)
    weights = np.array([[0.0, w] for _, w in got]).reshape(-1, 2)
    return ftrl.Model(np.array([f for f, _ in got], np.int64), weights, np.array([0.0, next((w for f, w in found if f < 0), 0.0)]))


def _scorer(model: np.ndarray, classifier: ftrl.Model):
    weight = dict(zip(classifier.features.tolist(), classifier.weights[:, 1].tolist(), strict=True))
    bias = float(classifier.intercept[1])

    def make():
        words = Cache(lambda t: [(w, sum(weight.get(f, 0.0) for f in features(w))) for w in readings(t, model)])

        def scores(batch: pa.RecordBatch) -> np.ndarray:
            out = []
            for text in batch.column("text").to_pylist():
                # a word counts once, however it was written
                own = set().union(*(words[t] for t in tokens(text or "")))
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, bias + math.fsum(x for _, x in own))))))
            return np.array(out, float)

        return scores

    return make


def score(docs: DataFrame, model: np.ndarray, classifier: ftrl.Model) -> DataFrame:
    """doc_id, score, predicted of each row."""
    make = _scorer(model, classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in batches:
            p = scores(batch)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return documents(docs).mapInArrow(freeing(run), "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: np.ndarray, classifier: ftrl.Model) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5."""
    make = _scorer(model, classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) < 0.5))

    return docs.mapInArrow(freeing(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, ftrl.Model]:
    """Language model and classifier."""
    model = language_model(docs)
    return model, train(docs, labels, model, sample)
