"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased characters (runs of anything but letters count as one space),
hashed; values are log-damped counts times the inverse document frequency, normalised to length one. Document
frequencies are counted over all rows to learn from. The regression is trained by follow-the-regularised-leader with
an elastic net on a bounded sample of those rows: each language has an equal share of `sample` (the least hashes of
doc_id), so that a rare one is learned too; a fifth of the sample stays out and sets the temperature of the
probabilities. Texts are read whole, long ones in runs that carry the last characters over.

Result for each row: doc_id, lang_pred, score (probability of lang_pred). Texts without a letter and null texts are
`und` with score 0.0. Rows to learn from without text or lang are not used; without any, every text is `und`. Repeated
rows are scored one by one and count one by one. Equal scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm import ftrl
from meterwise.llm.common import mix

FEATURES = 1 << 15
SAMPLE = 8_000
RUN_CHARS = 1 << 18
ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, repeats included."""
    return np.concatenate(list(_runs(text)))


def _runs(text: str, run: int = RUN_CHARS) -> Iterator[np.ndarray]:
    """The n-grams that end in each run of characters, with a space before and after the text."""
    held, gap = np.full(1, 32, np.uint64), False
    yield _hashed(held, 1)
    for lo in range(0, len(text), run):
        points = np.frombuffer(text[lo : lo + run].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(ALPHA[points], points, 32)
        blank = c == 32
        c = c[~(blank & np.concatenate([[gap], blank[:-1]]))]
        gap = bool(blank[-1]) if blank.size else gap
        if c.size:
            held = np.concatenate([held, c.astype(np.uint64)])
            yield _hashed(held, c.size)
            held = held[-2:]
    yield _hashed(np.append(held, np.uint64(32)), 1)


def _hashed(c: np.ndarray, new: int) -> np.ndarray:
    """The 1-, 2- and 3-grams that end in the last `new` places of c."""
    out = [mix(c[-new:] * np.uint64(3) + np.uint64(1))]
    two = c[:-1] << np.uint64(21) | c[1:]
    out.append(mix(two[-new:] * np.uint64(3) + np.uint64(2)))
    if c.size > 2:
        out.append(mix((two[:-1] << np.uint64(21) | c[2:])[-new:] * np.uint64(3)))
    return (np.concatenate(out) >> np.uint64(49)).astype(np.int64)


def counts(text: str, run: int = RUN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their counts."""
    if len(text) <= run:
        total = np.bincount(grams(text), minlength=FEATURES)
    else:
        total = np.zeros(FEATURES, np.int64)
        for part in _runs(text, run):
            total += np.bincount(part, minlength=FEATURES)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(v @ v)
    return at, v / norm if norm else v


def document_frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the hashed features over all rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df[counts(text)[0]] += 1
                total += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(df[at], total), pa.int64())})

    found = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # FEATURES + 1 rows at most
    df, total = np.zeros(FEATURES), 0
    for feature, n in found:
        if feature < 0:
            total = n
        else:
            df[feature] = n
    return np.log((1 + total) / (1 + df)) + 1


def fit(learn: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, ftrl.Model | None]:
    """Languages, inverse document frequencies and model from doc_id, text, lang."""
    rows = learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang")).where("text is not null and lang is not null")
    idf = document_frequencies(rows)
    sizes = rows.where("doc_id is not null").groupBy("lang").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_share", F.floor(F.lit(sample) / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy(F.lit(1))))))  # a row for each language
    # hashes are even, so four times a language's share is met by a threshold; of those the least are taken
    near = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < (4 * F.greatest(F.col("_share"), F.lit(64)) / F.col("_n")) * 2.0**63
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    picked = rows.where("doc_id is not null").join(F.broadcast(sizes), "lang").where(near).withColumn("_at", F.row_number().over(first)).where("_at <= _share").select("doc_id", "text", "lang")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [vector(*counts(t), idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "at": pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), "v": pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())})

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        names = sorted(set(table.column("lang").to_pylist()))
        y = np.array([names.index(x) for x in table.column("lang").to_pylist()])
        data = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float)) for a, v in zip(table.column("at").to_pylist(), table.column("v").to_pylist(), strict=True)]
        apart = np.arange(len(y)) % 5 == 4
        m = ftrl.train([data[i] for i in np.flatnonzero(~apart)], y[~apart], len(names), FEATURES, alpha=1.0, l1=0.05, l2=0.01, epochs=2)
        weights = m.table(FEATURES)
        logits = np.array([m.logits(weights, *data[i]) for i in np.flatnonzero(apart)]).reshape(-1, len(names))
        t = ftrl.calibrate(logits, y[apart])
        return pa.table({
            "feature": pa.array([-1, *m.features], pa.int64()), "names": pa.array([names] + [None] * len(m.features), pa.list_(pa.string())),
            "weights": pa.array([[*m.intercept, t], *m.weights], pa.list_(pa.float64())),
        })

    found = picked.mapInArrow(extract, "doc_id long, lang string, at binary, v binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "feature long, names array<string>, weights array<double>").collect()
    found = sorted(found, key=lambda r: r[0])
    if not found:
        return [], idf, None
    k = len(found[0][1])
    model = ftrl.Model(np.array([r[0] for r in found[1:]], np.int64), np.array([r[2] for r in found[1:]]).reshape(-1, k), np.array(found[0][2][:k]), found[0][2][k])
    return found[0][1], idf, model


def predict(docs: DataFrame, names: list[str], idf: np.ndarray, model: ftrl.Model | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    table = (model.table(FEATURES) * idf[:, None]) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, score = [], []
            for text in batch.column("text").to_pylist():
                if model is None or not has_letter(text):
                    out.append("und")
                    score.append(0.0)
                    continue
                at, n = counts(text)
                damped = 1 + np.log(n)
                norm = np.sqrt(((damped * idf[at]) ** 2).sum())
                p = ftrl.softmax((damped @ table[at] / norm + model.intercept) / model.temperature)
                out.append(names[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(out, pa.string()), "score": pa.array(score, pa.float64())})

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
