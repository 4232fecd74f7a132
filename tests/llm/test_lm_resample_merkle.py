"""op11 to op13 against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("meterwise.llm")

from meterwise.llm import interpolate, merkle, resample  # noqa: E402

WORDS = "The old man and HIS dog went over a long Road to see what was left of their small red house by the sea".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASH = "grp string, rank string, total string, hash int, fold string, n string, place string, part string, weight string, data int, run string, item int"
EXTRA = ("g", "r", "t", 1, "f", "n", "p", "q", "w", 2, "x", 3)


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(11)
    out = [(i, " ".join(rng.choice(WORDS) + rng.choice(["", ",", "é", "7-"]) for _ in range(rng.randint(1, 50))), rng.choice(["en", "de", "fr"])) for i in range(90)]
    long = " ".join(rng.choice(WORDS) for _ in range(60_000)) + " " + "数据处理" * 150_000
    out += [(200, None, "en"), (201, "", "de"), (202, " \n\t", None), (203, "ß" * 300, None), (204, long, "en"), (205, out[3][1], "en"), (206, "only one", "zz")]
    # null ids, one id with two texts, repeated rows
    out += [(None, out[4][1], "en"), (None, "another text of no id", None), (7, "a second text of Seven", "en"), out[2], out[2]]
    return [(i, t, lang, rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, plain, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame([(*r, *EXTRA) for r in plain], f"{SCHEMA}, {CLASH}").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


# --- op11


def features_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(g.encode()) % resample.BUCKETS for g in [*w, *map(" ".join, zip(w, w[1:]))]]


def brute_resample(rows, target):
    s, t = (collections.Counter(b for x in texts for b in features_of(x)[1]) for texts in ([r[1] for r in rows], target))
    big_s, big_t = sum(s.values()) + resample.BUCKETS, sum(t.values()) + resample.BUCKETS
    out = []
    for i, text, *_ in rows:
        w, f = features_of(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(w), i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is not None, r[1] or 0))
    return out, able, 25 * len(able) // 100


def test_resampling_is_brute_force(spark, docs, plain):
    target = ["the red house by the sea", None, "", "a dog and a man", "a dog and a man"]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got = resample.resample(docs, items).collect()
    want, able, draws = brute_resample(plain, target)
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter(r[1:] for r in want)
    drawn = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, draws + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(r[4], r[1]) for r in able[:draws]]


def test_crc_of_words_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start, size = rng.integers(0, 4000, 300), rng.choice([0, 1, 5, 47, 48, 49, 900], 300)
    got = resample.crc_after(np.full(300, 0xFFFFFFFF, np.uint32), data, start, size) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]


@pytest.mark.parametrize("bits", [12, 3])
def test_radix_ranks_with_ties(spark, monkeypatch, bits):
    monkeypatch.setattr(resample, "DIGIT_BITS", bits)
    rng = random.Random(bits)
    # one score holds a third of all rows; ids are null, negative or large
    rows = [(7 if k % 3 == 0 else rng.randint(-50, 9000), rng.choice([None, -3, 5, 10**6 + k]), k) for k in range(400)]
    got = resample.radix_ranked(spark.createDataFrame(rows, "score long, doc_id long, k int").repartition(5), [("score", True), ("doc_id", False)]).collect()
    assert sorted(r.place for r in got) == list(range(400)) and {r.k for r in got} == set(range(400))
    key = lambda s, d: (-s, d is not None, d or 0)
    assert [(r.score, r.doc_id) for r in sorted(got, key=lambda r: r.place)] == sorted(((s, d) for s, d, _ in rows), key=lambda x: key(*x))


def test_resampling_of_nothing(spark, empty, docs):
    assert resample.resample(empty, empty).collect() == []
    assert resample.resample(docs, empty).count() == docs.count()
    short = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_features, r["rank"]) for r in resample.resample(short, short).collect()} == {(1, 3, None), (2, 0, None)}


# --- op12


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def grams_of(text, order):
    """For each token its k-grams, farther tokens first, k from 1."""
    w = ["<s>"] * (order - 1) + tokens_of(text)
    return [[tuple(w[i - k : i + 1]) for k in range(order)] for i in range(order - 1, len(w))]


def counted(texts, order):
    c = collections.Counter(g for t in texts for row in grams_of(t, order) for g in row)
    for k in range(1, order):
        c[("<s>",) * k] = len(texts)
    return c


def level_of(n):
    return min(n.bit_length(), interpolate.LEVELS - 1)


def shares_of(row, c, weights, trained, known):
    """Each order's share in an event's probability, the uniform's first."""
    shares = [1 / (known + 1)]
    for k, g in enumerate(row):
        context = trained if k == 0 else c[g[:-1]]
        a = 0.0 if not context else weights[k][0 if k == 0 else level_of(context)]
        shares = [(1 - a) * s for s in shares] + [a * c[g] / context if context else 0.0]
    return shares


def folds(i):
    left = None if i is None else zlib.crc32(str(i).encode()) % 7
    return 2 if left == 2 else 1 if left == 3 else 0


def fold_column():
    left = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return F.when(left == 2, 2).when(left == 3, 1).otherwise(0)


@pytest.mark.parametrize(("order", "run_bytes", "bucket_bytes"), [(3, 2000, 40_000), (2, 1 << 20, 1 << 22), (1, 500, 1 << 22)])
def test_interpolation_is_brute_force(docs, plain, order, run_bytes, bucket_bytes):
    learned = interpolate.learn(docs, fold_column(), order, run_bytes, bucket_bytes)
    texts = {f: [r[1] for r in plain if folds(r[0]) == f] for f in (0, 1, 2)}
    assert all(texts.values())
    c = counted(texts[0] + texts[1], order)
    known, trained = len({g for g in c if len(g) == 1 and g != ("<s>",)}), sum(n for g, n in c.items() if len(g) == 1 and g != ("<s>",))
    assert (learned.known, learned.trained) == (known, trained)
    want = []
    for i, text, *_ in plain:
        rows = grams_of(text, order)
        base = sum(math.log10((c[r[0]] + 1) / (trained + known + 1)) for r in rows)
        score = sum(math.log10(sum(shares_of(r, c, learned.model.weights, trained, known))) for r in rows)
        want.append((i, folds(i), len(rows), sum(c[r[0]] > 0 for r in rows), trained, base, score))
    got = interpolate.score(docs, fold_column(), learned).collect()
    order_by = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=order_by), sorted(want, key=order_by), strict=True):
        assert a[:5] == b[:5] and close(a[5], b[5]) and close(a[6], b[6])


def test_weights_are_those_of_expectation_maximisation(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[:9]) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    learned = interpolate.learn(docs, fold_column(), 3)
    left, held = [t for i, t in rows if folds(i) == 0], [t for i, t in rows if folds(i) == 1]
    c, every = counted(left, 3), counted(left + held, 3)
    known, trained = sum(len(g) == 1 for g in every) - 1, sum(len(tokens_of(t)) for t in left)
    events = [r for t in held for r in grams_of(t, 3)]
    assert max(v for g, v in c.items() if len(g) > 1 or g == ("<s>",)) <= 40
    weights = interpolate.Mixture(3).weights
    last, gains = None, []
    for _ in range(25):
        got, kept, now = np.zeros((3, interpolate.LEVELS)), np.zeros((3, interpolate.LEVELS)), 0.0
        for row in events:
            # counts over 16 are tallied to four digits
            coarse = {g: int(interpolate.coarse(np.array([c[g]]))[0]) for g in [*row, *[g[:-1] for g in row]]}
            shares = shares_of(row, collections.Counter(coarse), weights, trained, known)
            p = sum(shares)
            now += math.log(p)
            reach = 1.0
            for k in (2, 1, 0):
                at = 0 if k == 0 else level_of(coarse[row[k][:-1]])
                got[k, at] += reach
                kept[k, at] += shares[k + 1] / p
                reach -= shares[k + 1] / p
        new = np.where(got > 0, (kept + 0.5) / (got + 1.0), np.nan)
        for k in range(3):
            new[k, 0] = 0.5 if np.isnan(new[k, 0]) else new[k, 0]
            for at in range(1, interpolate.LEVELS):
                if np.isnan(new[k, at]):
                    new[k, at] = new[k, at - 1] if at > 1 else 0.5
        weights = interpolate.Mixture(3, new).weights
        gains.append(now)
        if last is not None and now - last <= 1e-5 * abs(last):
            break
        last = now
    assert len(gains) > 2 and gains[-1] > gains[0]
    np.testing.assert_allclose(learned.model.weights, weights, atol=1e-9)


def test_probabilities_sum_to_one(docs, plain):
    learned = interpolate.learn(docs, fold_column(), 3, 4000)
    c = counted([r[1] for r in plain if folds(r[0]) != 2], 3)
    known = [g for g in c if len(g) == 1 and g != ("<s>",)]
    for history in (("<s>", "<s>"), ("the", "old"), ("<s>", "sea"), ("never", "seen"), ("never", "the")):
        total = sum(sum(shares_of([w, history[1:] + w, history + w], c, learned.model.weights, learned.trained, learned.known)) for w in [*known, ("an unknown word",)])
        assert close(total, 1.0)


def test_interpolation_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert interpolate.score(none, fold_column(), interpolate.learn(none, fold_column())).collect() == []
    # no training texts: everything is uniform over the unknown
    one = [i for i in range(50) if folds(i) == 2][0]
    spark.createDataFrame([(one, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "one"))
    held = spark.read.parquet(str(tmp_path / "one"))
    (row,) = interpolate.score(held, fold_column(), interpolate.learn(held, fold_column())).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_runs_do_not_depend_on_batches(monkeypatch):
    monkeypatch.setattr(interpolate, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 2), b"x" * rng.randint(0, 40)) for i in range(300)]

    def cut(size, keep=(0, 1, 2)):
        some = [r for r in rows if r[1] in keep]
        batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part]), "fold": pa.array([r[1] for r in part], pa.int32()), "data": pa.array([r[2] for r in part], pa.binary())}) for part in (some[k : k + size] for k in range(0, len(some), size))]
        return {(n, f): t.column("doc_id").to_pylist() for n, f, t in interpolate.runs(iter(batches), 100)}

    whole = cut(300)
    assert whole == cut(7) and {k: v for k, v in whole.items() if k[1] == 1} == cut(11, (1,)) and len(whole) > 20


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (interpolate.unplanes(interpolate.planes(keys)) == keys).all()
    values = rng.choice([0, 1, 254, 255, 256, 10**12], 500)
    assert (interpolate.large(interpolate.small(values)) == values).all()


# --- op13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(hashes):
    """The root, and the (left, right) siblings of each node, level by level."""
    paths, owners = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, own = [], []
        for a in range(0, len(hashes), 8):
            run = hashes[a : a + 8]
            for k in range(len(run)):
                for i in owners[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            own.append([i for o in owners[a : a + 8] for i in o])
        hashes, owners = up, own
    return hashes[0], paths


def brute_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, source, n: sha(*map(field, (i, source, lang, n, t)))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        some = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append((some, *brute_tree([leaf(*r) for r in some])))
    root, above = brute_tree([t[1] for t in trees])
    out = []
    for (some, subroot, paths), high in zip(trees, above, strict=True):
        for r, path in zip(some, paths, strict=True):
            steps = path + high
            h = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(*r)
            for x, y in steps:
                h = sha(x, h, y)
            out.append((r[0], leaf(*r), subroot, root, sha(*[x + y for x, y in steps]), h, h == root))
    return out


@pytest.mark.parametrize("digits", [3, 1])
def test_manifest_is_brute_force(docs, plain, monkeypatch, digits):
    # with one digit a block, 60 leaves of a language climb over several tables of blocks
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 8**digits)
    got = merkle.proofs(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_manifest(plain))
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_many_languages_and_of_one_document(spark, empty):
    assert merkle.proofs(empty).collect() == []
    one = [(0, "Text", "en", "s", 4)]
    for rows in (one, [(i, f"T{i}", f"l{i % 70}", None, None) for i in range(150)], [(i, "t", "en", "s", 1) for i in range(600)]):
        got = merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(brute_manifest(rows))
