"""Small fixtures against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import gc
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

pytest.importorskip("meterwise.llm")

from meterwise.llm import bottomk, components, dac, feistel, ftrl, jaccard, langid, prefix_doubling, segment, suffix_dedup, tiling, toxicity, urlrules  # noqa: E402
from meterwise.llm.common import Substrings, mix  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
WORDS = "the old man and his dog went over a long road to see what was left of their small red house by the sea".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    passage = sentence(rng, 40)
    out = list(base)
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out += [" ".join(w), t]
    out += [f"{sentence(rng, 20)} {passage} {sentence(rng, 9)}" for _ in range(5)]
    out += [None, "", " \n", "a", "é" * 30 + " é" * 40, "x" * 200, "x" * 130, "long " * 3000, "日本語 テキスト " * 20]
    return [(i * 7 + 3, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns under names that operators use inside
    return spark.createDataFrame([(i, t, 1, "z", 2.0) for i, t in rows], DOCS + ", row_no int, sha string, bucket double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_removed(rows, length):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows if i is not None):
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [64, 1])
def test_suffix_dedup_is_brute_force(spark, rows, docs, hot):
    got = suffix_dedup.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, 50)


@pytest.mark.parametrize("length", [50, 20])
def test_doubling_of_every_position_is_brute_force(spark, rows, length):
    some = spark.createDataFrame(rows, DOCS).repartition(3)
    got = suffix_dedup.remove_repeats(some, length=length, every_position=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_removed(rows, length)


def test_doubling_null_ids_repeated_rows_and_empty(spark, rows, empty):
    some = spark.createDataFrame(rows[:12] + rows[:3] + [(None, rows[0][1])], DOCS)
    got, plain = (suffix_dedup.remove_repeats(some, every_position=e).select("doc_id", "n_removed", "kept_sha256").collect() for e in (True, False))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, plain), key=str)
    assert suffix_dedup.remove_repeats(empty, every_position=True).count() == 0


def test_doubling_across_batches(monkeypatch):
    """Pairs that go over the end of a batch, batches of one row, and rows alone with their pair."""
    rng = np.random.default_rng(1)
    pairs = np.sort(rng.integers(0, 12, 40) * 100 + rng.integers(0, 3, 40))
    whole = pa.RecordBatch.from_pydict({"doc_id": np.arange(40), "pos": np.arange(40, dtype=np.int32), "rank": pairs // 100, "next": pairs % 100})
    monkeypatch.setattr(prefix_doubling.TaskContext, "get", classmethod(lambda cls: type("C", (), {"partitionId": lambda self: 2})()))
    _, inverse, count = np.unique(pairs, return_inverse=True, return_counts=True)
    for cuts in ([0, 40], list(range(41)), [0, 0, 7, 8, 21, 40]):
        got = pa.Table.from_batches(prefix_doubling._number(whole.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
        assert got.column("doc_id").to_pylist() == np.flatnonzero(count[inverse] > 1).tolist()
        assert got.column("rank").to_pylist() == [2 * prefix_doubling.ROOM + int(x) for x in inverse[count[inverse] > 1]]


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_decides_by_ranks_not_hashes(monkeypatch, rows, hot):
    """Where nearly all hashes are equal, only the integer ranks of prefix doubling tell strings apart."""
    every, whole = Substrings.every, Substrings.hash
    monkeypatch.setattr(Substrings, "every", lambda self, k: every(self, k) & np.uint64(7))
    monkeypatch.setattr(Substrings, "hash", lambda self, start, end: whole(self, start, end) & np.uint64(1))
    first, some = {}, []
    for i, t in rows:
        if len(t or "") < 5000 and first.setdefault(t or "", i) == i:
            some.append((i, t or ""))

    def dealt(batches, f):
        table = pa.Table.from_batches(batches)
        return pa.concat_tables(f(table.filter(pc.equal(table.column("bucket"), b))) for b in set(table.column("bucket").to_pylist())).to_pylist()

    def batch(own):
        return pa.RecordBatch.from_pylist(own, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("codes", pa.list_(pa.int64()))]))

    halves = [[{"doc_id": i, "text": t} for i, t in some[k::2]] for k in (0, 1)]
    sent = [x for h in halves for x in suffix_dedup._anchors(3, 50, 20, hot)(iter([batch(h)]))]
    codes = collections.defaultdict(list)
    for r in dealt(sent, suffix_dedup._shared(hot)):
        codes[r["doc_id"]].append(r["code"])
    halves = [[d | {"codes": codes[d["doc_id"]]} for d in h if codes[d["doc_id"]]] for h in halves]
    sent = [x for h in halves for x in suffix_dedup._strings(3, 50, 20)(iter([batch(h)]))]
    gone = {i: bytearray(len(t.encode())) for i, t in some}
    for r in dealt(sent, suffix_dedup._rank_strings(50, most=4000)):
        at, n = divmod(r["code"], suffix_dedup.WIDE)
        gone[r["doc_id"]][at : at + n + 49] = b"\1" * (n + 49)
    assert {i: sum(g) for i, g in gone.items()} == {i: n for i, _, n, *_ in brute_removed(some, 50)}


def peak(f) -> tuple[int, list]:
    """Most bytes that f's arrays and objects take at once, and what it returns."""
    gc.collect()
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_suffix_dedup_tasks_stay_small():
    """A task's arrays follow its chunks, not its whole input, and no batch that it gives away is large."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(5000)]
    texts = [" ".join(vocabulary[w] for w in rng.integers(0, 5000, 380)) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(3000), pa.int64()), "text": texts})
    most, sent = peak(lambda: list(suffix_dedup._anchors(48, 50, 20, 512)(iter([batch]))))
    total = sum(len(x) for b in sent for x in b.column("name").to_pylist()) // 6
    assert total > 400_000 and most < 60 << 20 and max(b.nbytes for b in sent) < 2 << 20
    # every fifth anchor of each text is asked for
    at = collections.defaultdict(list)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    run = suffix_dedup.Run(offsets, np.frombuffer("".join(texts).encode(), np.uint8), 50, 20)
    for d, p in zip(run.doc[::5].tolist(), (run.at - offsets[run.doc])[::5].tolist(), strict=True):
        at[d].append(4 * p + suffix_dedup.ASK)
    del run
    asked = batch.append_column("codes", pa.array([at[d] for d in range(3000)], pa.list_(pa.int64())))
    most, sent = peak(lambda: list(suffix_dedup._strings(48, 50, 20)(iter([asked]))))
    assert most < 60 << 20 and max(b.nbytes for b in sent) < 2 << 20
    spans = batch.append_column("spans", pa.array([[100 * suffix_dedup.WIDE + 10]] * 3000, pa.list_(pa.int64())))
    found = spans.append_column("copy", pa.array([False] * 3000)).append_column("carried", pa.array(range(3000)))
    most, rows = peak(lambda: [b.nbytes for b in suffix_dedup._remove(50)(iter([found]))])
    assert most < 20 << 20 and max(rows) < 1 << 20


def test_trainer_takes_packed_rows_in_little_memory():
    """Small integers give the very weights that doubles give; features that are not met cost no more than their sums."""
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(1 << 20, 50, False)).astype(np.int32), rng.integers(1, 9, 50).astype(np.uint16)) for _ in range(20)]
    labels = np.arange(20) % 2
    most, m = peak(lambda: ftrl.train(rows, labels, 2, 1 << 20, l1=0.1))
    plain = ftrl.train([(i, v.astype(float)) for i, v in rows], labels, 2, 1 << 20, l1=0.1)
    assert m.features.size and (m.features == plain.features).all() and (m.weights == plain.weights).all() and (m.intercept == plain.intercept).all()
    assert most < 48 << 20


def test_ranks_of_a_task_are_brute_force():
    rng = random.Random(4)
    bodies = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 60))).encode() for _ in range(40)]
    bodies = [x + b"\0" * 3 for x in bodies[:9]] + bodies + bodies[:7]
    width = np.array([len(x) for x in bodies])
    begin, data = np.cumsum(width) - width, np.frombuffer(b"".join(bodies), np.uint8)
    for length in (50, 21, 8):
        at, rank = prefix_doubling.ranks_in(data, begin, width, length)
        met = collections.defaultdict(list)
        for b, w in zip(begin, width, strict=True):
            for p in range(b, b + w - length + 1):
                met[data[p : p + length].tobytes()].append(p)
        of = collections.defaultdict(list)
        for p, r in zip(at.tolist(), rank.tolist(), strict=True):
            of[r].append(p)
        assert sorted(of.values()) == sorted(v for v in met.values() if len(v) > 1)
    rows = np.zeros((len(bodies), 64), np.uint8)
    for i, x in enumerate(bodies):
        rows[i, : len(x)] = np.frombuffer(x, np.uint8)
    rank = prefix_doubling.ranks_of_rows(rows, width)
    assert all((rank[i] == rank[j]) == (bodies[i] == bodies[j]) for i in range(len(bodies)) for j in range(len(bodies)))


def test_suffix_dedup_null_ids_repeated_rows_and_empty(spark, rows, empty):
    some = rows[:12] + rows[:3] + [(None, rows[0][1])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(some, DOCS)).select("doc_id", "n_removed").collect()
    want = {i: n for i, _, n, *_ in brute_removed(rows[:12], 50)}
    assert sorted((r[0] or -1, r[1]) for r in got) == sorted([(i, want[i]) for i, _ in rows[:12] + rows[:3]] + [(-1, 0)])
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("noise", "kinds"), [(0.02, 1), (0.1, 40), (0.3, 1), (0.3, 40), (0.6, 2)])
def test_candidates_are_pairs_that_share_a_band(noise, kinds):
    rng = np.random.default_rng(7)
    base, least = rng.integers(0, 1 << 16, (kinds, jaccard.HASHES)).astype("<u2"), jaccard.least_matches()

    def near(n):
        out = base[rng.integers(0, kinds, n)].copy()
        hit = rng.random(out.shape) < noise
        out[hit] = rng.integers(0, 1 << 16, int(hit.sum()))
        return out

    a, b = near(300), near(170)
    for x, y in ((a, b), (a, a), (a[:0], b)):
        same = x[:, None, :] == y[None]
        want = same.reshape(len(x), len(y), jaccard.HASHES // jaccard.BAND, jaccard.BAND).all(3).any(2)
        for n, least_equal in least.items():
            want &= same[:, :, :n].sum(2) >= least_equal
        assert (jaccard.candidates(x, y, least) == (np.triu(want, 1) if x is y else want)).all()


def shingle_set(text, n=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [4096, 2])
def test_jaccard_join_is_brute_force(docs, rows, block):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs, block=block).collect()}
    assert got == {i: (find(i), links[i]) for i in sets}


def test_jaccard_join_repeated_null_and_empty(spark, rows, empty):
    some = spark.createDataFrame([*rows[:5], *rows[:2], (None, "a b c d e f")], DOCS)
    assert sorted(r.doc_id for r in jaccard.join(some).collect()) == sorted(i for i, _ in rows[:5])
    assert jaccard.join(empty).count() == 0


def test_least_matches_rise():
    least = jaccard.least_matches()
    assert list(least) == [32, 64, 96] and 10 < least[32] < least[64] < least[96] < 77


def test_entries_survive_packing():
    values = np.array([1, 5, 9, 1, 5, 7, 1, 9, 11], np.uint64)
    e = jaccard.Entries(np.array([3, 4, 8]), np.array([1, 2, 1]), np.zeros((3, jaccard.HASHES), "<u2"), values, np.array([0, 3, 6, 9]))
    f = jaccard.Entries.from_bytes(e.to_bytes())
    assert (f.values == values).all() and (f.first == e.first).all() and (f.copies == e.copies).all()


def test_components_on_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, components.components(edges).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_tiling_finds_reordered_passages(spark, empty):
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(12)) for _ in range(3))
    items = spark.createDataFrame([(1, f"{a} {b} {c}"), (2, "one two three"), (3, ""), (None, a), (4, f"{a} {sentence(rng, 60)}")], "item_id long, text string")
    texts = [f"x {c} y y {a.upper()} z {b}.", f"only {a} here", "One, two; three!", "nothing", None, ""]
    got = {r.doc_id: (r.leaks, round(r.coverage, 6)) for r in tiling.scores(spark.createDataFrame(list(enumerate(texts)), DOCS), items).collect()}
    assert got[0] == ([1], 1.0) and got[1] == ([], round(1 / 3, 6)) and got[2] == ([2], 1.0)
    assert got[3] == got[4] == got[5] == ([], 0.0)
    kept = tiling.without_leaks(spark.createDataFrame(list(enumerate(texts)), DOCS), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert tiling.scores(empty, items).count() == 0 and tiling.scores(spark.createDataFrame([(1, "a")], DOCS), items.limit(0)).count() == 1


def test_a_hundred_thousand_rules_of_one_host(spark):
    """Rules are put in order once, not for each URL; the longest path that fits still wins."""
    import time

    rules = spark.range(100_000).selectExpr("'big.example' AS host", "concat('/', id % 100, '/', id) AS path", "if(id % 2 = 0, 'block', 'allow') AS verdict")
    rules = rules.unionByName(spark.createDataFrame([("example", "/", "block"), ("big.example", "/7/", "allow"), ("big.example", "/7/", "block")], "host string, path string, verdict string"))
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://www.big.example/', id % 100, '/', id, '?q') AS url")
    pages = pages.unionByName(spark.createDataFrame([(-1, "http://big.example/7/x"), (-2, "http://big.example/zz"), (-3, "http://example/"), (-4, "http://other/7/7")], "page_id long, url string"))
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(pages, rules).collect()}
    assert time.time() - began < 90
    # /5/105 also starts with the rule of /5/10 or /5/1, if there is one; the longest wins
    assert all(got[i] == (f"big.example/{i % 100}/{i}", "block" if i % 2 == 0 else "allow") for i in range(20_000))
    assert got[-1] == ("big.example/7/", "allow") and got[-2] == ("example/", "block") and got[-3] == ("example/", "block") and got[-4] == (None, "allow")


def brute_coverage(doc, item, least=5):
    """Item tokens covered: the longest common run of unmarked tokens is marked until none of `least` is left."""
    k, marked_doc, marked_item, covered = min(least, len(item)), set(), set(), 0
    while item:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_doc and q + n not in marked_item:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < k:
            return covered / len(item)
        marked_doc |= set(range(p, p + n))
        marked_item |= set(range(q, q + n))
        covered += n
    return 0.0


@pytest.mark.parametrize(("broadcast", "cells"), [(1 << 24, 1 << 12), (0, 0)])
def test_tiling_is_brute_force(spark, monkeypatch, broadcast, cells):
    monkeypatch.setattr(tiling, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(tiling, "CELLS", cells)  # 0: every pair by search
    rng = random.Random(11)
    words = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    items = [(i, words(rng.choice([2, 4, 9, 25, 40]))) for i in range(12)] + [(3, words(12)), (20, ["zz"] * 12)]
    texts = []
    for i in range(24):
        parts = [rng.choice(items)[1] for _ in range(rng.randint(0, 3))]
        cuts = [p[rng.randint(0, 5) :] for p in parts]
        texts.append([w for c in cuts for w in [*c, *words(3)]] or words(6))
    texts.append(["zz"] * 30)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1, " ".join(texts[1])), (None, " ".join(texts[2])), (None, " ".join(texts[3])), (50, None), (51, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS + ", text_key int, seed int")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(0, " ".join(items[0][1])), (None, "a b c d e f")], "item_id long, text string")
    want = []
    for i, t in rows:
        cover = [(brute_coverage((t or "").split(), w), -k) for k, w in items]
        top, by = max(cover)
        want.append((i, sorted({-k for c, k in cover if c >= 0.5}), round(top, 9), -by if top else None))
    got = [(r.doc_id, r.leaks, round(r.coverage, 9), r.item_id) for r in tiling.scores(docs, table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = tiling.without_leaks(docs, table)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, leaks, *_ in want if not leaks)


def test_repeated_tokens_are_tiled_in_the_sum_of_their_places(spark):
    """80 million matching places of one word; the places of each side are sent once."""
    import time

    turn = " ".join(["ab cd ef"] * 4000)
    texts = [(1, "zz " * 40_000), (2, f"start {'zz ' * 700}middle {'zz ' * 900}end"), (3, turn), (4, "something else")]
    items = [(1, "zz " * 2_000), (2, "ab cd ef " * 500 + "gh")]
    began = time.time()
    got = {r.doc_id: (r.leaks, round(r.coverage, 6)) for r in tiling.scores(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: ([1], 1.0), 2: ([1], 0.8), 3: ([2], round(1500 / 1501, 6)), 4: ([], 0.0)}
    assert time.time() - began < 120


def test_both_ways_to_tile_agree():
    rng = np.random.default_rng(2)
    for _ in range(60):
        k, size = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        doc, item = rng.integers(0, size, rng.integers(3, 60)), rng.integers(0, size, rng.integers(3, 40))
        places = lambda x: {g: [i for i in range(len(x) - k + 1) if tuple(x[i : i + k]) == g] for g in {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}}  # noqa: E731,B023
        a, b = places(doc), places(item)
        shared = sorted(set(a) & set(b))
        if not shared:
            continue
        pos, at = (pa.array([x[g] for g in shared], pa.list_(pa.int32())) for x in (a, b))
        flat = lambda x: (np.concatenate([x[g] for g in shared]), np.concatenate([[i] * len(x[g]) for i, g in enumerate(shared)]))  # noqa: E731,B023
        assert tiling.covered(pos, at, k, len(item)) == tiling.searched(*flat(a), *flat(b), k)


def test_greedy_tiles_take_the_longest_first():
    assert sorted(tiling.tile([(6, 0, 0), (9, 3, 10), (5, 20, 12)], 40, 40, 3)) == [(3, 0, 0), (9, 3, 10)]


def test_dac_random_access_and_round_trip(spark, rows, docs, empty, tmp_path):
    ids = np.array([0, 1, 255, 256, 65_536, 2**32 - 1, 77, 49_407] * 300, np.uint32)
    codes = dac.Codes.from_bytes(dac.Codes.encode(ids).to_bytes())
    assert (codes.decode() == ids).all() and all(codes[i] == ids[i] for i in range(0, len(ids), 7))
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    extra = [(10_001, "Don't STOP!! a<|endoftext|>b <|ENDOFTEXT|> x.É É…..,b"), (10_002, "ß.ẞ ﬁ,İ.x 1.5a's.'S")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, DOCS))
    dac.write(df, str(tmp_path / "codes"), path)
    blocks = spark.read.parquet(str(tmp_path / "codes"))
    start, want, flat = 0, [], []
    for i, t in sorted([*rows, *extra]):
        own = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
        flat += own
    assert sorted(map(tuple, dac.read(blocks).collect())) == want
    assert [dac.token(blocks, p) for p in (0, 17, len(flat) - 1)] == [flat[0], flat[17], flat[-1]] and dac.token(blocks, len(flat)) is None
    dac.write(empty, str(tmp_path / "none"), path)
    assert dac.read(spark.read.schema(blocks.schema).parquet(str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = feistel.permute(x, n, 9)
    assert sorted(y) == list(range(n)) and (feistel.permute(y, n, 9, inverse=True) == x).all()


def test_shards_are_even_and_computable(spark, rows, docs, empty):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([rows[0], (None, "x")], DOCS))
    got = feistel.shard(df, 8).collect()
    total = len(rows) + 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert feistel.row_of(r.shard, r.slot, 8, total) == r.row_no
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r.size == len((dict(rows).get(r.doc_id) or "").encode()) + 1 for r in got if r.doc_id is not None)
    assert feistel.shard(empty).count() == 0


def test_bottomk_against_sets(spark, rows, docs, empty):
    got = {r.doc_id: r for r in bottomk.fingerprints(docs, k=64).collect()}
    order = sorted(rows)
    exact = 0
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, value in ((edited, got[i].near_edited), (nxt, got[i].near_next)):
            a, b = shingle_set(t), shingle_set(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            if len(a | b) <= 64:
                exact += 1
                assert value == pytest.approx(want)
            else:
                assert abs(value - want) < 0.3
        if len(shingle_set(t)) < 64 and len(shingle_set(edited)) < 64 and len(shingle_set(t) | shingle_set(edited)) <= 64:
            a, b = shingle_set(t), shingle_set(edited)
            assert got[i].n_shingles == len(a) and got[i].edited_n_shingles == len(b)
            assert got[i].in_edited == pytest.approx(len(a & b) / len(a) if a else 1.0)
    assert exact > 20 and bottomk.fingerprints(empty).count() == 0
    twice = spark.createDataFrame([rows[3], (1, rows[3][1]), (1, rows[3][1]), (None, None)], DOCS)
    same = {tuple(r.sketch) for r in bottomk.fingerprints(twice).collect() if r.doc_id is not None}
    assert len(same) == 1


def test_bottomk_merge(spark):
    from pyspark.sql import functions as F

    df = bottomk.with_sketch(bottomk.with_sketch(spark.createDataFrame([("a b c d e f g", "b c d e f x y z")], "p string, q string"), "p", "s"), "q", "t")
    r = df.select(F.size(bottomk.merge(F.col("s"), F.col("t"))).alias("n"), bottomk.containment(F.col("s"), F.col("t")).alias("c"), bottomk.distinct_count(F.col("s")).alias("d")).first()
    assert r.n == 6 and r.c == pytest.approx(1 / 3) and r.d == 3.0


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    cut = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    path = tail[:cut]
    fits = [(h.count(".") + 1, len(p), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None


def test_url_rules_are_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/", "block"), ("www.example.net", "/en/x", "block"), ("com", "/de/", "block"), ("org", "/fr/", "allow")]
    rng = random.Random(1)
    hosts = ["example.net", "WWW.Example.net", "a.b.example.net", "net", "xnet", "example-x.net", "example.com", "de.org", "", "net:80"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/xy', '/de/q', '/fr/?a=/en/', '?x=1', '#f', '/a://b/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "mailto:a@example.net", "://example.net/en/"] + ["http://example.net/hot/"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], "host string, path string, verdict string")
    verdict = {h + p: v for h, p, v in rules}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = brute_verdict(u, rules)
        assert got[i] == (host, path, rule, verdict.get(rule, "allow")), u
    assert urlrules.judge(pages.limit(0), df).count() == 0 and urlrules.judge(pages, df.limit(0)).count() == len(urls)


def test_viterbi_restores_disguised_words(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["idiot", "stupid", "moron", "house", "garden", "dog", "loser", *WORDS]) for _ in range(4000))
    model = toxicity.language_model(spark.createDataFrame([(1, text), (2, None), (3, "")], DOCS))
    for seen, want in {"1d10t": "idiot", "st*upid": "stupid", "stuuuupid": "stupid", "m.o.r.o.n": "moron", "l0s3r": "loser", "$tupid": "stupid", "dog,": "dog", "2024": "", "!!": "", "gardenn": "gardenn"}.items():
        assert toxicity.restored(seen, model).strip() == want, seen
    assert "stupid" in toxicity.tokens("you s t u p i d man")


def test_spaced_rows_and_doubled_letters_are_decoded(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["idiot", "stupid", "moron", "a", "you", "are", "dumb", "boob", "good", *WORDS]) for _ in range(6000))
    model = toxicity.language_model(spark.createDataFrame([(1, text)], DOCS))
    read = lambda t: toxicity._words(t, toxicity.Cache(lambda x: toxicity.readings(x, model)))
    assert {"a", "stupid"} <= read("house a s t u p i d")
    assert {"you", "are", "dumb"} <= read("y o u  a r e  d u m b") and {"you", "are", "dumb"} <= read("y o u \t a r e   d u m b")
    assert "boob" in read("b o o b") and "stupid" in read("- s t u u p 1 d !") and "moron" in read("m . o . r . o . n")
    assert {"stupid", "idiot", "good"} <= read("stuupid iiddiioott good") and read("a b") == {"a", "b"} and read("1 2 3 4") == set()


def test_toxicity_learns_and_scores(spark, empty):
    rng = random.Random(4)
    data = [(i, sentence(rng, 60) + (" you st0pid m0ron loser" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in data[:160]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model, classifier = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, classifier).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in data[160:]]) > 0.95
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    kept = toxicity.clean(docs, model, classifier)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert toxicity.score(empty, model, classifier).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, *none).count() == 242


def test_language_id_learns(spark, empty):
    rng = random.Random(6)
    speech = {"en": ["the", "house", "with", "thing"], "de": ["schön", "haus", "mit", "über"], "fr": ["maison", "être", "avec", "où"]}
    data = [(i, " ".join(rng.choice(speech[k]) for _ in range(30)), k) for i in range(240) for k in [list(speech)[i % 3]]]
    docs = spark.createDataFrame([*data, (500, None, "en"), (501, "12 !", "en"), (502, "haus mit", None)], DOCS + ", lang string")
    names, idf, model = langid.fit(docs.where("doc_id < 150 or doc_id > 499"))
    got = {r.doc_id: r for r in langid.predict(docs, names, idf, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in data[150:]]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(empty, names, idf, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, *langid.fit(docs.limit(0))).collect()} == {"und"}


def brute_grams(text):
    c = [32]
    last = None
    for x in text.lower():
        if x.isalpha() or last != 32:
            c.append(ord(x) if x.isalpha() else 32)
        last = ord(x) if x.isalpha() else 32
    c.append(32)
    return collections.Counter(tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1))


@pytest.mark.parametrize("text", ["", "a", " ", "A b..c 12 d", "x" * 40, "日本 語!", "emoji \U0001f600\U0001f600 no letter", "ab  " * 30])
def test_grams_of_runs_are_those_of_the_whole(text):
    at, n = langid.counts(text)
    for run in (1, 2, 7):
        at2, n2 = langid.counts(text, run)
        assert at.tolist() == at2.tolist() and n.tolist() == n2.tolist()
    assert n.sum() == sum(brute_grams(text).values())
    assert not langid.has_letter("\U0001f600 12")


def test_a_rare_language_is_learned(spark):
    rng = random.Random(7)
    speech = {"en": ["the", "house", "with", "thing"], "sv": ["över", "från", "något", "hjälp"]}
    rows = [(i, " ".join(rng.choice(speech["sv" if i % 100 == 0 else "en"]) for _ in range(12)), "sv" if i % 100 == 0 else "en", 1.0) for i in range(4000)]
    rows += [(7, "the house", "en", 1.0)] * 50 + [(None, "från något", "sv", 1.0)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, _n double")
    got = langid.predict(docs, *langid.fit(docs, sample=200)).collect()
    assert len(got) == len(rows) and np.mean([r.lang_pred == x[2] for r, x in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda x: (x[0] is None, x[0])), strict=True)]) > 0.99


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        k = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 500, 5), k))
        rows.append((at, np.ones(at.size)))
        y.append(k)
    m = ftrl.train(rows, np.array(y), 3, 500, l1=2.0)
    assert set(range(3)) <= set(m.features.tolist()) and m.features.size < 250
    logits = np.array([m.logits(m.table(500), *r) for r in rows])
    assert (logits.argmax(1) == y).mean() > 0.95
    assert ftrl.calibrate(np.array([[4.0, 0.0]] * 4), np.array([0, 0, 0, 1])) == pytest.approx(4 / np.log(3), rel=1e-3)


def test_gumbel_samples_follow_the_lattice():
    v = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    signed = segment.SPACE + b"the cat".replace(b" ", segment.SPACE)
    body = np.frombuffer(signed, np.uint8)
    cuts = segment.units(body, np.array([0, len(signed)]))
    lat = segment.Lattice(v, body, cuts)

    def ways(s):
        return [((), 1.0)] if lat.end[s] else [((e, *w), lat.q[e] * p) for e in range(lat.first[s], lat.first[s + 1]) for w, p in ways(lat.to[e])]

    chance = {a + b: p * q for a, p in ways(lat.start[0]) for b, q in ways(lat.start[1])}
    assert sum(chance.values()) == pytest.approx(1)
    n = 6000
    out, following = segment.sample(lat, np.tile([0, 1], n), np.arange(n + 1) * 2, mix(np.arange(n).astype(np.uint64)), 3)
    assert all(len({tuple(p.edges.tolist()) for p in ps}) == 3 and all(a.value > b.value for a, b in zip(ps, ps[1:], strict=False)) for ps in out)
    assert all(f < ps[2].value for f, ps in zip(following, out, strict=True))
    for rank, want in ((0, chance), (1, {w: sum(p * chance[w] / (1 - p) for x, p in chance.items() if x != w) for w in chance})):
        got = collections.Counter(tuple(ps[rank].edges.tolist()) for ps in out)
        assert all(abs(got[w] / n - p) < 0.03 for w, p in want.items())
    unbiased = np.mean([sum(np.exp(p.logp) / -np.expm1(-np.exp(p.logp - f)) for p in ps) for ps, f in zip(out, following, strict=True)])
    assert unbiased == pytest.approx(1, abs=0.02)


def test_segmentations_decode_and_repeat(spark, rows, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = segment.encode(docs, path, k=3)
    got = {r.doc_id: r.samples for r in encoded.collect()}
    assert all(s.decoded for x in got.values() for s in x)
    assert {(r.doc_id, r.text) for r in segment.decode(encoded, path).collect()} == {(i, t or "") for i, t in rows}
    packed = segment.encode(docs, path, k=3, ids="packed")
    assert {(r.doc_id, s.rank): np.frombuffer(s.ids, "<i4").tolist() for r in packed.collect() for s in r.samples} == {(i, s.rank): s.ids for i, x in got.items() for s in x}
    assert segment.decode(packed, path).where("text is null").count() == 0 and segment.decode(packed, path).count() == sum(map(len, got.values()))
    alone = segment.encode(docs.where("doc_id = 24").repartition(1), path, k=3).first().samples
    assert [s.ids for s in alone] == [s.ids for s in got[24]] and len({tuple(s.ids) for s in alone}) == len(alone)
    assert all(0 < s.inclusion <= 1 for s in alone) and segment.encode(empty, path).count() == 0
    few = segment.encode(spark.createDataFrame([(1, "\x01"), (None, None)], DOCS), path, k=5).collect()
    assert {len(r.samples) for r in few} <= {1, 2, 3, 4, 5}


def test_no_piece_spans_a_cut():
    v = segment.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["a    b" + " " * 20 + "c  ", "https://example.net/international/organization?information=administration", "数据处理与国际化组织的信息管理系统以及相关的技术标准和发展", "x" * 70_000, "the cat\n\nsat", "\x01" * 400]
    signed = [segment.SPACE + t.encode().replace(b" ", segment.SPACE) for t in texts]
    body, at = np.frombuffer(b"".join(signed), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in signed])])
    cuts = segment.units(body, at, v)
    usable = set(v.ids.tolist())
    raw, pieces, inside = body.tobytes(), {x for x in (v.out_bytes[a : a + n].tobytes() for i, (a, n) in enumerate(zip(v.out_start, v.out_size, strict=True)) if i in usable)}, set(at.tolist())
    for c in cuts.tolist():
        lo, hi = at[max(0, np.searchsorted(at, c, "right") - 1)], at[min(len(at) - 1, np.searchsorted(at, c, "right"))]
        assert c in inside or not any(raw[a:b] in pieces for a in range(max(lo, c - v.longest), c) for b in range(c + 1, min(hi, a + v.longest) + 1)), c
    assert {(segment.SPACE * n) in pieces for n in (2, 4, 8, 16)} == {True}
    lat = segment.Lattice(v, body, cuts)
    assert np.isfinite(lat.log_q[lat.q > 0]).all() and np.allclose(np.add.reduceat(lat.q, lat.first[:-1][np.diff(lat.first) > 0]), 1)
    ids = {i for i, n in zip(v.ids, v.out_size[v.ids], strict=True) if n > 3 and set(v.out_bytes[v.out_start[i] : v.out_start[i] + n].tobytes().decode("utf-8", "replace")) == {"▁"}}
    assert len(ids) > 10 and ids & set(lat.piece.tolist())


def test_coverage_below_the_threshold_is_by_tiles(spark):
    phrase, rest = "one two three four five six", " ".join(f"w{i}" for i in range(48))
    item = spark.createDataFrame([(7, f"{phrase} x {phrase} y {rest}")], "item_id long, text string")
    got = tiling.scores(spark.createDataFrame([(1, f"a b {phrase} c d")], DOCS), item).first()
    assert got.leaks == [] and got.item_id == 7 and got.coverage == pytest.approx(6 / 62)  # the phrase is there once


def test_units_cut_long_runs_at_characters():
    body = np.frombuffer("é".encode() * 100 + b"\nab", np.uint8)
    cuts = segment.units(body, np.array([0, body.size]))
    assert max(np.diff(cuts)) <= 33 and all(body[c] & 0xC0 != 0x80 for c in cuts[:-1])
    assert pa.array([1]).type == pa.int64()
