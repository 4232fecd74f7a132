"""Rows that ask for care: clashing names, null and repeated ids, repeated rows, long texts; and the queries' held-out results."""

import collections
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("meterwise.llm")

from meterwise.llm import bottomk, dac, feistel, jaccard, langid, queries, segment, suffix_dedup, tiling, toxicity, urlrules  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the old man and his dog went over a long road to see what was left of their small red house by the sea".split()
# names that the operators use inside, of types that would not do there
CLASH = "key string, n int, row_no string, sha int, text_key int, hits string, score string, signature int, part string, seq string, first int, kind string, rng string, root string, carried int, _place string, leaks int"
EXTRA = ("k", 1, "r", 2, 3, "h", "s", 4, "p", "q", 5, "k", "g", "o", 6, "l", 7)


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(5)
    out = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(30)]
    long = " ".join(rng.choice(WORDS) for _ in range(60_000)) + " " + "数据处理" * 150_000 + " iiddiioott"
    out += [(40, None), (41, ""), (42, "  \n"), (43, "ß" * 300), (44, long), (45, out[3][1])]
    # a null id twice, one id with two texts, and a repeated row
    return [*out, (None, out[4][1]), (None, "another text of no id"), (7, "a second text of seven"), out[2], out[2]]


@pytest.fixture(scope="module")
def docs(spark, plain):
    return spark.createDataFrame([(*r, *EXTRA) for r in plain], f"doc_id long, text string, {CLASH}").repartition(3)


def counted(rows):
    return collections.Counter(rows)


def ids_of(plain):
    return counted(i for i, _ in plain)


def test_long_text_is_over_a_megabyte(plain):
    assert max(len((t or "").encode()) for _, t in plain) > 2_000_000


def test_toxicity_gives_a_row_for_each_row(spark, docs, plain):
    labels = spark.createDataFrame([(i, int(i % 2), "x") for i in range(30)] + [(7, 1, "y"), (None, 1, "z")], "doc_id long, toxic int, score string")
    model, classifier = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, classifier).select("doc_id", "score", "predicted").collect()
    assert counted(r.doc_id for r in got) == ids_of(plain) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1 and len({r.score for r in got if r.doc_id in (3, 45)}) == 1
    assert toxicity.clean(docs, model, classifier).columns == docs.columns


def test_language_id_gives_a_row_for_each_row(spark, docs, plain):
    learn = spark.createDataFrame([(i, t, "en" if i % 2 else "zh", "x") for i, t in [(k, "数据 处理" if k % 2 == 0 else "the old man") for k in range(40)]] + [(1, None, "en", "x"), (1, "the sea", None, "x")], "doc_id long, text string, lang string, key string")
    names, idf, model = langid.fit(learn)
    assert set(names) == {"en", "zh"}
    got = langid.predict(docs, names, idf, model).collect()
    assert counted(r.doc_id for r in got) == ids_of(plain) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (40, 41, 42)} == {"und"} and len({(r.lang_pred, r.score) for r in got if r.doc_id == 2}) == 1


def test_segmentation_gives_back_each_text(docs, plain):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = segment.encode(docs, path, k=2)
    assert counted(r.doc_id for r in encoded.select("doc_id").collect()) == ids_of(plain)
    assert {(r.doc_id, r.text) for r in segment.decode(encoded, path).collect()} == {(i, t or "") for i, t in plain}


def test_codes_of_each_row(spark, docs, plain, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    dac.write(docs, str(tmp_path / "codes"), path)
    got = dac.read(spark.read.parquet(str(tmp_path / "codes"))).collect()
    encode = Tokenizer.from_file(str(path)).encode
    want = [(i, np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in plain]
    assert counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == counted((i, x.size, zlib.crc32(x.tobytes())) for i, x in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered[:-1]]]).tolist()
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in plain), key=lambda i: (i is not None, i or 0))


def test_shards_hold_each_row_once(docs, plain):
    got = feistel.shard(docs, 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted((i, size(t), zlib.crc32((t or "").encode())) for i, t in plain)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_fingerprints_of_equal_texts_are_equal(docs, plain):
    got = bottomk.fingerprints(docs).select("doc_id", "n_chars", bottomk.as_string(F.col("sketch")).alias("f")).collect()
    assert counted((r.doc_id, r.n_chars) for r in got) == counted((i, len(t or "")) for i, t in plain)
    assert len({r.f for r in got if r.doc_id in (3, 45)}) == 1 and len({r.f for r in got if r.doc_id in (40, 41)}) == 1


def test_url_rules_take_null_and_repeated_pages_and_equal_rules(spark):
    urls = ["http://example.net/en/a", None, "http://x.example.net/", "http://example.net/en/a"]
    pages = spark.createDataFrame([(i, u, *EXTRA) for i, u in [*enumerate(urls), (None, urls[0]), (0, urls[0])]], f"page_id long, url string, {CLASH}")
    # two verdicts for one rule: the one that sorts first
    rules = spark.createDataFrame([("example.net", "/en/", "block", 1), ("example.net", "/en/", "allow", 2), (None, "/", "block", 3), ("net", None, "block", 4)], "host string, path string, verdict string, key int")
    got = counted((r.page_id, r.rule, r.verdict) for r in urlrules.judge(pages, rules, default="block").collect())
    hit = ("example.net/en/", "allow")
    assert got == {(0, *hit): 2, (3, *hit): 1, (None, *hit): 1, (1, None, "block"): 1, (2, None, "block"): 1}


def test_jaccard_classes_of_ids(docs, plain):
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    assert set(got) == {i for i, _ in plain if i is not None}
    assert got[45].class_id == got[3].class_id == 3 and got[45].n_links >= 1 and got[44].n_links == 0


def test_suffix_dedup_keeps_a_row_for_each_row(docs, plain):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert counted((r.doc_id, r.n_bytes) for r in got) == counted((i, len((t or "").encode())) for i, t in plain)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_tiling_gives_a_row_for_each_row(spark, docs, plain):
    items = spark.createDataFrame([(1, plain[4][1], "x"), (2, None, "x"), (3, "", "x"), (4, plain[4][1], "x"), (None, plain[5][1], "x")], "item_id long, text string, text_key string")
    got = tiling.scores(docs, items).collect()
    assert counted(r.doc_id for r in got) == ids_of(plain)
    same = [r for r in got if r.doc_id == 4 or (r.doc_id is None and r.leaks)]
    assert len(plain[4][1].split()) >= 5 and len(same) == 2
    assert all({1, 4} <= set(r.leaks) and r.coverage == 1.0 and r.item_id == 1 for r in same)
    assert tiling.without_leaks(docs, items).columns == docs.columns


@pytest.fixture(scope="module")
def larger(sf):
    path = sf.replace("sf0.001", "sf0.01")
    return path if os.path.isdir(path) else sf


def held(spark, sf, name, modulus, remainder):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert set(rows) == {r.doc_id for r in queries.table(spark, sf, "documents").select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) for i, r in rows.items())
    return {i: r for i, r in rows.items() if r.held_out}


def test_op1_on_held_out_documents(spark, larger):
    rows = held(spark, larger, "op1_toxicity", 5, 0)
    truth = {r.doc_id: r.toxic for r in queries.table(spark, larger, "labels").collect() if r.doc_id in rows}
    bad, good = ([rows[i].score for i, y in truth.items() if y == v] for v in (1, 0))
    assert bad and good and np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.95


def test_op4_on_held_out_documents(spark, larger):
    rows = held(spark, larger, "op4_langid", 3, 1)
    truth = {r.doc_id: r.lang for r in queries.table(spark, larger, "documents").select("doc_id", "lang").collect() if r.lang and r.doc_id in rows}
    assert np.mean([rows[i].lang_pred == y for i, y in truth.items()]) > 0.97
