"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import bottomk, dac, feistel, interpolate, jaccard, langid, merkle, resample, segment, suffix_dedup, tiling, toxicity, urlrules
from meterwise.sources.tables import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """crc32 of a column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    rows = toxicity.score(docs, *toxicity.fit(docs, labels))
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segment.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=3, ids="packed")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.predict(docs, *langid.fit(docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True)))))
    return rows.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark)
    dac.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return dac.read(spark.read.parquet(folder))


def op6_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feistel.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottomk.fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", bottomk.as_string(F.col("sketch")).alias("fingerprint"),
        bottomk.as_string(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
        "n_shingles", "edited_n_shingles", "in_edited", "in_next",
    )


def op8_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urlrules.judge(table(spark, sf_dir, "pages"), urlrules.demo_rules(spark))
    # the rules' paths start with the slash that parts host and path
    return rows


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = remainder("doc_id", 7)
    fold = F.when(left == 2, interpolate.HELD_OUT).when(left == 3, interpolate.DELETED).otherwise(interpolate.TRAIN)
    rows = interpolate.score(docs, fold, interpolate.learn(docs, fold))
    return rows.select("doc_id", (F.col("fold") == interpolate.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_gumbel, op3_suffix, op4_langid, op5_dac, op6_feistel, op7_bottomk, op8_urlrules, op9_jaccard, op10_tiling, op11_resample, op12_interpolate, op13_merkle,
)}

#: The 256 entries of CRC-32's table, as a list t, by its rule.
CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM (SELECT unnest(range(0, 256)) AS i))"""


def crc32_sql(hexed: str) -> str:
    """The unsigned CRC-32 of bytes given in hex, in SQL that has the table t at hand."""
    steps = f"list_transform(range(0, len({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT)"


SQL = {
    "op3_suffix": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM d)),
        f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
        c AS (SELECT g.doc_id, g.p FROM g JOIN f ON f.s = g.s WHERE f.m < g.doc_id),
        b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c),
        i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
        r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
        q AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a, z FROM r),
        t AS (SELECT q.doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * x + 1, 2 * (a - x)), '' ORDER BY x) AS kept FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
        SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op9_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b, i = na AND i = nb AS same FROM p WHERE 18 * i >= 8 * (na + nb)),
        r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d),
        c AS (SELECT d AS doc_id, min(c) AS class_id FROM r GROUP BY d),
        k AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (WHERE same) AS copy FROM l GROUP BY a)
        SELECT c.doc_id, coalesce(least(c.doc_id, k.copy), c.doc_id) AS set_id, c.class_id, coalesce(k.n_links, 0) AS n_links FROM c LEFT JOIN k ON k.doc_id = c.doc_id""",
    "op8_urlrules": r"""
        WITH parsed AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        rules(rank, rhost, rpath, verdict) AS (
            VALUES (1, 'example.net', '/en/', 'allow'), (2, 'example.com', '/de/', 'block'), (3, 'net', '/', 'block'), (4, 'org', '/fr/', 'allow'))
        SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, -rank) AS rule, coalesce(max_by(verdict, -rank), 'allow') AS verdict
        FROM parsed p LEFT JOIN rules r
          ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
        GROUP BY p.page_id, p.host, p.path""",
    "op11_resample": rf"""
        WITH crc AS ({CRC_TABLE}),
        w AS MATERIALIZED (
            SELECT k, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT 0 AS k, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark)),
        e AS (SELECT k, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
        n AS (SELECT k, id, g, count(*) AS n FROM e GROUP BY ALL),
        h AS (SELECT g, {crc32_sql("h")} % 10000 AS b FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n)), crc),
        s AS (SELECT b, CAST(sum(n) FILTER (WHERE k = 0) AS BIGINT) AS s, CAST(sum(n) FILTER (WHERE k = 1) AS BIGINT) AS t FROM n JOIN h ON h.g = n.g GROUP BY b),
        z AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE k = 0), 0) + 10000 AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE k = 1), 0) + 10000 AS DOUBLE) AS t FROM n),
        gain AS (SELECT b, floor(1000 * ln((coalesce(s.t, 0) + 1) * z.s / ((coalesce(s.s, 0) + 1) * z.t)))::BIGINT AS gain FROM s, z),
        v AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM n JOIN h ON h.g = n.g JOIN gain ON gain.b = h.b WHERE k = 0 GROUP BY id),
        d AS (
            SELECT w.doc_id, len(w.w) AS words, coalesce(v.n, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM w LEFT JOIN v ON v.id = w.id WHERE w.k = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS r, count(*) OVER (PARTITION BY words >= 20) AS m FROM d)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * m // 100 THEN r END AS rank FROM r""",
    "op13_merkle": rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        f AS (SELECT doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS c, text, hex(encode(CAST(doc_id AS VARCHAR))) AS h FROM documents),
        l AS (
            SELECT f.*, list_transform(c, lambda x: coalesce(octet_length(encode(x)) || ':' || x, '-')) AS s,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS own,
                   CASE WHEN {crc32_sql("h")} % 3 = 0 THEN octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS changed
            FROM f, crc),
        leaf AS (SELECT doc_id, lang, sha256(array_to_string(s, '') || own) AS leaf, sha256(array_to_string(s, '') || coalesce(changed, own)) AS given FROM l),
        r AS (SELECT leaf.*, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
        -- nodes of each language, level by level, n the number on the level
        node AS (
            SELECT lang, 0 AS lvl, i, n, leaf AS h FROM r
            UNION ALL
            SELECT lang, lvl + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, lvl, i // 8),
        sub AS (SELECT lang, h AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM node WHERE n = 1),
        high AS (
            SELECT 0 AS lvl, j AS i, m AS n, subroot AS h FROM sub
            UNION ALL
            SELECT lvl + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 8),
        step AS (
            SELECT a.lang, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS y
            FROM node a JOIN node b ON a.lang IS NOT DISTINCT FROM b.lang AND a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lang, a.lvl, a.i),
        above AS (
            SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS x, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS y
            FROM high a JOIN high b ON a.lvl = b.lvl AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.lvl, a.i),
        fold AS (
            SELECT r.lang, r.i AS id, 0 AS k, r.i AS at, r.given AS h, '' AS proof, depth, j FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang
            UNION ALL
            SELECT f.lang, f.id, f.k + 1, CASE WHEN f.k + 1 = f.depth THEN f.j ELSE f.at // 8 END, sha256(coalesce(s.x, v.x) || f.h || coalesce(s.y, v.y)), f.proof || coalesce(s.x, v.x) || coalesce(s.y, v.y), f.depth, f.j
            FROM fold f LEFT JOIN step s ON f.k < f.depth AND s.lang IS NOT DISTINCT FROM f.lang AND s.lvl = f.k AND s.i = f.at
                        LEFT JOIN above v ON f.k >= f.depth AND v.lvl = f.k - f.depth AND v.i = CASE WHEN f.k = f.depth THEN f.j ELSE f.at END
            WHERE s.i IS NOT NULL OR v.i IS NOT NULL),
        done AS (SELECT lang, id, max_by(h, k) AS folded_root, max_by(proof, k) AS proof FROM fold GROUP BY lang, id),
        top AS (SELECT h AS root FROM high WHERE n = 1)
        SELECT r.doc_id, r.leaf, sub.subroot, top.root, sha256(done.proof) AS proof_sha256, done.folded_root, done.folded_root = top.root AS verified
        FROM r JOIN sub ON sub.lang IS NOT DISTINCT FROM r.lang JOIN done ON done.lang IS NOT DISTINCT FROM r.lang AND done.id = r.i CROSS JOIN top""",
}
