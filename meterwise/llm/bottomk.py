"""Document fingerprints: bottom-k sketches of five-word shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest distinct shingle hashes (44 bits each). Sketches of parts merge by
union; the k smallest of the union are the sketch of the whole. From sketches follow resemblance (Jaccard),
containment and the number of distinct shingles; all three are exact while a text has at most k shingles.

Words are split at white space. A text of one to four words has one shingle, the text's words; an empty text (or null)
has none. Two empty sketches are alike (1.0), an empty and a filled one are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import bounds_below
from meterwise.llm.common import documents, partitions

WORDS = 5
K = 256
SPACE = 1 << 44


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = WORDS) -> DataFrame:
    """df with the sketch of a text column; each word is hashed once, a shingle from its words' hashes in order."""
    blank = "\t\n\x0b\f\r "
    one = lambda x: F.shiftrightunsigned(F.xxhash64(x), 20)
    df = df.withColumn("_t", F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(blank)))
    df = df.withColumn("_h", F.when(F.col("_t") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("_t", f"[{blank}]+"), lambda x: F.xxhash64(x))))
    n = F.size("_h")
    shingles = F.when(n < size, F.transform(F.sequence(F.lit(1), F.least(n, F.lit(1))), lambda i: one(F.col("_h")))).otherwise(
        F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: one(F.slice("_h", i, size)))
    )
    shingles = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(shingles)
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_t", "_h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(a: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a share of its range."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) * SPACE / F.element_at(a, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest hashes of the union that are in both."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def containment(a: Column, b: Column, k: int = K, j: Column | None = None) -> Column:
    """The share of a's shingles that are in b; j is their resemblance, if it is at hand."""
    j = resemblance(a, b, k) if j is None else j
    shared = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_string(a: Column) -> Column:
    return F.array_join(a.cast("array<string>"), ",")


def ranges_with_next(docs: DataFrame, per_partition: int = 2) -> tuple[DataFrame, Column]:
    """Rows dealt by ranges of doc_id, and the order of rows inside a range (`_rng`).

    The order is by doc_id (null first), then text. The rows that begin a range also go, marked `_guest`, to the range
    before, as the neighbours of its last row; the first rows of all go to the last range. So one shuffle of the texts
    is enough for every row to see its neighbour. Only the ranges' bounds reach the driver.
    """
    rows = documents(docs)
    n = partitions(docs.sparkSession)
    m = n * per_partition
    got = rows.agg(F.percentile_approx("doc_id", [i / m for i in range(m)], 100 * m), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    first = None if got[2] else got[1]
    cuts = sorted(c for c in set(got[0] or []) if first is None or c > first)
    rng = bounds_below(cuts, F.col("doc_id"), "bigint", equal=True)
    before = F.when(rng > bounds_below(cuts, F.col("doc_id"), "bigint"), rng - 1)  # it is one of the cuts
    last = F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.lit(len(cuts)))
    places = F.array_compact(F.array(F.struct(rng.alias("r"), F.lit(0).alias("g")), F.when(before.isNotNull(), F.struct(before.alias("r"), F.lit(1).alias("g"))), F.when(last.isNotNull(), F.struct(last.alias("r"), F.lit(2).alias("g")))))
    dealt = rows.withColumn("_p", F.explode(places)).select("doc_id", "text", F.col("_p.r").alias("_rng"), F.col("_p.g").alias("_guest"))
    order = Window.partitionBy("_rng").orderBy(F.col("_guest") == 2, F.col("doc_id").asc_nulls_first(), "text", "_guest")
    return dealt.repartition(n, "_rng"), order


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """For each document its sketch, the sketch of its edited text, resemblance to that and to the next document, the share of
    its shingles that each holds, and the numbers of distinct shingles.

    The edited text: the last floor(n/4) code points give way to the first as many (or all) of the next document.
    """
    rows, order = ranges_with_next(docs)
    rows = with_sketch(rows, "text", "sketch", k)
    rows = rows.select("*", F.lead("text").over(order).alias("_next"), F.lead("sketch").over(order).alias("_next_sketch")).where(F.col("_guest") == 0)
    n = F.char_length("text")
    m = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("_next"), F.lit(1), m)))
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    # named once: whatever needs them reads the column
    rows = rows.withColumns({"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k), "near_next": resemblance(F.col("sketch"), F.col("_next_sketch"), k)})
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch", "near_edited", "near_next",
        distinct_count(F.col("sketch"), k).alias("n_shingles"), distinct_count(F.col("edited_sketch"), k).alias("edited_n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k, F.col("near_edited")).alias("in_edited"),
        containment(F.col("sketch"), F.col("_next_sketch"), k, F.col("near_next")).alias("in_next"),
    )
