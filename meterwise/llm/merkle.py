"""Merkle manifest of a table of documents: leaves, subroots of languages, one root, and a proof for each document.

H is the lowercase hex SHA-256 of its inputs, one after the other; digests are inputs as hex text. A leaf is H of doc_id,
source, lang, n_chars and text, each `-` if null, else its UTF-8 byte count, a colon and the value. The leaves of a language
ascend by doc_id; while there is more than one node, each run of eight becomes its H. Subroots, by language, likewise.

The tree is a rollup. A node's rank in its group has octal digits; within a block of 512 nodes the lowest digit is grouped
away first, then the next, then the last, and each grouping nests the structs of the one before. One exchange by (group,
block) serves all three. The blocks' digests are the nodes of the next rollup, so no row ever holds more than a block, and the
number of rollups is the logarithm of the row count to the base of 512. The way down unfolds the nested structs digit by digit
(transform and explode); a block meets the path above it in a window over their union, so no proof is made by a join.

Nulls: a null doc_id or lang sorts first. Rows of one doc_id ascend by leaf, so repeated rows have leaves, ranks and proofs of
their own and the root doesn't depend on the order of rows. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import cut, partitions

ARITY = 8
DIGITS = 3
BLOCK = ARITY**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def leaf(**changed: Column) -> Column:
    """The leaf of a row of documents, some of whose fields are taken as changed."""
    value = lambda c: changed.get(c, F.col(c)).cast("string")
    return digest(*[F.when(value(c).isNull(), "-").otherwise(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c))) for c in FIELDS])


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """rank (from 0, by `order`) and total of each row within its group `grp`.

    Rows are sorted in ranges, so a large group is dealt over many; a range's rows of a group start where the counts of the
    ranges before end.
    """
    part = F.shiftright("_id", 33)
    runs = cut(df.repartitionByRange(partitions(df.sparkSession), "grp", *order).sortWithinPartitions("grp", *order).withColumn("_id", F.monotonically_increasing_id()))
    runs = runs.withColumn("_part", part)
    counts = runs.groupBy(F.col("grp").alias("_g"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_g")
    before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select("_g", "_p", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total"))
    rows = runs.join(counts, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return rows.select(*df.columns, (F.col("_id") + F.col("_shift")).alias("rank"), "total")


def rollup(nodes: DataFrame) -> DataFrame:
    """Blocks (grp, block, total, hash, children) of nodes (grp, rank, total, hash, item).

    total counts the nodes of the group; a digit above the group's last level passes its only child on as it stands.
    """
    digit = [F.floor(F.col("rank") / ARITY**i).cast("long") % ARITY for i in range(DIGITS)]
    rows = nodes.select("grp", "total", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"), "hash", F.col("item").alias("child"), *[d.cast("int").alias(f"d{i}") for i, d in enumerate(digit)])
    rows = rows.repartition(partitions(nodes.sparkSession), "grp", "block")
    for i in range(DIGITS):
        keys = ["grp", "block", "total", *[f"d{j}" for j in range(i + 1, DIGITS)]]
        rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "hash", "child"))).alias("child"))
        rows = rows.withColumn("hash", F.when(F.col("total") > ARITY**i, F.sha2(joined(F.col("child.hash")), 256)).otherwise(F.element_at("child.hash", 1)))
    return rows.withColumnRenamed("child", "children")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the nodes up to one block for each group."""
    tables = []
    while True:
        tables.append(cut(rollup(nodes)))
        most = tables[-1].agg(F.max("total")).first()[0]
        if most is None or most <= BLOCK:
            return tables
        nodes = tables[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), "hash", F.lit(0).alias("item"))


def _step(hashes: Column, k: Column) -> Column:
    """What stands to the left and to the right of the k-th of a run."""
    return F.struct(joined(F.slice(hashes, F.lit(1), k)).alias("left"), joined(F.slice(hashes, k + 2, F.lit(ARITY))).alias("right"))


def unfold(blocks: DataFrame, above: list[str]) -> DataFrame:
    """A row for each node of blocks that have their path: grp, rank, item, its leaf-to-root path, and the columns `above`."""
    rows = blocks.withColumn("rank", F.col("block")).withColumnRenamed("children", "child")
    for i in reversed(range(DIGITS)):
        rows = rows.withColumn("hashes", F.col("child.hash"))
        kids = F.transform("child", lambda c, k: F.struct(c["digit"].alias("digit"), c["child"].alias("child"), _step(F.col("hashes"), k).alias("step")))
        rows = rows.withColumn("kid", F.explode(kids))
        path = F.when(F.col("total") > ARITY**i, F.concat(F.array("kid.step"), F.col("path"))).otherwise(F.col("path"))
        rows = rows.select("grp", "total", *above, (F.col("rank") * ARITY + F.col("kid.digit")).alias("rank"), path.alias("path"), F.col("kid.child").alias("child"))
    return rows.withColumnRenamed("child", "item")


def with_paths(blocks: DataFrame, paths: DataFrame, above: list[str]) -> DataFrame:
    """Blocks with the path (and the columns `above`) of their key: one window over both tables."""
    key = Window.partitionBy("grp", "block")
    blocks = blocks.drop(*above, "path")
    both = blocks.unionByName(paths.select("grp", "block", "path", *above), allowMissingColumns=True)
    for c in ("path", *above):
        both = both.withColumn(c, F.first(c, ignorenulls=True).over(key))
    return both.where(F.col("children").isNotNull())


def descend(tables: list[DataFrame], paths: DataFrame, above: list[str]) -> DataFrame:
    """Nodes of the lowest table with their paths, given those of the highest table's blocks."""
    for i, blocks in enumerate(reversed(tables)):
        rows = unfold(with_paths(blocks, paths, above), above)
        if i < len(tables) - 1:
            paths = rows.select("grp", F.col("rank").alias("block"), "path", *above)
    return rows


NO_PATH = "array<struct<left:string,right:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, path (left and right siblings of each level, up to the root), changed_leaf.

    changed_leaf is the leaf after the tampering that a manifest must find: a third of the rows, by their id, have the
    letters A-Z of their text lower-cased; null elsewhere.
    """
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(text=F.translate("text", UPPER, UPPER.lower())))
    leaves = cut(docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), tampered.alias("changed")))
    nodes = ranked(leaves, "doc_id", "hash").select("grp", "rank", "total", "hash", F.struct("doc_id", F.col("hash").alias("leaf"), "changed").alias("item"))
    by_lang = climb(nodes)
    subroots = by_lang[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "hash")
    top = climb(ranked(subroots, "lang").select("grp", "rank", "total", "hash", F.struct("lang", F.col("hash").alias("subroot")).alias("item")))
    start = top[-1].select("grp", "block", F.array().cast(NO_PATH).alias("path"), F.col("hash").alias("root"))
    langs = descend(top, start, ["root"])
    paths = langs.select(F.col("item.lang").alias("grp"), F.lit(0).cast("long").alias("block"), "path", "root", F.col("item.subroot").alias("subroot"))
    rows = descend(by_lang, paths, ["root", "subroot"])
    return rows.select("item.doc_id", "item.leaf", "subroot", "root", "path", F.col("item.changed").alias("changed_leaf"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proofs(docs: DataFrame) -> DataFrame:
    """The manifest with proof_sha256 (H of all siblings, in order), folded_root and verified."""
    rows = manifest(docs)
    siblings = joined(F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    rows = rows.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

