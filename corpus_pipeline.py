"""A corpus pipeline of five stages over documents; each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns the
token ids. run() writes each stage's result as Parquet in the shared checkpoint folder and reads it again.

Columns beyond those of documents, also under names that an operator uses inside, are left out by the first stage that
meets them. A null text is an empty one and stays, as it is no copy, repeat or leak. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import jaccard, segment, suffix_dedup, tiling, toxicity
from meterwise.llm.queries import table
from meterwise.sources.tables import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; each row is judged by its text, so repeated rows and null ids go or stay alike."""
    docs = docs.select(*COLUMNS)
    return toxicity.clean(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays.

    Rows of one doc_id go or stay together, judged by one of their texts; rows with a null doc_id stay.
    """
    classes = jaccard.join(docs)
    return docs.select(*COLUMNS).join(classes.where("class_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a document repeats from one with a smaller id go; n_chars follows.

    Rows of one doc_id don't cover each other; rows with a null doc_id stay as they are. A text that is all repeats stays
    as an empty one.
    """
    rows = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.char_length("kept_text").cast("long").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go; each row is judged by its text, so repeated rows and null ids go or stay alike."""
    return tiling.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of each document, with packed ids and inclusion scores; a row for each row."""
    return segment.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), k=3, ids="packed", run_bytes=1 << 17)


STAGES = [("toxicity", toxic), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("benchmark decontamination", leaks), ("SentencePiece encoding", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = scratch(spark)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
