"""Tables that a run leaves behind: revisions with their retry queue, datasets, run artifacts, seeds of networks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.operators import outages
from meterwise.sources.store import Store
from meterwise.sources.tables import exists, remove, scratch


PENDING = "mrid string, month string"


def months_to_fetch(months: DataFrame, latest: DataFrame) -> DataFrame:
    """month: those without a stored state, and the last stored one, which may have been fetched before it ended."""
    stored = latest.select("month").distinct()
    last = stored.agg(F.max("month").alias("_last"))  # one row
    rows = months.join(stored.withColumn("_have", F.lit(True)), "month", "left").crossJoin(last)
    return rows.where(F.col("_have").isNull() | (F.col("month") == F.col("_last"))).select("month")


def backfill(spark: SparkSession, root: str, months: DataFrame, fetch_latest: Callable, fetch_revisions: Callable, renewable: list[str], since: str = "") -> dict[str, int]:
    """Fetch the latest state of each month's documents and all revisions of those that changed; what fails is retried.

    months: month (yyyy-MM). fetch_latest(months) gives rows of outage documents with their month; fetch_revisions(mrid,
    month) gives rows with `failed`, true for documents that could not be had. Tables of the store at root: latest (by month),
    revisions (each (mrid, revision, start) once, by month of the document's first state) and pending (the queue, which the
    next run asks for again). All three change in one commit, so a run that stops anywhere is as one that never began. Known
    documents are not asked for twice, months that didn't change and revisions once stored aren't written again; months before
    `since` keep their latest state alone.
    """
    store = Store(spark, root)
    schema = fetch_latest(months.limit(0)).schema
    pending, stored = store.read("pending", PENDING), store.read("latest", schema)
    landed = scratch(spark)
    fetch_latest(months_to_fetch(months, stored)).write.parquet(landed)  # asked for once, whatever is recomputed later
    fresh = spark.read.schema(schema).parquet(landed)
    changed = fresh.where(F.col("month") >= since)
    candidates = outages.candidates(changed, renewable, F.min("month").alias("month")).select("mrid", "month")
    got_schema = fetch_revisions(pending.limit(0)).schema
    revision = T.StructType([f for f in got_schema if f.name not in ("failed", "month")] + [T.StructField("month", T.StringType())])
    known = store.read("revisions", revision)
    asked = candidates.join(known.select("mrid").unionByName(pending.select("mrid")).distinct(), "mrid", "left_anti")
    wanted, fetched = scratch(spark), scratch(spark)
    pending.unionByName(asked).write.parquet(wanted)  # read five times
    asked = spark.read.schema(PENDING).parquet(wanted)
    fetch_revisions(asked).write.parquet(fetched)
    got = spark.read.schema(got_schema).parquet(fetched)
    failed = got.where("failed").select("mrid").distinct()
    queue = asked.join(failed, "mrid").select("mrid", "month")
    rows = got.where("not failed").drop("failed", "month").dropDuplicates(["mrid", "revision", "start"]).join(asked, "mrid", "left")
    # a document in the queue may have revisions that came through before
    key = ["mrid", "revision", "start"]
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    rows = rows.alias("n").join(known.select(*key).alias("k"), same, "left_anti")
    counts = {"asked": asked.count(), "failed": queue.count()}
    with store.commit() as batch:
        batch.replace("latest", fresh, "month")
        batch.append("revisions", rows.select(*revision.names), "month")
        batch.replace("pending", queue)
    store.sweep()
    for path in (landed, wanted, fetched):
        remove(spark, path)
    return counts


def write_dataset(features: DataFrame, summary: DataFrame, path: str) -> None:
    """The feature table and, beside it, its summary as one JSON row with the columns' names and the complete rows."""
    features.write.mode("overwrite").parquet(path)
    stored = features.sparkSession.read.parquet(path)
    whole = stored.dropna().agg(F.count("*").alias("complete_rows"))
    side = summary.crossJoin(whole).withColumn("columns", F.array(*[F.lit(c) for c in stored.columns]))  # one row by one row
    side.coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def write_run(root: str, name: str, params: dict, metrics: DataFrame, stamp: str) -> str:
    """A run's folder: config and metrics as JSON; never an old run's."""
    spark, path = metrics.sparkSession, f"{root}/{name}-{stamp}"
    if exists(spark, path):
        raise FileExistsError(path)
    spark.createDataFrame([(json.dumps({"experiment": name, **params}, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/config")
    metrics.coalesce(1).write.json(f"{path}/metrics")
    return path


def write_seed_levels(levels: DataFrame, path: str) -> None:
    """Each member's own levels: head, seed, t, q as floats, by head and seed."""
    levels.select("head", "seed", "t", F.col("q").cast("array<float>").alias("q")).write.mode("overwrite").partitionBy("head", "seed").parquet(path)
