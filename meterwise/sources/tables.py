"""Series tables on Parquet: scans, idempotent upserts, append logs, write-once archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions.timekit import keep_last


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a session on one machine may do without: it gets one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterwise-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, path: str, schema: T.StructType, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of [start, end). Files are partitioned by year, so a range prunes them; a missing table is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(path)
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            at, year = F.lit(bound).cast("timestamp_ntz"), int(bound[:4])
            df = df.where((F.col("t") >= at) & (F.col("year") >= year) if low else (F.col("t") < at) & (F.col("year") <= year))
    return df.drop("year")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win as a whole, nulls included; columns are unioned. Of rows of one batch the largest counts, column by
    column in order of name, so the outcome is the same in every run."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, "_batch", *sorted(c for c, k in both.dtypes if c not in (*keys, "_batch") and "map<" not in k)).drop("_batch")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """Merge into a table partitioned by year; only the years that new rows fall in are rewritten.

    The merged years are staged beside the table, under a name of their own, before they replace it, since Spark can't
    overwrite what it reads. The first write keeps one row for each key too.
    """
    new = new.withColumn("year", F.year("t"))
    staged = f"{path}.{uuid.uuid4().hex}"
    if exists(spark, path):
        old = spark.read.parquet(path)
        years = new.select("year").distinct()  # a handful
        out = merged(old.join(F.broadcast(years), "year", "left_semi"), new, keys)
        out.write.parquet(staged)
        new = spark.read.parquet(staged)
    else:
        new = merged(new.limit(0), new, keys)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    remove(spark, staged)


def last_time(df: DataFrame) -> DataFrame:
    return df.agg(F.max("t").alias("t"))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows; files are partitioned by the month of t."""
    df.withColumn("month", F.date_format("t", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def replace_months(df: DataFrame, path: str) -> None:
    """Replace the months that are in df and no others."""
    df.withColumn("month", F.date_format("t", "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def standing(log: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row appended last for each key: files have no order, so the log carries one."""
    return keep_last(log, keys, *order)


def write_once(df: DataFrame, path: str, complete: bool = True) -> bool:
    """Archive unless it is there already or incomplete; whether it was written."""
    if not complete or exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns; absent ones are typed nulls."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def validated_forecast(df: DataFrame) -> DataFrame:
    """t, pred, actual of a frame with exactly one prediction column."""
    preds = [c for c in df.columns if c not in ("t", "actual")]
    if "actual" not in df.columns or len(preds) != 1:
        raise ValueError(f"need actual and one prediction column, got {df.columns}")
    return df.select("t", F.col(preds[0]).alias("pred"), "actual")


def changed_days(new: DataFrame, stored: DataFrame) -> DataFrame:
    """day, json of the days whose document differs from the stored hash."""
    hashed = new.withColumn("hash", F.sha2("json", 256))
    return hashed.join(stored.select("day", F.col("hash").alias("_h")), "day", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")
