"""Streams over landed files: hourly means with a watermark, and keep-last upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.sources.tables import upsert


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_means(events: DataFrame, keys: list[str], value: str, t: str = "ts", late: str = "2 hours") -> DataFrame:
    """keys, t, n, v of each tumbling hour. Watermarks need an instant, so t is cast from wall clock."""
    rows = events.withColumn("_t", F.col(t).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", "1 hour"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("v"))
    return out.select(*keys, F.col("window.start").alias("t"), "n", "v")


def start_upserts(stream: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "append"):
    """Each micro-batch's rows replace older ones of the same key in the table.

    In update mode a batch holds the windows that it has changed, so only their years are written again; the state keeps the
    windows that the watermark has not passed, and rows that come later than it allows are left out.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(lambda df, _: upsert(df.sparkSession, path, df, keys)).trigger(availableNow=True).start()
