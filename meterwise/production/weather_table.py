"""A table of weather features that converges to its best vintage over many runs.

Each delivery day's rows come from one run: the primary one, at `primary_hour` of the day before, or the fallback, at
`fallback_hour` of the day before that. A day that is not stored yet takes the best run on offer; a stored day yields only to a
better one, so a repeated or a late fallback changes nothing. Only the days that change are written, in one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.sources.store import Store

PRIMARY, FALLBACK = 2, 1


def rank(day: Column, run_time: Column, primary_hour: int = 0, fallback_hour: int = 12) -> Column:
    """2 for the primary run of a delivery day, 1 for its fallback, null for any other run."""
    at = lambda back, hour: F.date_sub(day, back).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(hour))
    return F.when(run_time == at(1, primary_hour), PRIMARY).when(run_time == at(2, fallback_hour), FALLBACK)


def offered(runs: DataFrame, allow_fallback: bool, through: str | None = None, **hours: int) -> DataFrame:
    """day, vintage and the rows (run_time, t, ...) of each delivery day's best run; a row that repeats counts once."""
    x = runs.withColumn("day", F.to_date("t")).withColumn("vintage", rank(F.col("day"), F.col("run_time"), **hours))
    x = x.where(F.col("vintage") >= (FALLBACK if allow_fallback else PRIMARY))
    if through is not None:
        x = x.where(F.col("day") <= F.lit(through).cast("date"))
    best = F.max("vintage").over(Window.partitionBy("day"))
    return x.withColumn("_best", best).where(F.col("vintage") == F.col("_best")).drop("_best").dropDuplicates(["t"])


def update(store: Store, runs: DataFrame, allow_fallback: bool = False, through: str | None = None, table: str = "weather", **hours: int) -> list[str]:
    """Merge runs (run_time, t, features) into the store's table; the days that were written."""
    new = offered(runs, allow_fallback, through, **hours)
    stored = store.read(table, new.schema).groupBy("day").agg(F.max("vintage").alias("_have"))
    better = new.select("day", "vintage").distinct().join(stored, "day", "left").where(F.col("_have").isNull() | (F.col("vintage") > F.col("_have")))
    with store.commit() as batch:
        return batch.replace(table, new.join(better.select("day"), "day", "left_semi").select(*new.columns), "day")


def read(store: Store, like: DataFrame, table: str = "weather") -> DataFrame:
    """The table, with the columns of `like` (runs) and each row's day and vintage."""
    return store.read(table, offered(like, True).schema)


def gaps(store: Store, like: DataFrame, days: DataFrame, table: str = "weather") -> DataFrame:
    """day, vintage of the days (day) that have no row, or only the fallback's."""
    have = read(store, like, table).groupBy("day").agg(F.max("vintage").alias("vintage"))
    return days.select("day").distinct().join(have, "day", "left").where(F.col("vintage").isNull() | (F.col("vintage") < PRIMARY))
