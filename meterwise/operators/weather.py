"""Ensemble weather in long form (cell_lat, cell_lon, member, variable, valid_time, value, run_time) to hourly features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["cell_lat", "cell_lon"]


def in_cells(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], radians: bool = False) -> DataFrame:
    """Rows in a half-open box of degrees, with their one-degree cell."""
    a, b = (F.degrees(lat), F.degrees(lon)) if radians else (F.col(lat), F.col(lon))
    lo_lat, hi_lat, lo_lon, hi_lon = box
    return df.where((a >= lo_lat) & (a < hi_lat) & (b >= lo_lon) & (b < hi_lon)).withColumn("cell_lat", F.floor(a).cast("double")).withColumn("cell_lon", F.floor(b).cast("double"))


def cell_means(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*CELL, *keys).agg(F.avg(value).alias("value"))


def missing_variables(df: DataFrame, required: list[str]) -> DataFrame:
    """run_time, missing: what a run lacks."""
    have = df.groupBy("run_time").agg(F.collect_set("variable").alias("have"))
    return have.select("run_time", F.array_except(F.array(*map(F.lit, required)), "have").alias("missing"))


def wind_speed(df: DataFrame, u: str, v: str, name: str) -> DataFrame:
    """Speed for each member and cell from its components, before any mean: opposite winds don't cancel."""
    keys = ["run_time", "valid_time", *CELL, "member"]
    wide = df.where(F.col("variable").isin(u, v)).groupBy(*keys).pivot("variable", [u, v]).agg(F.avg("value"))
    return wide.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(*keys, F.lit(name).alias("variable"), F.hypot(u, v).alias("value"))


def deaccumulated(df: DataFrame, variable: str, step_seconds: int = 10_800, centre: str = "90 MINUTES") -> DataFrame:
    """A sum since the run's start to a mean rate of each step, not below zero, at the step's middle."""
    w = Window.partitionBy("run_time", *CELL, "member").orderBy("valid_time")
    x = df.where(F.col("variable") == variable).withColumn("_d", F.col("value") - F.lag("value").over(w)).where("_d is not null")
    return x.withColumn("value", F.greatest(F.lit(0.0), F.col("_d")) / step_seconds).withColumn("valid_time", F.col("valid_time") - F.expr(f"INTERVAL {centre}")).drop("_d")


def group_stats(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """run_time, valid_time, group, mean, q10, q90: mean over a group's cells in each member, then across members."""
    named = [F.when(mask, F.lit(name)) for name, mask in groups.items()]
    rows = df.withColumn("group", F.explode(F.array_compact(F.array(*named))))
    members = rows.groupBy("run_time", "valid_time", "group", "member").agg(F.avg("value").alias("v"))
    q = F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))
    out = members.groupBy("run_time", "valid_time", "group").agg(F.avg("v").alias("mean"), q.alias("_q"))
    return out.select("run_time", "valid_time", "group", "mean", F.col("_q")[0].alias("q10"), F.col("_q")[1].alias("q90"))


def by_vintage(df: DataFrame, keys: list[str], primary_hour: int = 0) -> DataFrame:
    """Of several runs for one day the primary one, else the latest before it."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.hour("run_time") == primary_hour, 0).otherwise(1), F.desc("run_time"))
    return df.withColumn("_n", F.dense_rank().over(w)).where("_n = 1").drop("_n")
