"""A missing total rebuilt from the areas that did report, by their share over trailing days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import running_sum

# Bounds of a believable share, and the MW below which an hour counts as night.
SHARE_FLOOR, SHARE_CEIL, NIGHT_MW = 0.02, 1.5, 1.0


def share(part: Column, whole: Column) -> Column:
    """The part of a total that some areas reported, of sums over the same rows; null where the total adds up to nothing."""
    return F.when(whole > 0, part / whole)


def fill_total(df: DataFrame, total: str, areas: list[str], steps: int = 24, window_days: int = 28, min_days: int = 14, min_share: float = 0.0, per_hour: bool = True) -> DataFrame:
    """df (dense t) with `filled` and `rule` beside the total.

    A row is a candidate if the total is missing, some area reports, and at least a day of totals follows (a hole, not
    a tail). Its reporting set's share of the total is measured over the `window_days` days before, on days on which
    the total and the whole set are there at every step; fewer than `min_days` such days, a pooled share below
    `min_share` or a share out of bounds leave the hole. An hour that was about zero throughout is filled with 0.
    """
    # totals after a row: all of them less those up to it, counted by months with offsets
    df = running_sum(df.withColumn("_k", F.col(total).isNotNull().cast("long")), "_k", "_upto")
    df = df.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum("_k"), F.lit(0)).alias("_all"))))  # one row
    df = df.withColumn("_after", F.col("_all") - F.col("_upto")).drop("_k", "_upto", "_all").withColumn("_day", F.to_date("t")).withColumn("_hour", F.hour("t"))
    there = F.array(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in areas])
    set_of = F.array_join(F.array_compact(there), "+")
    own = reduce(lambda a, b: a + b, [F.coalesce(F.col(a), F.lit(0.0)) for a in areas])
    df = df.withColumn("_set", set_of).withColumn("_own", own)
    cand = F.col(total).isNull() & (F.col("_set") != "") & (F.col("_after") >= steps)
    # the few (day, set) pairs to fill meet the history of the days before
    groups = df.where(cand).select(F.col("_day").alias("_d"), F.col("_set").alias("_s")).distinct()
    history = df.select("_day", "_hour", F.col(total).alias("_total"), *areas)
    asked = groups.withColumn("_day", F.explode(F.sequence(F.date_sub("_d", window_days), F.date_sub("_d", 1))))
    past = asked.join(history, "_day")
    members = [F.array_contains(F.split("_s", r"\+"), a) for a in areas]
    set_sum = reduce(lambda a, b: a + b, [F.when(m, F.col(a)).otherwise(0.0) for m, a in zip(members, areas, strict=True)])
    past = past.withColumn("_num", set_sum).withColumn("_ok", F.col("_total").isNotNull() & F.col("_num").isNotNull())
    full = Window.partitionBy("_d", "_s", "_day")
    past = past.withColumn("_full", F.count_if("_ok").over(full) == steps).where("_full")
    pooled = past.groupBy("_d", "_s").agg(F.count_distinct("_day").alias("_days"), F.sum("_num").alias("_pn"), F.sum("_total").alias("_pt"), F.count("*").alias("_pc"))
    hourly = past.groupBy("_d", "_s", "_hour").agg(F.sum("_num").alias("_hn"), F.sum("_total").alias("_ht"), F.count("*").alias("_hc"))
    out = df.join(pooled, (F.col("_day") == F.col("_d")) & (F.col("_set") == F.col("_s")), "left").drop("_d", "_s")
    out = out.join(hourly.withColumnRenamed("_hour", "_h"), (F.col("_day") == F.col("_d")) & (F.col("_set") == F.col("_s")) & (F.col("_hour") == F.col("_h")), "left")
    num, den, n = (F.col("_hn"), F.col("_ht"), F.col("_hc")) if per_hour else (F.col("_pn"), F.col("_pt"), F.col("_pc"))
    part = share(num, den)
    rule = (
        F.when(F.col(total).isNotNull(), "given").when(~cand, "open").when(F.coalesce("_days", F.lit(0)) < min_days, "guarded").when(F.lit(min_share > 0) & ~(F.col("_pn") >= min_share * F.col("_pt")), "capped")
        .when((part > SHARE_FLOOR) & (part < SHARE_CEIL), "share").when((den / F.greatest(n, F.lit(1)) <= NIGHT_MW) & (F.abs("_own") <= NIGHT_MW), "night").otherwise("guarded")
    )
    out = out.withColumn("rule", rule).withColumn("filled", F.when(F.col("rule") == "given", F.col(total)).when(F.col("rule") == "share", F.col("_own") / part).when(F.col("rule") == "night", F.lit(0.0)))
    return out.drop("_after", "_day", "_hour", "_set", "_own", "_days", "_pn", "_pt", "_pc", "_d", "_s", "_h", "_hn", "_ht", "_hc")
