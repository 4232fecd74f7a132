"""Scores of point and percentile forecasts as aggregates; one pass over (t, actual, pred) each."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions import quantiles as Q


def strict(value: Column, *needs: Column) -> Column:
    """An average that is null as soon as one row lacks an input, as a mean over NaN is."""
    lacking = F.count_if(sum((n.isNull().cast("int") for n in needs), F.lit(0)) > 0)
    return F.when(lacking == 0, F.avg(value))


def mae(a: Column, p: Column) -> Column:
    return strict(F.abs(a - p), a, p)


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(strict(F.pow(a - p, 2.0), a, p))


def smape(a: Column, p: Column) -> Column:
    """Percent."""
    return 100.0 * strict(F.abs(a - p) / ((F.abs(a) + F.abs(p)) / 2.0), a, p)


def point_scores(a: Column, p: Column, naive: Column) -> list[Column]:
    hour = F.hour("t")
    part = lambda lo, hi: F.avg(F.when(hour.between(lo, hi), F.abs(a - p)))
    return [
        F.count("*").alias("n"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), (mae(a, p) / F.avg(F.abs(a - naive))).alias("rmae"),
        part(16, 18).alias("mae_evening"), part(0, 6).alias("mae_night"),
    ]


def negative_scores(a: Column, p: Column) -> list[Column]:
    """How well negative values are met; null where nothing is there to count."""
    both = (a < 0) & (p < 0)
    n_actual, n_pred = F.count_if(a < 0), F.count_if(p < 0)
    med = lambda x: F.percentile(F.when(both, x), F.lit(0.5))
    return [
        n_actual.alias("n_neg_actual"), n_pred.alias("n_neg_pred"), (F.count_if(both) / F.when(n_actual > 0, n_actual)).alias("sign_recall"), (F.count_if(both) / F.when(n_pred > 0, n_pred)).alias("sign_precision"),
        med(p).alias("median_pred"), med(a).alias("median_actual"), (med(p) / F.when(med(a) != 0, med(a))).alias("depth_ratio"), F.avg(F.when(a >= 0, F.abs(a - p))).alias("mae_nonneg"),
    ]


def dm(df: DataFrame, a: str, p: str, q: str, keys: list[str] | None = None) -> DataFrame:
    """Diebold-Mariano statistic of two forecasts from daily loss differences: keys, n_days, dm, mean_diff.

    A large value means that q is better. Equal losses on every day give 0.
    """
    keys = keys or []
    diff = F.abs(F.col(a) - F.col(p)) - F.abs(F.col(a) - F.col(q))
    days = df.groupBy(*keys, F.to_date("t").alias("day")).agg(F.sum(diff).alias("d"))
    var = F.var_pop("d")
    return days.groupBy(*keys).agg(F.count("*").alias("n_days"), F.avg("d").alias("mean_diff"), F.when(var == 0, F.lit(0.0)).otherwise(F.avg("d") / F.sqrt(var / F.count("*"))).alias("dm"))


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """1 - Phi(z)."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2.0)))


def probabilistic_scores(q: Column, a: Column) -> list[Column]:
    median = F.element_at(q, 50)
    in_ = lambda s: F.avg(Q.covered(q, a, s).cast("int"))
    loss = F.avg(Q.pinball(q, a))
    return [F.count(a).alias("n"), loss.alias("pinball"), (2 * loss).alias("crps"), F.avg(F.abs(a - median)).alias("mae_median"), in_(80).alias("cov80"), in_(90).alias("cov90"), in_(98).alias("cov98")]


def day_scores(df: DataFrame, q: str, a: str) -> DataFrame:
    """Scores of each (day, kind) over the rows with an actual; null without any."""
    known = F.when(F.col(a).isNotNull(), F.col(q))
    return df.groupBy(F.to_date("t").alias("day"), "kind").agg(*probabilistic_scores(known, F.col(a)))


def day_state(n_logged: Column, n_scored: Column, is_latest: Column) -> Column:
    """full with 24 scored hours; provisional while a fully logged past day is part known; else pending."""
    return F.when(n_scored == 24, "full").when((n_scored > 0) & (n_scored < 24) & (n_logged == 24) & ~is_latest, "provisional").otherwise("pending")


def coverage(df: DataFrame, value: str, t: str = "t") -> DataFrame:
    """By year of a dense hourly table: hours, hours with a value, percent."""
    return df.groupBy(F.year(t).cast("long").alias("year")).agg(F.count("*").alias("hours"), F.count(value).alias("present"), (F.count(value) * 100.0 / F.count("*")).alias("pct"))


def spacing(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dominant spacing in seconds of each day (smallest on ties)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, F.to_date("t")).orderBy("t")
    step = df.withColumn("_s", F.timestamp_diff("SECOND", F.lag("t").over(w), F.col("t"))).where("_s is not null")
    counts = step.groupBy(*keys, F.to_date("t").alias("day"), "_s").count()
    return counts.groupBy(*keys, "day").agg(F.min_by("_s", F.struct(-F.col("count"), F.col("_s"))).alias("step_s"))


def median_mad(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """keys, median, mad (of the normal's scale; 0 becomes 1)."""
    med = df.groupBy(*keys).agg(F.percentile(col, F.lit(0.5)).alias("median"))
    dev = df.join(F.broadcast(med), keys).withColumn("_d", F.abs(F.col(col) - F.col("median")))  # one row for each series
    out = dev.groupBy(*keys, "median").agg((F.percentile("_d", F.lit(0.5)) / 0.6745).alias("mad"))
    return out.withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))
