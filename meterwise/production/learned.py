"""Learned mixes: the history they are fitted on, their weights for a delivery day, and the seed before the first day.

Hourly frames are (series, t, ...); a forecast is an array of 99 levels. A day counts only with all its 24 hours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import quantiles as Q
from meterwise.functions.timekit import whole_days
from meterwise.models import mix

# The window of a fit ends two days before delivery; with fewer days than the least the weight is a half.
WINDOW_DAYS, LEAST_DAYS, SEED_DAYS = 90, 60, 180
FEATURES = ["load", "res", "holiday", "price_before"]


def prefer(live: DataFrame, seed: DataFrame, cols: list[str]) -> DataFrame:
    """series, t, cols, from_seed: whole days of the live log, and of the seed where the log has no such day."""
    days = lambda df: whole_days(df, ["series"], cols).select("series", "t", *cols, F.to_date("t").alias("_day"))
    own = days(live)
    rest = days(seed).join(own.select("series", "_day").distinct(), ["series", "_day"], "left_anti")
    return own.withColumn("from_seed", F.lit(False)).unionByName(rest.withColumn("from_seed", F.lit(True))).drop("_day")


def day_features(inputs: DataFrame, prices: DataFrame, shares: DataFrame) -> DataFrame:
    """series, t, load, res, holiday, price_before of inputs (series, t, load, res).

    prices: series, t, y. The price is the mean of hours 0 to 21 of the day before: later ones are not known at the gate.
    shares: day, share of people on holiday.
    """
    before = prices.where(F.hour("t") < 22).groupBy("series", F.date_add(F.to_date("t"), 1).alias("_day")).agg(F.avg("y").alias("price_before"))
    rows = inputs.withColumn("_day", F.to_date("t")).join(before, ["series", "_day"], "left")
    rows = rows.join(shares.select(F.col("day").alias("_day"), F.col("share").alias("holiday")), "_day", "left")
    return rows.select("series", "t", "load", "res", F.coalesce("holiday", F.lit(0.0)).alias("holiday"), "price_before")


def history(live_a: DataFrame, live_b: DataFrame, live_x: DataFrame, seed: DataFrame, prices: DataFrame, proxy: DataFrame) -> DataFrame:
    """series, day, t, a, b, y, features, seed, proxy: what a fit may use, the live log before the seed, part by part.

    live_a, live_b: series, t, q; live_x and proxy: series, t and FEATURES; seed: series, t, a, b, y and FEATURES; prices:
    series, t, y. Features of a day are the logged ones, else the seed's, else the proxy's (flagged).
    """
    pick = lambda df, q, n: df.select("series", "t", F.col(q).alias(n))
    a = prefer(pick(live_a, "q", "a"), pick(seed, "a", "a"), ["a"]).withColumnRenamed("from_seed", "_a")
    b = prefer(pick(live_b, "q", "b"), pick(seed, "b", "b"), ["b"]).withColumnRenamed("from_seed", "_b")
    known = prefer(live_x.select("series", "t", *FEATURES), seed.select("series", "t", *FEATURES), FEATURES).drop("from_seed")
    rest = proxy.select("series", "t", *[F.col(c).alias(f"_{c}") for c in FEATURES])
    out = a.join(b, ["series", "t"]).join(prices.select("series", "t", "y"), ["series", "t"], "left")
    out = out.join(seed.select("series", "t", F.col("y").alias("_y")), ["series", "t"], "left").join(known, ["series", "t"], "left").join(rest, ["series", "t"], "left")
    # a day has logged features for all hours or for none
    named = F.col("load").isNotNull()
    return out.select(
        "series", F.to_date("t").alias("day"), "t", "a", "b", F.coalesce("y", "_y").alias("y"), *[F.when(named, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in FEATURES],
        (F.col("_a") | F.col("_b")).alias("seed"), (~named & F.col("_load").isNotNull()).alias("proxy"),
    )


def window_of(hist: DataFrame, deliveries: DataFrame, with_features: bool = False, days: int = WINDOW_DAYS) -> DataFrame:
    """hist with `delivery`: for each delivery (series, delivery) the whole days of its window, the last two days before."""
    need = [F.col("y").isNotNull(), ~F.exists("a", F.isnull), ~F.exists("b", F.isnull)]
    if with_features:
        need += [F.col(c).isNotNull() for c in FEATURES] + [F.col("load") != 0]
    ok = reduce(lambda x, y: x & y, need)
    whole = hist.groupBy("series", "day").agg(F.count_if(ok).alias("_n")).where("_n = 24").drop("_n")
    asked = deliveries.select("series", "delivery", F.explode(F.sequence(F.date_sub("delivery", days + 1), F.date_sub("delivery", 2))).alias("day"))
    return hist.join(asked.join(whole, ["series", "day"]), ["series", "day"])


def weights(hist: DataFrame, asked: DataFrame, variant: str, days: int = WINDOW_DAYS, least: int = LEAST_DAYS) -> DataFrame:
    """series, delivery, t, w, fit_days, seed_days, proxy_days, fallback for each hour of asked (series, t, a, b, features).

    Variants: m1 (a weight for each hour of the day, by dynamic programming) and m3 (logistic in features; hours of a
    delivery day whose features are not all there get no row). With fewer than `least` days to fit on w is a half.
    """
    asked = asked.withColumn("delivery", F.to_date("t"))
    if variant == "m3":
        asked = whole_days(asked, ["series"], FEATURES)
    deliveries = asked.select("series", "delivery").distinct()
    rows = window_of(hist, deliveries, variant == "m3", days)
    info = rows.groupBy("series", "delivery").agg(
        F.count_distinct("day").alias("fit_days"), F.count_distinct(F.when(F.col("seed"), F.col("day"))).alias("seed_days"), F.count_distinct(F.when(F.col("proxy"), F.col("day"))).alias("proxy_days"))
    info = deliveries.join(info, ["series", "delivery"], "left").fillna(0).withColumn("fallback", F.col("fit_days") < least)
    enough = rows.join(info.where("not fallback").select("series", "delivery"), ["series", "delivery"], "left_semi")
    # a fit's group is one series and delivery
    named = lambda df: df.withColumn("_s", F.col("series")).withColumn("series", F.concat_ws("|", F.col("delivery").cast("string"), "series"))
    if variant == "m1":
        got = mix.hourly_weights(mix.losses(named(enough).select("series", F.hour("t").alias("hour"), "a", "b", "y")))
        found = named(asked).withColumn("hour", F.hour("t")).join(got, ["series", "hour"], "left")
    elif variant == "m3":
        x = mix.weight_features().alias("x")
        got = mix.logistic_weights(named(enough).select("series", x, "a", "b", "y"), named(asked).select("series", "t", x))
        found = named(asked).join(got, ["series", "t"], "left")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    out = found.select(F.col("_s").alias("series"), "delivery", "t", "w").join(info, ["series", "delivery"])
    return out.withColumn("w", F.when(F.col("fallback"), F.lit(0.5)).otherwise(F.col("w"))).select("series", "delivery", "t", "w", "fit_days", "seed_days", "proxy_days", "fallback")


def step(hist: DataFrame, hours: DataFrame, quarters: DataFrame, variant: str, days: int = WINDOW_DAYS, least: int = LEAST_DAYS) -> DataFrame:
    """The rows to log for delivery days: series, kind (h, qh), t, variant, w, fit_days, seed_days, proxy_days, fallback, q.

    hours: series, t, a, b and features; quarters: series, t, q (of model a). Quarters move as their hour moved. A day
    without all 24 hours and 96 quarters gets no rows.
    """
    full = hours.groupBy("series", F.to_date("t").alias("_day")).agg(F.count("*").alias("_h")).where("_h = 24")
    full = full.join(quarters.groupBy("series", F.to_date("t").alias("_day")).agg(F.count("*").alias("_q")).where("_q = 96"), ["series", "_day"]).select("series", "_day")
    asked = hours.withColumn("_day", F.to_date("t")).join(full, ["series", "_day"], "left_semi").drop("_day")
    w = weights(hist, asked, variant, days, least)
    h = asked.select("series", "t", "a", "b").join(w, ["series", "t"]).withColumn("m", Q.mix(F.col("a"), F.col("b"), F.col("w")))
    info = ["w", "fit_days", "seed_days", "proxy_days", "fallback"]
    qh = quarters.select("series", F.col("t").alias("_t"), F.col("q").alias("_q"), F.date_trunc("hour", "t").cast("timestamp_ntz").alias("t")).join(h, ["series", "t"])
    out = h.select("series", F.lit("h").alias("kind"), "t", *info, F.col("m").alias("q"))
    return out.unionByName(qh.select("series", F.lit("qh").alias("kind"), F.col("_t").alias("t"), *info, Q.shifted(F.col("_q"), F.col("m"), F.col("a")).alias("q"))).withColumn("variant", F.lit(variant))


def seed_rows(a: DataFrame, b: DataFrame, prices: DataFrame, features: DataFrame, before: Column, days: int = SEED_DAYS) -> DataFrame:
    """series, t, a, b, y, features: the days before the first live one on which both models have all hours.

    a, b: series, t, q (b recalibrated); features may be missing.
    """
    inside = (F.to_date("t") < before) & (F.to_date("t") >= F.date_sub(before, days))
    pick = lambda df, n: whole_days(df.where(inside), ["series"], ["q"]).select("series", "t", F.col("q").alias(n))
    out = pick(a, "a").join(pick(b, "b"), ["series", "t"]).join(prices.select("series", "t", "y"), ["series", "t"], "left")
    return out.join(features.select("series", "t", *FEATURES), ["series", "t"], "left")
