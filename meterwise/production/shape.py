"""The shape of quarters within their hour: what they deviate by, features of it, and quarters' percentiles from hours'.

Frames are (series, t, v). Hourly forecasts become quarters along lines through the middles of their hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions import quantiles as Q
from meterwise.functions.timekit import dense, interpolate, trunc
from meterwise.models import trees

FEATURES = ["qidx", "hour_utc", "dow", "load_dev", "solar_dev", "wind_dev", "load_ramp", "solar_ramp", "rl_ramp", "rl_level", "p_hour", "p_ramp"]
#: Of each quarter of an hour: the neighbour hour that its middle lies towards, and how far.
TOWARDS = [(-1, 0.375), (-1, 0.125), (1, 0.125), (1, 0.375)]


def _hour():
    return Window.partitionBy("series", trunc("hour", "t"))


def deviations(quarters: DataFrame) -> DataFrame:
    """series, t, dev: quarters less the mean of their hour, for hours with all four."""
    rows = quarters.where("v is not null").withColumn("_n", F.count("*").over(_hour())).withColumn("_m", F.avg("v").over(_hour()))
    return rows.where("_n = 4").select("series", "t", (F.col("v") - F.col("_m")).alias("dev"))


def as_quarters(hours: DataFrame) -> DataFrame:
    """series, t, v at quarters: hourly means along the lines through the hours' middles, flat at both ends."""
    rows = interpolate(dense(hours.select("series", "t", "v"), ["series"]), "v", ["series"], hold_left=True)
    w = Window.partitionBy("series").orderBy("t")
    rows = rows.withColumn("_before", F.coalesce(F.lag("v").over(w), "v")).withColumn("_after", F.coalesce(F.lead("v").over(w), "v"))
    part = lambda k, side, share: F.struct(
        (F.col("t") + F.expr(f"INTERVAL {15 * k} MINUTES")).alias("t"), (F.col("v") + share * (F.col("_before" if side < 0 else "_after") - F.col("v"))).alias("v"))
    return rows.select("series", F.explode(F.array(*[part(k, *x) for k, x in enumerate(TOWARDS)])).alias("q")).select("series", "q.t", "q.v")


def features(load15: DataFrame, solar: DataFrame, wind: DataFrame, price: DataFrame) -> DataFrame:
    """series, t and FEATURES at the quarters that all three inputs have; price is the hourly median forecast."""
    out = load15.select("series", "t", F.col("v").alias("load"))
    for name, df in (("solar", solar), ("wind", wind)):
        out = out.join(as_quarters(df).withColumnRenamed("v", name), ["series", "t"])
    own = [(F.col(c) - F.avg(c).over(_hour())).alias(f"{c}_dev") for c in ("load", "solar", "wind")]
    out = out.select("series", "t", trunc("hour", "t").alias("_h"), F.floor(F.minute("t") / 15).cast("int").alias("qidx"), F.hour("t").alias("hour_utc"), F.weekday("t").alias("dow"), *own)
    hour = load15.groupBy("series", trunc("hour", "t").alias("t")).agg(F.avg("v").alias("load"))
    for name, df in (("solar", solar), ("wind", wind)):
        hour = hour.join(df.select("series", "t", F.col("v").alias(name)), ["series", "t"])
    hour = hour.where("load is not null and solar is not null and wind is not null").withColumn("rl", F.col("load") - F.col("solar") - F.col("wind"))
    hour = hour.join(price.select("series", "t", F.col("v").alias("p")), ["series", "t"], "full_outer")
    # neighbours in time, not in rows
    beside = lambda c, n: F.first(c).over(Window.partitionBy("series").orderBy(F.unix_micros(F.col("t").cast("timestamp"))).rangeBetween(n * 3_600_000_000, n * 3_600_000_000))
    ramp = lambda c: beside(c, 1) - beside(c, -1)
    hour = hour.select("series", F.col("t").alias("_h"), *[ramp(c).alias(f"{c}_ramp") for c in ("load", "solar", "rl")], F.col("rl").alias("rl_level"), F.col("p").alias("p_hour"), ramp("p").alias("p_ramp"))
    return out.join(hour, ["series", "_h"], "left").select("series", "t", *FEATURES)


def fit_predict(known: DataFrame, dev: DataFrame, ask: DataFrame, rounds: int = 50) -> DataFrame:
    """series, t, dev: the median shape by boosted trees, moved so that each hour's quarters add up to nothing."""
    train = known.join(dev, ["series", "t"]).dropna(subset=[*FEATURES, "dev"])
    pred = trees.fit_predict(train, ask, FEATURES, "dev", loss="absolute", rounds=rounds)
    return pred.select("series", "t", (F.col("pred") - F.avg("pred").over(_hour())).alias("dev"))


def percentiles(hours: DataFrame, dev: DataFrame) -> DataFrame:
    """series, t, q of quarters: their hour's levels (series, t, q) moved by the shape, in order, within the price bounds."""
    rows = dev.withColumn("_h", trunc("hour", "t")).join(hours.select("series", F.col("t").alias("_h"), "q"), ["series", "_h"])
    return rows.select("series", "t", Q.clipped(F.array_sort(F.transform("q", lambda x: x + F.col("dev"))), *Q.PRICE_BOUNDS).alias("q"))
