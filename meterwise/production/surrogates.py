"""Own forecasts of inputs: renewables by target, and stand-ins for load forecasts that are not out yet.

All are boosted trees by rolling periods (models.boosted) over features that Spark makes: weather, calendar, and lags by time
that are published when the forecast is due. Tables: t, columns; one series each, targets as rows of the design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import timekit as K
from meterwise.models import boosted

#: UTC hours of the day before that belong to the next local day.
LATE = (22, 23)


def calendar() -> list[Column]:
    return [F.hour("t"), F.dayofyear("t")]


def design(df: DataFrame, columns: list[str], more: list[Column]) -> DataFrame:
    """df with x, the named columns and more, as doubles."""
    return df.withColumn("x", F.array(*[F.col(c).cast("double") for c in columns], *[c.cast("double") for c in more]))


def own_renewables(weather: DataFrame, actual: DataFrame, capacity: DataFrame, targets: dict[str, str], first: str, unit: str = "month", **how) -> DataFrame:
    """t, target, mw from `first` on: each target as a share of its capacity, learned from the periods before.

    weather: t, statistics. actual: t, targets (null where not known). capacity: t, capacities (its own time's, known
    ahead). targets: target -> capacity.
    """
    stats = [c for c in weather.columns if c != "t"]
    base = design(weather.join(capacity, "t"), stats, calendar()).select("t", "x", *targets.values())
    of = F.explode(F.array(*[F.struct(F.lit(a).alias("target"), F.col(c).alias("capacity")) for a, c in targets.items()]))
    base = base.select("t", "x", of.alias("p")).select("t", "x", "p.target", "p.capacity")
    known = actual.select("t", F.explode(F.array(*[F.struct(F.lit(a).alias("target"), F.col(a).alias("v")) for a in targets])).alias("p")).select("t", "p.target", "p.v")
    rows = base.join(known, ["t", "target"]).withColumn("y", F.when(F.col("capacity") > 0, F.col("v") / F.col("capacity")))
    ask = base.where(F.col("t") >= F.lit(first).cast("timestamp_ntz"))
    models = boosted.fitted(rows, ask.select("target", boosted.period_of(F.col("t"), unit).alias("period")), unit, **how)
    got = boosted.served(ask, models, unit).join(ask.select("t", "target", "capacity"), ["t", "target"])
    return got.select("t", "target", (F.greatest(F.lit(0.0), F.col("pred")) * F.col("capacity")).alias("mw"))


def total_of(parts: DataFrame, targets: int) -> DataFrame:
    """t, mw of the hours for which all targets have a forecast."""
    return parts.groupBy("t").agg(F.sum("mw").alias("mw"), F.count("mw").alias("n")).where(F.col("n") == targets).select("t", "mw")


def load_surrogate(weather: DataFrame, load: DataFrame, holidays: DataFrame, first: str, unit: str = "month", gap: str = "1 DAY", day_before: bool = False, **how) -> DataFrame:
    """t, mw from `first` on: the load forecast as weather, calendar, holidays and its own past give it.

    load: t, v. holidays: day, share. The value seven days before is always a feature. With `day_before` so is that of the
    same hour 24 hours earlier; hours 22 and 23 of that day belong to the next local day, which is not out yet, so they
    look back 48. Models learn from target days up to `gap` before their period.
    """
    stats = [c for c in weather.columns if c != "t"]
    spine = weather.withColumn("s", F.lit(""))
    past = load.withColumn("s", F.lit(""))
    lagged = lambda df, name, hours: df.join(past.select("s", (F.col("t") + F.expr(f"INTERVAL {hours} HOURS")).alias("t"), F.col("v").alias(name)), ["s", "t"], "left")
    x = lagged(spine, "week_before", 168)
    more = [F.col("week_before"), *calendar(), F.weekday("t")]
    if day_before:
        x = lagged(lagged(x, "_24", 24), "_48", 48)
        more += [F.when(F.hour("t").isin(*LATE), F.col("_48")).otherwise(F.col("_24")), F.weekday(F.date_sub(F.to_date("t"), 1))]
    days = holidays.select("day", "share")
    for off in (-1, 0, 1):
        own = days.select(F.date_sub("day", off).alias("_day"), F.col("share").alias(f"_h{off + 1}"))
        x = x.withColumn("_day", F.to_date("t")).join(own, "_day", "left")
        more.append(F.coalesce(F.col(f"_h{off + 1}"), F.lit(0.0)))
    x = design(x, stats, more).select(F.lit("load").alias("target"), "t", "x")
    ask = x.where(F.col("t") >= F.lit(first).cast("timestamp_ntz"))
    rows = x.join(load.select("t", F.col("v").alias("y")), "t")
    models = boosted.fitted(rows, ask.select("target", boosted.period_of(F.col("t"), unit).alias("period")), unit, gap=gap, **how)
    return boosted.served(ask, models, unit).select("t", F.greatest(F.lit(0.0), F.col("pred")).alias("mw"))


def week_before(load: DataFrame) -> DataFrame:
    """t, mw: the plain stand-in, the value seven days before."""
    return load.select((F.col("t") + F.expr("INTERVAL 168 HOURS")).alias("t"), F.col("v").alias("mw")).where(F.col("mw").isNotNull())


def missing_weather(weather: DataFrame, hours: DataFrame) -> DataFrame:
    """Hours to be forecast that have no weather row: a caller must not go on with them."""
    return K.keep_first(hours, ["t"], "t").join(weather.select("t"), "t", "left_anti")
