"""The hourly feature table as one lazy plan: the target's rows define the table, everything else joins to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import hsum, trunc
from meterwise.operators.joins import asof, ladder


def build(prices: list[DataFrame], forecasts: dict[str, list[DataFrame]], res: list[str], load: str, fuels: DataFrame | None = None, fuel_cols: list[str] | None = None, outages: DataFrame | None = None, fuel_delay: str = "2 DAYS") -> tuple[DataFrame, DataFrame]:
    """(features, summary).

    prices: sources (t, v) in order of preference; the hours with a price are the table's rows. forecasts: for each
    name sources (t, v), the first with a value counts. res: names whose sum is taken from `load` for the residual.
    fuels: (t at the settlement's midnight, columns); a settlement is known `fuel_delay` later. outages: (t, columns).
    """
    target = ladder(prices, ["t"], "v").select("t", F.col("v").alias("price"), F.col("rung").alias("price_rung"))
    out = target
    for name, sources in forecasts.items():
        got = ladder(sources, ["t"], "v").select("t", F.col("v").alias(name), F.col("rung").alias(f"{name}_rung"))
        out = out.join(got, "t", "left")
    out = out.withColumn("res", hsum(res, len(res))).withColumn("residual_load", F.col(load) - F.col("res"))
    if outages is not None:
        out = out.join(outages, "t", "left")
    if fuels is not None:
        late = fuels.withColumn("t", F.col("t") + F.expr(f"INTERVAL {fuel_delay}")).withColumn("s", F.lit("fuels"))
        out = asof(out.withColumn("s", F.lit("fuels")), late, ["s"], fuel_cols or [c for c in fuels.columns if c != "t"]).drop("s")
    patched = [F.count_if(F.col(f"{n}_rung") > 1).alias(f"{n}_patched") for n in forecasts] + [F.count_if(F.col(n).isNull()).alias(f"{n}_missing") for n in forecasts]
    summary = out.agg(F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(F.col("price_rung") > 1).alias("price_patched"), *patched)
    return out, summary


# ---- the whole table from raw sources


class Slots:
    """Sources of a wide hourly table, each a column; all meet in one union and one aggregation by hour."""

    def __init__(self):
        self.parts: list[DataFrame] = []

    def add(self, source: DataFrame) -> str:
        """A source (t, v) of any spacing; the name of its column of hourly means."""
        k = len(self.parts)
        self.parts.append(source.where(F.col("v").isNotNull()).select(trunc("hour", "t").alias("t"), F.lit(k).alias("slot"), F.col("v").cast("double").alias("v")))
        return f"_{k}"

    def wide(self) -> DataFrame:
        """Rows are summed up before they are dealt by hour, the only exchange that all sources share."""
        mean = lambda k: F.avg(F.when(F.col("slot") == k, F.col("v"))).alias(f"_{k}")
        return reduce(DataFrame.unionByName, self.parts).groupBy("t").agg(*[mean(k) for k in range(len(self.parts))])


def first_of(columns: list[str]) -> tuple[Column, Column]:
    """The first value there is, and its rung (from 1)."""
    rung = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(columns, 1)])
    return F.coalesce(*columns), rung.cast("long")


def settled(df: DataFrame, fuels: DataFrame, columns: list[str], lag_days: int) -> DataFrame:
    """df (t) with each column's last settlement that is `lag_days` old at least.

    fuels: day, columns; a column's missing value is its last one. A settlement counts until the next one, the last for good, so
    the dimension is one row for each day of the fuels' years.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("day")
    filled = fuels.select("day", *[F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns], F.lead("day").over(order).alias("_next"))
    days = filled.select(F.explode(F.sequence("day", F.coalesce(F.date_sub("_next", 1), F.col("day")))).alias("_day"), *columns)
    last = filled.where("_next IS NULL").select(F.col("day").alias("_last"), *[F.col(c).alias(f"_l_{c}") for c in columns])  # one row, none without fuels
    x = df.withColumn("_day", F.to_date(F.col("t") - F.expr(f"INTERVAL {lag_days} DAYS"))).join(F.broadcast(days), "_day", "left").join(F.broadcast(last), F.col("_day") > F.col("_last"), "left")
    return x.select(*df.columns, *[F.coalesce(c, f"_l_{c}").alias(c) for c in columns])


def whole(prices: list[DataFrame], forecasts: dict[str, list[DataFrame]], load: str, res: list[str], neighbours: dict[str, tuple[DataFrame, list[DataFrame]]], outages: dict[str, DataFrame], fuels: DataFrame, fuel_columns: list[str], lag_days: int = 2) -> tuple[DataFrame, DataFrame]:
    """(features, summary) as one lazy plan.

    All sources are (t, v). prices and each forecast: in order of preference, the last of a forecast may be its total rebuilt
    from areas. neighbours: a zone's load and the parts of its renewables (none: nothing is taken off; an hour that lacks all of
    them has no residual load). outages: profiles by name, 0 where they say nothing. Hours with a price are the rows.
    """
    slots = Slots()
    price = [slots.add(p) for p in prices]
    rungs = {n: [slots.add(s) for s in own] for n, own in forecasts.items()}
    zones = {z: (slots.add(a), [slots.add(b) for b in parts]) for z, (a, parts) in neighbours.items()}
    away = {n: slots.add(s) for n, s in outages.items()}
    x = slots.wide()
    value, rung = first_of(price)
    out = {"price": value, "price_rung": rung}
    for n, own in rungs.items():
        out[n], out[f"{n}_rung"] = first_of(own)
    named = x.select("t", *[c.alias(n) for n, c in out.items()], *[F.col(c) for a, parts in zones.values() for c in (a, *parts)], *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in away.items()]).where("price IS NOT NULL")
    table = named.withColumn("residual_load", F.col(load) - hsum(res, len(res)))
    for z, (a, parts) in zones.items():
        table = table.withColumns({f"load_{z}": F.col(a), f"rl_{z}": F.col(a) - (hsum(parts, 1) if parts else F.lit(0.0))})
    table = settled(table.drop(*[c for a, parts in zones.values() for c in (a, *parts)]), fuels, fuel_columns, lag_days)
    features = [c for c in table.columns if not c.endswith("_rung")]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in features])
    by_rung = [F.count_if(F.col(f"{n}_rung") == i).alias(f"{n}_from_{i}") for n, own in {"price": price, **rungs}.items() for i in range(2, len(own) + 1)]
    missing = [F.count_if(F.col(n).isNull()).alias(f"{n}_missing") for n in rungs]
    summary = table.agg(F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"), *by_rung, *missing, F.count_if(complete).alias("complete_rows"), F.lit(lag_days).alias("fuel_lag_days"))
    return table, summary
