"""One delivery day: what is known at its gate, the networks' rows, the lasso's day, and features for correcting trees.

Hourly frames are (series, t, ...); `delivery` is a date. Nothing here reads an hour that the gate did not know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import ffill, islands, time_lag
from meterwise.models import lear, nets

# A training row's window in days, the least days of an ensemble, floor and factors of the fuel cost, hours
# of the day before that the gate does not know, hours that may be missing, the lasso's window.
WINDOW_DAYS, LEAST_TRAIN_DAYS = 1460, 1000
COST_FLOOR, PER_GAS, PER_CARBON = 20.0, 2.0, 0.37
LATE_HOURS = (22, 23)
MOST_GAPS, MOST_HEALED = 2, 4
LEAR_WINDOW = 364


def fuel_cost(gas: Column, carbon: Column) -> Column:
    return F.greatest(F.lit(COST_FLOOR), PER_GAS * gas + PER_CARBON * carbon)


def model_days(hours: DataFrame) -> DataFrame:
    """series, day, price(24), exog (load, res, neighbours), gas, carbon, scale of the days whose 24 hours are complete.

    hours: series, t, price, load, res, neighbours, gas, carbon. Neighbours and fuels carry their last value forward;
    carbon is 0 before its source begins.
    """
    rows = ffill(hours, ["neighbours", "gas", "carbon"], ["series"]).withColumn("carbon", F.coalesce("carbon", F.lit(0.0)))
    rows = rows.dropna(subset=["price", "load", "res", "neighbours", "gas"])
    cols = ["price", "load", "res", "neighbours", "gas", "carbon"]
    day = rows.groupBy("series", F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("x")).where(F.size("x") == 24)
    of = lambda c: F.transform("x", lambda e: e[c])
    mean = lambda c: F.aggregate(of(c), F.lit(0.0), lambda a, v: a + v) / 24.0
    out = day.select("series", "day", of("price").alias("price"), F.array(of("load"), of("res"), of("neighbours")).alias("exog"), mean("gas").alias("gas"), mean("carbon").alias("carbon"))
    return out.withColumn("scale", fuel_cost(F.col("gas"), F.col("carbon")))


def network_rows(days: DataFrame) -> DataFrame:
    """series, day, x, y, scale: prices in units of their day's fuel cost, lags as the gate knows them, fuels, weekday.

    A row stands in a stretch of complete days: where a day that it looks back to is missing, it goes.
    """
    scaled = days.withColumn("price", F.transform("price", lambda p: p / F.col("scale")))
    rows = lear.features(scaled, gate_safe=True).where("x is not null")
    return rows.select("series", "day", F.concat("x", F.array("gas", "carbon"), "flags").alias("x"), F.col("price").alias("y"), "scale")


def training_set(rows: DataFrame, mondays: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """rows with `monday`: for the week of each monday the days up to two before it, the last `window_days` of them."""
    asked = mondays.select("monday", F.explode(F.sequence(F.date_sub("monday", window_days + 1), F.date_sub("monday", 2))).alias("day"))
    return rows.join(F.broadcast(asked), "day") if window_days <= WINDOW_DAYS else rows.join(asked, "day")


def train_ensemble(rows: DataFrame, mondays: DataFrame, heads: tuple[str, ...] = ("jsu", "quantile"), seeds: int = 12, rounds: int = 400, window_days: int = WINDOW_DAYS, least: int = LEAST_TRAIN_DAYS) -> DataFrame:
    """series, monday, trained_through, n_days, head, seed, net: the weekly ensembles; too few complete days are an error."""
    train = training_set(rows, mondays, window_days).withColumn("key", F.concat_ws("|", F.col("monday").cast("string"), "series"))
    asked = mondays.crossJoin(rows.select("series").distinct()).withColumn("key", F.concat_ws("|", F.col("monday").cast("string"), "series"))  # weeks by series, no data
    meta = asked.join(train.groupBy("key").agg(F.max("day").alias("trained_through"), F.count("*").alias("n_days")), "key", "left")
    few = meta.where(F.coalesce("n_days", F.lit(0)) < least).limit(5).collect()
    if few:
        raise ValueError(f"fewer than {least} complete training days: {[(r['key'], r['n_days']) for r in few]}")
    fitted = nets.members(train.select("key", "x", "y"), heads, seeds, rounds)
    return fitted.join(meta, "key").select("series", "monday", "trained_through", "n_days", "head", "seed", "net")


def at_gate(loads: DataFrame, deliveries: DataFrame, substitute: DataFrame | None = None, evening: bool = False) -> DataFrame:
    """series, delivery, t, load, filled, surrogate: the load forecast of each delivery's hours as its gate saw it.

    loads, substitute: series, t, load; deliveries: series, delivery. Hours 22 and 23 always come from 24 hours before,
    whatever a later table holds, and so do up to two other missing hours; with more gaps the day takes the substitute
    (flagged). An evening edition always takes the substitute. A day that still lacks an hour has no rows.
    """
    hours = deliveries.select("series", "delivery", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    hours = hours.withColumn("t", F.col("delivery").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h")))
    rows = hours.join(loads.select("series", "t", F.col("load").alias("now")), ["series", "t"], "left")
    rows = rows.join(loads.select("series", (F.col("t") + F.expr("INTERVAL 24 HOURS")).alias("t"), F.col("load").alias("before")), ["series", "t"], "left")
    other = loads.limit(0) if substitute is None else substitute
    rows = rows.join(other.select("series", "t", F.col("load").alias("other")), ["series", "t"], "left")
    seen = F.when(F.col("h").isin(*LATE_HOURS), F.col("before")).otherwise(F.col("now"))
    rows = rows.withColumn("seen", F.lit(None).cast("double") if evening else seen).withColumn("mended", F.lit(None).cast("double") if evening else F.coalesce("seen", "before"))
    day = Window.partitionBy("series", "delivery")
    rows = rows.withColumn("surrogate", (F.count_if(F.col("seen").isNull()).over(day) > MOST_GAPS) | (F.count_if(F.col("mended").isNull()).over(day) > 0))
    rows = rows.withColumn("load", F.when(F.col("surrogate"), F.col("other")).otherwise(F.col("mended"))).withColumn("lacking", F.count_if(F.col("load").isNull()).over(day))
    return rows.where("lacking = 0").select("series", "delivery", "t", "load", (~F.col("surrogate") & F.col("seen").isNull()).alias("filled"), "surrogate")


def gate_rows(days: DataFrame, deliveries: DataFrame, load: DataFrame, neighbours: DataFrame, res: DataFrame, fuels: DataFrame) -> DataFrame:
    """series, day, x, scale: the networks' input row for each delivery.

    days: model_days() of the history, with the day before delivery as far as it is known (hours 22 and 23 may hold
    anything, they don't reach x). load, neighbours: at_gate(); res: series, t, load as well; fuels: series, delivery, gas,
    carbon. A delivery that lacks an input has no row.
    """
    arrays = lambda df, n: df.groupBy("series", F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", "load"))).alias("x")).where(F.size("x") == 24).select("series", "day", F.transform("x", lambda e: e["load"]).alias(n))
    own = deliveries.select("series", F.col("delivery").alias("day")).join(arrays(load, "l"), ["series", "day"]).join(arrays(res, "r"), ["series", "day"]).join(arrays(neighbours, "n"), ["series", "day"])
    own = own.join(fuels.withColumnRenamed("delivery", "day"), ["series", "day"])
    none = F.array_repeat(F.lit(None).cast("double"), 24)
    own = own.select("series", "day", none.alias("price"), F.array("l", "r", "n").alias("exog"), "gas", "carbon", fuel_cost(F.col("gas"), F.col("carbon")).alias("scale"))
    # the eight days of each delivery, named after it, so that one table serves many deliveries
    asked = deliveries.select("series", "delivery", F.explode(F.sequence(F.date_sub("delivery", 7), F.date_sub("delivery", 1))).alias("day"))
    name = F.concat_ws("|", F.col("delivery").cast("string"), "series").alias("series")
    past = days.join(asked, ["series", "day"]).select(name, "day", "price", "exog", "gas", "carbon", "scale")
    rows = network_rows(past.unionByName(own.withColumn("delivery", F.col("day")).select(name, "day", "price", "exog", "gas", "carbon", "scale")))
    rows = rows.where(F.to_date(F.substring_index("series", "|", 1)) == F.col("day")).where(~F.exists("x", F.isnull))
    return rows.select(F.expr("substring(series, 12)").alias("series"), "day", "x", "scale")


def network_day(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """series, t, raw: hourly levels of each gate row (series, day, x, scale) by its series' ensemble.

    fitted: train_ensemble() of one week. A net that was trained on days after the second before delivery is an error:
    its targets were not known at the gate.
    """
    late = rows.join(fitted.groupBy("series").agg(F.max("trained_through").alias("through")), "series").where(F.col("through") > F.date_sub("day", 2)).limit(1).collect()
    if late:
        raise ValueError(f"trained through {late[0]['through']}: too late for delivery {late[0]['day']}")
    got = nets.predict(rows.select(F.col("series").alias("key"), F.col("day").cast("timestamp_ntz").alias("t"), "x"), fitted.withColumnRenamed("series", "key"))
    out = got.select(F.col("key").alias("series"), F.to_date("t").alias("day"), (F.col("t") + F.make_dt_interval(F.lit(0), F.col("i"))).alias("t"), "q")
    return out.join(rows.select("series", "day", "scale"), ["series", "day"]).select("series", "t", F.transform("q", lambda x: x * F.col("scale")).alias("raw"))


def healed(hours: DataFrame, deliveries: DataFrame, cols: list[str]) -> DataFrame:
    """hours with the day before each delivery mended from 24 hours earlier, where at most four of its hours lack something."""
    last = deliveries.select("series", F.date_sub("delivery", 1).alias("_day"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_h"))
    last = last.select("series", (F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("_h"))).alias("t"), F.lit(True).alias("_last")).distinct()
    rows = time_lag(hours.select("series", "t", *cols).join(last, ["series", "t"], "full_outer"), {c: f"_{c}" for c in cols}, "24 HOURS", ["series"])
    lacks = F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) if len(cols) > 1 else F.col(cols[0]).isNull().cast("int")
    n = F.sum(lacks).over(Window.partitionBy("series", F.to_date("t")))
    mend = F.coalesce("_last", F.lit(False)) & (n <= MOST_HEALED)
    return rows.select("series", "t", *[F.when(mend, F.coalesce(c, f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols])


def lear_day(hours: DataFrame, delivery_inputs: DataFrame, window: int = LEAR_WINDOW) -> DataFrame:
    """series, t, pred: the lasso's day of each series, calibrated on the trailing complete days.

    hours: series, t, price, load, res; delivery_inputs: series, t, load, res of the 24 hours of one delivery a series.
    The day before is healed at its end. Complete days count one after the other, also over a day that is missing; if the
    last one is not the day before delivery, or an input of delivery is missing, that is an error.
    """
    cols = ["price", "load", "res"]
    ask = delivery_inputs.groupBy("series", F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", "load", "res"))).alias("x"))
    bad = ask.where((F.size("x") != 24) | F.exists("x", lambda e: e["load"].isNull() | e["res"].isNull())).limit(1).collect()
    if bad:
        raise ValueError(f"inputs of delivery {bad[0]['day']} are not complete")
    deliveries = ask.select("series", F.col("day").alias("delivery"))
    rows = healed(hours, deliveries, cols).dropna(subset=cols)
    days = rows.groupBy("series", F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(F.struct("t", *cols))).alias("x")).where(F.size("x") == 24)
    days = days.join(deliveries, "series").where(F.col("day") < F.col("delivery"))
    stale = days.groupBy("series", "delivery").agg(F.max("day").alias("last")).join(deliveries, ["series", "delivery"], "right").where(F.coalesce(F.col("last") != F.date_sub("delivery", 1), F.lit(True))).limit(1).collect()
    if stale:
        raise ValueError(f"complete days end {stale[0]['last']}, before the day before {stale[0]['delivery']}")
    of = lambda c: F.transform("x", lambda e: e[c])
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("day")))
    known = days.withColumn("n", -back).where(F.col("n") >= -(window + lear.BURN_IN)).select("series", "n", F.weekday("day").alias("weekday"), of("price").alias("price"), F.array(of("load"), of("res")).alias("exog"))
    own = ask.select("series", F.lit(0).alias("n"), F.weekday("day").alias("weekday"), F.array_repeat(F.lit(None).cast("double"), 24).alias("price"), F.array(of("load"), of("res")).alias("exog"))
    # days by their place: the lasso looks back by a date that counts complete days alone
    both = known.unionByName(own).withColumn("day", F.date_add(F.lit("2000-01-01").cast("date"), F.col("n"))).drop("n")
    got = lear.rolling(both, own.select("series", F.lit("2000-01-01").cast("date").alias("day")), window)
    out = got.join(deliveries, "series")
    return out.select("series", (F.col("delivery").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour"))).alias("t"), "pred")


def stretches(days: DataFrame) -> DataFrame:
    """series, first_day, last_day, n_days: runs of complete days, oldest first."""
    return islands(days.select("series", "day"), ["series"])


def correction_features(fc: DataFrame, inputs: DataFrame) -> DataFrame:
    """fc (dense hours: series, t, pred, actual) with what a tree may correct its errors by.

    inputs: series, t, load, res, rl, gas, carbon. Errors of the day before are seen for hours 0 to 21 alone.
    """
    x = fc.join(inputs, ["series", "t"], "left").withColumn("day", F.to_date("t")).withColumn("_e", F.col("actual") - F.col("pred"))
    x = x.withColumn("_d1", F.when(~F.hour("t").isin(*LATE_HOURS), F.col("_e")))
    day = Window.partitionBy("series", "day")
    mean = x.groupBy("series", F.date_add("day", 1).alias("day")).agg(F.avg(F.abs("_d1")).alias("resid_mean_abs_d1"))
    lagged = time_lag(x.select("series", "t", "_d1"), {"_d1": "resid_lag24"}, "24 HOURS", ["series"]).drop("_d1")
    week = time_lag(x.select("series", "t", "_e"), {"_e": "resid_lag168"}, "168 HOURS", ["series"]).drop("_e")
    year = 2 * F.pi() * F.dayofyear("t") / 365.25
    out = x.withColumns({
        "hour": F.hour("t"), "dayofweek": F.weekday("t"), "doy_sin": F.sin(year), "doy_cos": F.cos(year),
        "rl_day_max": F.max("rl").over(day), "rl_day_min": F.min("rl").over(day),
    })
    return out.join(mean, ["series", "day"], "left").join(lagged, ["series", "t"]).join(week, ["series", "t"]).drop("_e", "_d1", "day")


def price_features(prices: DataFrame) -> DataFrame:
    """series, t, price_lag24, price_lag168, price_d1_mean, _max, _min of dense prices (series, t, price): for a tree that
    forecasts the price itself. The day before is seen for hours 0 to 21 alone."""
    x = prices.withColumn("_d1", F.when(~F.hour("t").isin(*LATE_HOURS), F.col("price")))
    d1 = x.groupBy("series", F.date_add(F.to_date("t"), 1).alias("_day")).agg(*[f("_d1").alias(f"price_d1_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])
    out = time_lag(x.select("series", "t", "_d1"), {"_d1": "price_lag24"}, "24 HOURS", ["series"]).drop("_d1")
    out = out.join(time_lag(prices.select("series", "t", "price"), {"price": "price_lag168"}, "168 HOURS", ["series"]).drop("price"), ["series", "t"])
    return out.withColumn("_day", F.to_date("t")).join(d1, ["series", "_day"], "left").drop("_day")


def with_prefixes(df: DataFrame, keep: list[str], prefixes: tuple[str, ...], suffix: str = "") -> DataFrame:
    """The columns named in keep, and those that begin with a prefix (and end with the suffix), in the table's order."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.startswith(prefixes) and c.endswith(suffix)])


def refits(first: str, last: str, every_days: int, spark) -> DataFrame:
    """start, end: refit dates from first on, each serving until the next one (or the day after last)."""
    starts = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.make_dt_interval(F.lit(every_days)))).alias("start"))
    return starts.select("start", F.least(F.date_add("start", every_days), F.date_add(F.to_date(F.lit(last)), 1)).alias("end"))


def backtest(rows: DataFrame, schedule: DataFrame, heads: tuple[str, ...] = ("quantile",), seeds: int = 2, rounds: int = 400, window_days: int = WINDOW_DAYS) -> DataFrame:
    """series, t, q, actual: walk forward; each refit trains on days up to two before its start and serves its days.

    All refits, heads and seeds are groups of one job. rows: network_rows().
    """
    named = lambda df: df.withColumn("key", F.concat_ws("|", F.col("start").cast("string"), "series"))
    dates = lambda a, b: schedule.select("start", F.explode(F.sequence(a, b)).alias("day"))
    train = named(rows.join(F.broadcast(dates(F.date_sub("start", window_days + 1), F.date_sub("start", 2))), "day"))  # a calendar
    ask = named(rows.join(F.broadcast(dates(F.col("start"), F.date_sub("end", 1))), "day"))
    got = nets.ensemble(train.select("key", "x", "y"), ask.select("key", F.col("day").cast("timestamp_ntz").alias("t"), "x"), heads, seeds, rounds)
    own = ask.select("key", "series", F.col("day").cast("timestamp_ntz").alias("t"), "scale", F.col("y"))
    out = got.join(own, ["key", "t"])
    served = F.transform("q", lambda x: F.least(F.greatest(x * F.col("scale"), F.lit(-500.0)), F.lit(4000.0)))
    return out.select("series", (F.col("t") + F.make_dt_interval(F.lit(0), F.col("i"))).alias("t"), served.alias("q"), (F.element_at("y", F.col("i") + 1) * F.col("scale")).alias("actual"))


