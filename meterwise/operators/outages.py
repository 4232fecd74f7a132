"""Unavailable capacity from outage documents (mrid, revision, created_doc_time, docstatus, businesstype, start, end, nominal_power, avail_qty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import running_sum

# The documents' codes, and the names that tables of decoded documents hold instead.
INACTIVE = ["A09", "A13", "Cancelled", "Withdrawn"]
PLANNED, PLANNED_NAMES = "A53", ["A53", "Planned maintenance"]
CUTOFF_HOUR = 10


def mw():
    return F.greatest(F.lit(0.0), F.col("nominal_power") - F.col("avail_qty"))


def latest(docs: DataFrame, once: bool = True) -> DataFrame:
    """Rows of each document's largest revision; those of one start and end once, unless each row is to count. One sort."""
    order = Window.partitionBy("mrid").orderBy(F.desc("revision"), "start", "end")
    rows = docs.withColumn("_r", F.first("revision").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if once:
        again = [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in ("revision", "start", "end")]
        rows = rows.withColumn("_again", again[0] & again[1] & again[2]).where("NOT _again").drop("_again")
    return rows.where("revision = _r").drop("_r")


def active(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("docstatus").isNull() | ~F.col("docstatus").isin(INACTIVE))


def cutoffs(days: DataFrame, hour: int = CUTOFF_HOUR) -> DataFrame:
    """day, cutoff: the hour of the day before."""
    return days.select("day", (F.date_sub("day", 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {hour} HOURS")).alias("cutoff"))


def hourly(docs: DataFrame) -> DataFrame:
    """t, mw: time-averaged MW of every hour from the first that an interval touches to the last.

    An interval is what it adds in its first hour, in the one after, in its last and behind it: four changes at most, however
    long it is, and their running sum is the profile. Bounds are taken to the full minute before, MW to six decimals, so sums are
    exact and what has ended leaves nothing behind.
    """
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    x = docs.select(minute("start").alias("a"), minute("end").alias("b"), mw().cast("decimal(18,6)").alias("mw")).where("a < b and mw <> 0")
    within = F.timestamp_diff("MINUTE", "ha", F.least("b", F.col("ha") + F.expr("INTERVAL 1 HOUR"))) - F.minute("a")
    x = x.withColumns({"ha": hour("a"), "hb": hour("b")}).withColumn("first", within)
    one = F.expr("INTERVAL 1 HOUR")
    change = lambda t, minutes: F.struct(t.alias("t"), (F.col("mw") * minutes.cast("int")).cast("decimal(38,6)").alias("d"))
    apart = F.array(change(F.col("ha"), F.col("first")), change(F.col("ha") + one, 60 - F.col("first")), change(F.col("hb"), F.minute("b") - 60), change(F.col("hb") + one, -F.minute("b")))
    same = F.array(change(F.col("ha"), F.col("first")), change(F.col("ha") + one, -F.col("first")))
    steps = x.select(F.explode(F.when(F.col("ha") == F.col("hb"), same).otherwise(apart)).alias("c")).groupBy(F.col("c.t").alias("t")).agg(F.sum("c.d").alias("d"))
    # between two changes the profile is level: the hours of each month are filled in from the month's first
    ends = steps.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row
    hours = ends.select(F.explode(F.sequence("lo", "hi", one)).alias("t"))
    level = running_sum(hours.join(steps, "t", "left"), "d", "level")
    return level.where("level <> 0").select("t", (F.col("level") / 60).cast("double").alias("mw"))


def day_from(c: Column) -> Column:
    """Midnight of the first day whose cut-off is at or after c."""
    late = c.cast("timestamp_ntz") - F.expr(f"INTERVAL {CUTOFF_HOUR} HOURS")
    whole = F.date_trunc("day", late).cast("timestamp_ntz")
    return F.when(late > whole, whole + F.expr("INTERVAL 2 DAYS")).otherwise(whole + F.expr("INTERVAL 1 DAY"))


def at_cutoffs(docs: DataFrame, days: DataFrame, start_by_hours: int = 1) -> DataFrame:
    """day, mw: rows that run at the cut-off of `days` (day) and whose document began at least an hour before it.

    A row counts on one run of days: two changes, whatever its length, and their running sum. MW to six decimals, so sums are exact.
    """
    begin = F.min("start").over(Window.partitionBy("mrid")) + F.expr(f"INTERVAL {start_by_hours} HOURS")
    x = docs.select("start", "end", begin.alias("_begin"), mw().cast("decimal(18,6)").alias("mw")).where("start IS NOT NULL AND end IS NOT NULL")
    x = x.select(day_from(F.greatest("start", "_begin")).alias("a"), day_from(F.col("end")).alias("b"), "mw").where("a < b AND mw <> 0")
    change = lambda t, d: F.struct(F.col(t).alias("t"), d.cast("decimal(38,6)").alias("d"))
    steps = x.select(F.explode(F.array(change("a", F.col("mw")), change("b", -F.col("mw")))).alias("c")).groupBy(F.col("c.t").alias("t")).agg(F.sum("c.d").alias("d"))
    asked = days.select(F.col("day").cast("timestamp_ntz").alias("t"), F.lit(True).alias("_asked"))
    level = running_sum(steps.join(asked, "t", "full_outer"), "d", "level")
    return level.where("_asked").select(F.to_date("t").alias("day"), F.col("level").cast("double").alias("mw"))


def approximate(docs: DataFrame, hours: DataFrame, once: bool = True) -> DataFrame:
    """t, mw over `hours` (t): planned outages as they run, plus forced ones as they stood at the day's cut-off."""
    docs = active(latest(docs, once))
    planned = hourly(docs.where(F.col("businesstype").isin(PLANNED_NAMES)))
    days = hours.select(F.to_date("t").alias("day")).distinct()
    forced = at_cutoffs(docs.where(~F.col("businesstype").isin(PLANNED_NAMES)), days)
    out = hours.join(planned, "t", "left").withColumnRenamed("mw", "_p").withColumn("day", F.to_date("t")).join(forced, "day", "left")
    return out.select("t", (F.coalesce("_p", F.lit(0.0)) + F.coalesce("mw", F.lit(0.0))).alias("mw"))


def persistence(docs: DataFrame, hours: DataFrame, once: bool = True) -> DataFrame:
    """t, mw: what stood at the day's cut-off, held over the day."""
    days = hours.select(F.to_date("t").alias("day")).distinct()
    held = at_cutoffs(active(latest(docs, once)), days)
    return hours.withColumn("day", F.to_date("t")).join(held, "day", "left").select("t", F.coalesce("mw", F.lit(0.0)).alias("mw"))


def exact(versions: DataFrame, hours: DataFrame, once: bool = True) -> DataFrame:
    """t, mw: the version current at each day's cut-off, averaged over the day's hours.

    A version is current from its creation until a larger revision's, so it counts on one run of days: one clipped interval.
    """
    rows = versions.where(F.col("revision").isNotNull())
    rows = rows.dropDuplicates(["mrid", "revision", "start", "end"]) if once else rows
    larger = Window.partitionBy("mrid").orderBy(F.desc("revision")).rangeBetween(Window.unboundedPreceding, -1)
    rows = active(rows.withColumn("_until", F.min("created_doc_time").over(larger)))
    clipped = rows.withColumn("start", F.greatest(F.col("start"), day_from(F.col("created_doc_time")))).withColumn("end", F.least(F.col("end"), day_from(F.col("_until"))))
    got = hourly(clipped.where(F.col("created_doc_time").isNotNull() & (F.col("start") < F.col("end"))))
    return hours.join(got, "t", "left").select("t", F.coalesce("mw", F.lit(0.0)).alias("mw"))


def candidates(docs: DataFrame, renewable: list[str], *more: Column) -> DataFrame:
    """Documents whose revisions are worth fetching: several, and not of a wind or solar plant. more: further aggregates."""
    return docs.groupBy("mrid").agg(F.max("revision").alias("revision"), F.min_by("plant_type", F.struct("start", "revision")).alias("plant_type"), *more).where((F.col("revision") > 1) & ~F.col("plant_type").isin(renewable))
