"""Calendar of the German market: holidays with the share of people they hold for, gates, local days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
# Fixed values: (month, day) or days after Easter Sunday, and the share of the population on holiday.
FIXED = [((1, 1), 1.0), ((1, 6), 0.32), ((3, 8), 0.06), ((5, 1), 1.0), ((8, 15), 0.09), ((9, 20), 0.03), ((10, 3), 1.0), ((10, 31), 0.31), ((11, 1), 0.57), ((12, 25), 1.0), ((12, 26), 1.0)]
MOVING = [(-2, 1.0), (1, 1.0), (39, 1.0), (50, 1.0), (60, 0.64)]
REPENTANCE = 0.05


def easter(year: int) -> date:
    """Easter Sunday of the Gregorian calendar: the Sunday after the ecclesiastical full moon."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= (epact == 29) + (epact == 28 and golden > 10)
    moon = date(year, 3, 21) + timedelta(days=epact)
    return moon + timedelta(days=7 - (moon.weekday() + 1) % 7)


def holidays(first: int, last: int) -> dict[date, float]:
    """Every holiday of the years; of two on one day the later named counts."""
    out: dict[date, float] = {}
    for year in range(first, last + 1):
        sunday = easter(year)
        out |= {date(year, m, d): share for (m, d), share in FIXED}
        out |= {sunday + timedelta(days=k): share for k, share in MOVING}
        wednesday = date(year, 11, 22)
        while wednesday.weekday() != 2:
            wednesday -= timedelta(days=1)
        out[wednesday] = REPENTANCE
    return out


def holiday_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    """day, share: a dimension of some 17 rows a year."""
    return spark.createDataFrame(sorted(holidays(first, last).items()), "day date, share double")


def local(t: Column | str) -> Column:
    """Wall clock in Berlin of a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col(t) if isinstance(t, str) else t)


def to_utc(t: Column) -> Column:
    return F.convert_timezone(F.lit(ZONE), F.lit("UTC"), t)


def with_holiday_share(df: DataFrame, table: DataFrame, offset_days: int = 0, name: str = "share") -> DataFrame:
    """The share of the local day of t + offset, counted in absolute days of 24 hours after the change to local time."""
    instant = local(F.col("t") + F.expr(f"INTERVAL {24 * offset_days} HOURS"))
    dim = F.broadcast(table.select(F.col("day").alias("_d"), F.col("share").alias(name)))
    return df.withColumn("_d", F.to_date(instant)).join(dim, "_d", "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop("_d")


def gate(day: Column) -> Column:
    """The instant (UTC) at which bids for a delivery day close: noon in Berlin on the day before."""
    noon = F.make_timestamp_ntz(F.year(F.date_sub(day, 1)), F.month(F.date_sub(day, 1)), F.day(F.date_sub(day, 1)), F.lit(12), F.lit(0), F.lit(0))
    return to_utc(noon)


def day_length(day: Column) -> Column:
    """Hours of a local day: 23, 24 or 25."""
    midnight = lambda d: to_utc(F.make_timestamp_ntz(F.year(d), F.month(d), F.day(d), F.lit(0), F.lit(0), F.lit(0)))
    return F.timestamp_diff("HOUR", midnight(day), midnight(F.date_add(day, 1)))


def bridge_flags(days: DataFrame, table: DataFrame) -> DataFrame:
    """Of a dense table of days: weekend, holiday (share 1), off, off yesterday and tomorrow, bridge (a working day between two off)."""
    dim = F.broadcast(table.where("share = 1").select("day", F.lit(True).alias("_h")))
    out = days.join(dim, "day", "left").select("day", (F.weekday("day") >= 5).alias("weekend"), F.coalesce("_h", F.lit(False)).alias("holiday"))
    out = out.withColumn("off", F.col("weekend") | F.col("holiday"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # a calendar: some 365 rows a year
    out = out.withColumn("off_before", F.coalesce(F.lag("off").over(w), F.lit(False))).withColumn("off_after", F.coalesce(F.lead("off").over(w), F.lit(False)))
    return out.withColumn("bridge", ~F.col("off") & F.col("off_before") & F.col("off_after"))
