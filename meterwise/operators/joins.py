"""Joins in time, as plans without quadratic steps: as-of by one sort, ranges by buckets of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], order: str = "t") -> DataFrame:
    """left with each column's last non-null value of right at or before left's time.

    Both sides are unioned and sorted once by (keys, t, right first); rows of right at the same time should be unique.
    """
    struct = lambda: F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*keys, F.col(order).alias("_t"), F.lit(1).alias("_side"), struct().alias("_row"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in cols])
    b = right.select(*keys, F.col(order).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *[F.col(c).alias(f"_{c}") for c in cols])
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(w) for c in cols})
    return out.where("_side = 1").select("_row.*", *[F.col(f"_{c}").alias(c) for c in cols])


def coalescing(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer join; the left value where there is one, else the right."""
    r = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    return left.join(r, keys, "full_outer").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in cols])


def ladder(sources: list[DataFrame], keys: list[str], col: str) -> DataFrame:
    """keys, col and rung: the value of the first source (from 1) that has one."""
    tagged = [s.where(F.col(col).isNotNull()).select(*keys, F.struct(F.lit(i).alias("rung"), F.col(col).alias("v")).alias("_s")) for i, s in enumerate(sources, 1)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.min_by("_s", F.col("_s.rung")).alias("_s"))
    return best.select(*keys, F.col("_s.v").alias(col), F.col("_s.rung").cast("long").alias("rung"))


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


UNITS = {"hour": 3_600, "day": 86_400, "month": 30 * 86_400}


def blocks(first: Column, last: Column) -> Column:
    """Whole numbers first..last as blocks (level, number) of 2^level neighbours each: two for each level at most."""
    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")
        take = lambda odd, n: F.when((lo < hi) & (odd % 2 != 0), F.struct(level.alias("level"), n.alias("number")))
        return F.array(take(lo, lo), take(hi, hi - 1))

    top = F.ceil(F.log2((last - first + 2).cast("double"))).cast("int")
    return F.when(first <= last, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), of))))


def stab(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, bucket: str = "month") -> DataFrame:
    """Pairs with start <= point < end.

    Time is cut into buckets; the buckets that an interval touches are put together from blocks of 1, 2, 4, ... neighbours, so
    its rows grow with the logarithm of its length, and a point goes to the blocks that hold it, one of each size in use. So a
    long life costs a few rows, and what is joined on a block is what the sweep over it would have open.
    """
    seconds = UNITS[bucket]
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    alive = intervals.where(F.col(start) < F.col(end)).withColumns({"_s": number(start), "_e": number(end)})
    longest = alive.agg(F.max(F.col("_e") - F.col("_s"))).first()[0]
    levels = range((int(longest or 0) + 1).bit_length() + 1)
    spread = alive.withColumn("_k", F.explode(blocks(F.col("_s"), F.col("_e")))).drop("_s", "_e")
    held = F.array(*[F.struct(F.lit(j).alias("level"), F.shiftright(F.col("_n"), j).alias("number")) for j in levels])
    at = points.withColumn("_n", number(point)).withColumn("_k", F.explode(held)).drop("_n")
    both = spread.withColumns({"_l": F.col("_k.level"), "_b": F.col("_k.number")}).drop("_k").join(at.withColumns({"_l": F.col("_k.level"), "_b": F.col("_k.number")}).drop("_k"), ["_l", "_b"])
    return both.where((F.col(start) <= F.col(point)) & (F.col(end) > F.col(point))).drop("_l", "_b")


def overlap(intervals: DataFrame, start: str, end: str, unit: str = "hour") -> DataFrame:
    """A row for each unit of time an interval touches, with `share`, the part of the unit it covers.

    Bounds are taken to the full minute before.
    """
    seconds = {"hour": 3600, "day": 86400}[unit]
    a, b = (F.date_trunc("minute", c).cast("timestamp_ntz") for c in (start, end))
    df = intervals.withColumn("_a", a).withColumn("_z", b).where("_a < _z")
    last = F.col("_z") - F.expr("INTERVAL 1 MINUTE")
    cut = lambda c: F.date_trunc(unit, c).cast("timestamp_ntz")
    df = df.withColumn("t", F.explode(F.sequence(cut("_a"), cut(last), F.expr(f"INTERVAL 1 {unit}"))))
    ends = F.least("_z", F.col("t") + F.expr(f"INTERVAL 1 {unit}"))
    starts = F.greatest("_a", "t")
    return df.withColumn("share", F.timestamp_diff("SECOND", starts, ends) / float(seconds)).drop("_a", "_z")


def known_at(versions: DataFrame, cutoffs: DataFrame, key: list[str], created: str, revision: str, end: str) -> DataFrame:
    """For each day the rows of each key's largest revision among those created by the day's cut-off.

    cutoffs: day, cutoff (not after the day). A row counts from its creation until that of a larger revision, and no longer than
    the last end that any version of its key has (later days can't be touched). That is one interval for each row, which meets
    the cut-offs in it.
    """
    own = Window.partitionBy(*key)
    larger = own.orderBy(F.desc(revision)).rangeBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.to_date(F.max(end).over(own)), F.to_date(created))
    rows = versions.where(F.col(revision).isNotNull()).withColumns({"_last": last, "_until": F.min(created).over(larger)})
    rows = rows.withColumn("_to", F.least(F.coalesce("_until", F.lit("9999-01-01").cast("timestamp_ntz")).cast("timestamp_ntz"), F.date_add("_last", 1).cast("timestamp_ntz"))).withColumn("_from", F.col(created))
    met = stab(rows, cutoffs, "_from", "_to", "cutoff", "day")
    return met.where(F.col("day") <= F.col("_last")).drop("_last", "_until", "_to", "_from")


def override(base: DataFrame, other: DataFrame, keys: list[str], cols: list[str], when: Column) -> DataFrame:
    """base, with other's values where `when` holds and other has one."""
    o = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    out = base.join(o, keys, "left").withColumns({c: F.when(when, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in cols})
    return out.drop(*[f"_{c}" for c in cols])
