"""Time-series building blocks. A series is rows (keys..., t TIMESTAMP_NTZ, value columns).

Windows are always keyed by the series, so one long table of many series is many tasks. NaN is not used: missing is
null. Lags are by time on a dense spine, never by position on a table with holes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trunc(unit: str, t: Column | str) -> Column:
    """date_trunc that keeps TIMESTAMP_NTZ."""
    return F.date_trunc(unit, t).cast("timestamp_ntz")


def stamp(t: Column | str) -> Column:
    """A timestamp as text, alike in every engine."""
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def mean_by(df: DataFrame, unit: str, value: str, keys: list[str], t: str = "ts") -> DataFrame:
    """Mean of each bucket that has rows: keys, t, v."""
    return df.groupBy(*keys, trunc(unit, t).alias("t")).agg(F.avg(value).alias("v"))


def spine(df: DataFrame, keys: list[str], step: str = "1 hour", own: bool = False) -> DataFrame:
    """Every step from the first to the last t (of each key if `own`, else of the whole table) for every key."""
    ends = df.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi")) if own and keys else df.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    steps = ends.select(*(keys if own else []), F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("t"))
    # one row per series beside a calendar: both small next to the data
    return steps if own or not keys else df.select(*keys).distinct().crossJoin(F.broadcast(steps)) if keys else steps


def dense(df: DataFrame, keys: list[str], step: str = "1 hour") -> DataFrame:
    """df with a row for every step; missing values are null."""
    return spine(df, keys, step).join(df, [*keys, "t"], "left")


def _rows(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*(order or ("t",)))


def _ahead(keys: list[str]):
    """This row and those after it, in descending order: a frame that grows row by row, where one that shrinks from an
    unbounded end would be gone through anew for each row."""
    return _rows(keys, F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)


def ffill(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    w = _rows(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_edges(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Forward, then backward for what has nothing before it."""
    before = _rows(keys).rowsBetween(Window.unboundedPreceding, 0)
    after = _ahead(keys)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.last(c, ignorenulls=True).over(after)) for c in cols})


def interpolate(df: DataFrame, col: str, keys: list[str], hold_left: bool = False, hold_right: bool = True) -> DataFrame:
    """Nulls between anchors are linear in time; before the first and after the last anchor null or held."""
    before = _rows(keys).rowsBetween(Window.unboundedPreceding, 0)
    after = _ahead(keys)
    at = F.when(F.col(col).isNotNull(), F.struct(F.unix_micros(F.col("t").cast("timestamp")).alias("x"), F.col(col).alias("y")))
    df = df.withColumn("_a", F.last(at, ignorenulls=True).over(before)).withColumn("_b", F.last(at, ignorenulls=True).over(after))
    x = F.unix_micros(F.col("t").cast("timestamp"))
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * ((x - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x")))
    out = F.when(F.col("_a").isNull(), F.col("_b.y") if hold_left else F.lit(None).cast("double")).when(F.col("_b").isNull(), F.col("_a.y") if hold_right else F.lit(None).cast("double"))
    return df.withColumn(col, out.when(F.col("_a.x") == F.col("_b.x"), F.col("_a.y")).otherwise(line)).drop("_a", "_b")


def lag(col: str, steps: int, keys: list[str]) -> Column:
    """Positional lag; a lag in time where the table is dense."""
    return F.lag(col, steps).over(_rows(keys))


def time_lag(df: DataFrame, cols: dict[str, str], interval: str, keys: list[str]) -> DataFrame:
    """Columns of the row `interval` before, whatever rows are missing between: an equi join on the shifted time."""
    past = df.select(*keys, (F.col("t") + F.expr(f"INTERVAL {interval}")).alias("t"), *[F.col(a).alias(b) for a, b in cols.items()])
    return df.join(past, [*keys, "t"], "left")


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the largest `order` for each key; the order must be total."""
    return _one(df, keys, F.max_by, order)


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _one(df, keys, F.min_by, order)


def _one(df: DataFrame, keys: list[str], best, order: tuple[str, ...]) -> DataFrame:
    """An aggregate, so rows combine before the shuffle; null sorts below all."""
    row = best(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in order])).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def islands(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days: keys, first_day, last_day, n_days."""
    n = F.row_number().over(_rows(keys, day))
    runs = df.withColumn("_run", F.date_sub(day, n))
    return runs.groupBy(*keys, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days")).drop("_run")


def whole_days(df: DataFrame, keys: list[str], cols: list[str], steps: int = 24) -> DataFrame:
    """Rows of the days on which all `steps` rows have all columns."""
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    w = Window.partitionBy(*keys, F.to_date("t"))
    return df.withColumn("_n", F.count_if(full).over(w)).where(F.col("_n") == steps).drop("_n")


def steps_per_day(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, steps: a day by the least spacing of t; 24 where there are fewer than two rows."""
    gap = F.timestamp_diff("SECOND", F.lag("t").over(_rows(keys)), F.col("t"))
    return df.select(*keys, gap.alias("_s")).groupBy(*keys).agg(F.coalesce(F.floor(86_400 / F.min("_s")), F.lit(24)).cast("long").alias("steps"))


def trailing(value: Column, keys: list[str], first: int, last: int, day: str = "day") -> Column:
    """An aggregate over the days from `first` to `last` days before, by calendar."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(-first, -last)
    return value.over(w)


def running_sum(df: DataFrame, col: str, name: str, unit: str = "month") -> DataFrame:
    """df (t not null, distinct) with `name`, the sum of col up to each row in order of t.

    Each unit of time is summed apart, from the total of the units before it: one row for each unit, so it can be broadcast.
    """
    x = df.withColumn("_b", trunc(unit, "t"))
    before = Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("_b").agg(F.sum(col).alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(F.broadcast(starts), "_b").withColumn(name, F.col("_o") + F.coalesce(F.sum(col).over(inside), F.lit(0))).drop("_b", "_o")


def bounds_below(bounds: list, x: Column, kind: str, equal: bool = False) -> Column:
    """How many of the sorted bounds are less than x (or equal to it). Null has none below it.

    The heads of runs of bounds come first, then one run: a row meets two times the root of all bounds, not each of them.
    """
    if not bounds:
        return F.lit(0)
    k = math.isqrt(len(bounds) - 1) + 1
    array = lambda values: F.array(*[F.lit(b).cast(kind) for b in values])
    count = lambda values: F.size(F.filter(values, (lambda b: b <= x) if equal else (lambda b: b < x)))
    head = count(array(bounds[::k]))
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * k + count(F.slice(array(bounds), (head - 1) * k + 1, F.lit(k)))).cast("int")


def ranked(df: DataFrame, col: str, *ties: str, name: str = "n", cuts: int = 256) -> tuple[DataFrame, int]:
    """df with `name`, its place (from 1) in order of a numeric col (not null) and ties, and the number of rows.

    Rows fall into ranges cut at quantiles; each range is numbered apart, from the rows in the ranges before it.
    """
    got = df.agg(F.percentile_approx(col, [i / cuts for i in range(1, cuts)], 100 * cuts), F.count("*")).first()
    rows = df.withColumn("_r", bounds_below(sorted(set(got[0] or [])), F.col(col), "double"))
    before = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_r").agg(F.count("*").alias("_c")).select("_r", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(col, *ties))
    return rows.join(F.broadcast(starts), "_r").withColumn(name, F.col("_o") + inside).drop("_r", "_o"), got[1]


def tile_of(n: Column, total: int, tiles: int) -> Column:
    """The tile (from 1) of the n-th of `total` rows, sizes at most one apart, larger ones first."""
    size, more = divmod(total, tiles)
    late = F.lit(more + 1) + F.floor((n - more * (size + 1) - 1) / max(size, 1))
    return F.when(n <= more * (size + 1), F.floor((n - 1) / (size + 1)) + 1).otherwise(late).cast("long")


def hsum(cols: list[str], least: int | None = None) -> Column:
    """Sum across columns: null unless `least` of them are there; None: missing counts as nothing, all missing as 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    if least is None:
        return total
    there = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])
    return F.when(there >= least, total)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep null (least and greatest alone would skip it)."""
    out = x
    out = out if low is None else F.greatest(out, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)
