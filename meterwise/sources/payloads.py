"""Raw payloads to series: JSON pairs and parallel arrays, localised CSV, documents with bad numbers, index lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.timekit import trunc


def null_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, k in df.dtypes if k in ("double", "float")})


def utc(t: Column) -> Column:
    """An instant as UTC wall clock without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))


def pairs(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """{"series": [[milliseconds, value or null], ...]}: t, v without null values."""
    parsed = F.from_json(payload, "series array<array<double>>")
    rows = df.select(*(keep or []), F.explode(parsed["series"]).alias("_p"))
    rows = rows.select(*(keep or []), F.timestamp_millis(F.element_at("_p", 1).cast("long")).alias("t"), F.element_at("_p", 2).alias("v"))
    return rows.where("v is not null").withColumn("t", utc(F.col("t")))


def parallel(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """{"unix_seconds": [...], "price": [...]}: t, v at full quarters of an hour."""
    parsed = F.from_json(payload, "unix_seconds array<bigint>, price array<double>")
    rows = df.select(*(keep or []), F.explode(F.arrays_zip(parsed["unix_seconds"].alias("s"), parsed["price"].alias("v"))).alias("_p"))
    rows = rows.select(*(keep or []), utc(F.timestamp_seconds("_p.s")).alias("t"), F.col("_p.v").alias("v"))
    return rows.where(F.minute("t") % 15 == 0)


def hourly_of(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return df.where("v is not null").groupBy(*(keep or []), trunc("hour", "t").alias("t")).agg(F.avg("v").alias("v"))


def gw_by_month(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Labels MM.yyyy and GW to month starts and MW; months without any value go."""
    out = df.select(F.to_date(label, "MM.yyyy").cast("timestamp_ntz").alias("t"), *[(F.col(v) * 1000.0).alias(f"{v}_mw") for v in values])
    return out.dropna("all", subset=[f"{v}_mw" for v in values])


def german_csv(lines: DataFrame, header: list[str], line: str = "value") -> DataFrame:
    """Lines with semicolons and decimal commas: t from Datum and von, and the columns named with (MW)."""
    cells = F.split(line, ";")
    cell = lambda name: F.element_at(cells, header.index(name) + 1)
    t = F.to_timestamp_ntz(F.concat_ws(" ", cell("Datum"), cell("von")), F.lit("dd.MM.yyyy HH:mm"))
    number = lambda name: F.regexp_replace(F.regexp_replace(cell(name), r"\.", ""), ",", ".").try_cast("double")
    return lines.where(~F.col(line).startswith("Datum;") & (F.col(line) != "")).select(t.alias("t"), *[number(h).alias(h) for h in header if "(MW)" in h])


def settlements(new: DataFrame, old: DataFrame, keys: list[str], values: dict[str, list[str]]) -> DataFrame:
    """New daily prices over old ones; a value is the first there is of its listings, and a missing one never wipes an old one."""
    fresh = new.select(*keys, *[reduce(lambda a, b: F.coalesce(a, b), [F.col(c) for c in listings]).alias(f"_{name}") for name, listings in values.items()])
    return old.join(fresh, keys, "full_outer").select(*keys, *[F.coalesce(f"_{n}", n).alias(n) for n in values])


def past_days(df: DataFrame, today: Column, done: DataFrame | None = None) -> DataFrame:
    """Rows of complete past days that are not archived yet."""
    out = df.withColumn("day", F.to_date("t")).where(F.col("day") < today)
    return out if done is None else out.join(done, "day", "left_anti")


def tidy_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to numbers; what is none becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def merged_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges [start, end) where one begins exactly at another's end become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    rows = df.withColumn("_new", (F.coalesce(F.lag(end).over(w), F.lit(-1)) != F.col(start)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def wanted_lines(lines: DataFrame, params: list[str], line: str = "value") -> DataFrame:
    """JSON index lines of surface fields: param, start, end of the bytes to fetch."""
    x = F.from_json(line, "param string, levtype string, _offset bigint, _length bigint")
    rows = lines.select(x.alias("x")).where(F.col("x.param").isin(params) & (F.col("x.levtype") == "sfc"))
    return rows.select("x.param", F.col("x._offset").alias("start"), (F.col("x._offset") + F.col("x._length")).alias("end"))


def month_chunks(df: DataFrame, start: str, end: str, keep: list[str]) -> DataFrame:
    """[a, b) chunks of a range by calendar month."""
    firsts = F.sequence(F.to_date(F.date_trunc("month", start)), F.to_date(end), F.expr("INTERVAL 1 MONTH"))
    rows = df.select(*keep, start, end, F.explode(firsts).alias("_m"))
    rows = rows.select(*keep, F.greatest(F.to_date(start), F.col("_m")).alias("a"), F.least(F.to_date(end), F.add_months("_m", 1)).alias("b"))
    return rows.where("a < b")


def flat_names(names: list[tuple[str, ...] | str]) -> list[str]:
    """Headers of several levels to one: parts joined by ' / ', empty parts left out."""
    return [n if isinstance(n, str) else " / ".join(p for p in n if p) for n in names]
