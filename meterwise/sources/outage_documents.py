"""Nested outage documents (XML or JSON) to flat rows, by a schema; documents that don't fit it are kept apart.

A document has time series, a series available periods, and a period points: quantities from a position on, in steps of the
period's resolution. A point holds until the next one or the period's end. So a row is a document's version and one segment of
available quantity, with 15 columns.

Bad documents: text that can't be parsed, or lacks an id, a whole revision number, a creation time or a series. Their text is
returned with what is wrong, never dropped; a good document's point without a number has null as its quantity. A document that
comes twice in the same words counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.sources.tables import scratch

#: The names of the format's elements.
RESOURCE = "production_RegisteredResource"
POINT = "struct<position:string,quantity:string>"
PERIOD = f"struct<timeInterval:struct<start:string,end:string>,resolution:string,Point:array<{POINT}>>"
NOMINAL = f"{RESOURCE}.pSRType.powerSystemResources.nominalP"
SERIES = (
    f"struct<businessType:string,`{RESOURCE}.mRID`:string,`{RESOURCE}.name`:string,`{RESOURCE}.pSRType.psrType`:string,"
    f"`{NOMINAL}`:string,`quantity_Measure_Unit.name`:string,Available_Period:array<{PERIOD}>>"
)
DOCUMENT = f"mRID string, revisionNumber string, createdDateTime string, docStatus struct<value:string>, TimeSeries array<{SERIES}>, _corrupt string"
COLUMNS = (
    "zone", "mrid", "revision", "created_doc_time", "docstatus", "businesstype", "plant_type", "production_resource_id",
    "production_resource_name", "nominal_power", "start", "end", "resolution", "avail_qty", "qty_uom",
)


def schema(kind: str) -> T.StructType:
    """The documents' schema; in XML the nominal power is an element with a unit, so a struct of its own."""
    ddl = DOCUMENT.replace(f"`{NOMINAL}`:string", f"`{NOMINAL}`:struct<_VALUE:string,_unit:string>") if kind == "xml" else DOCUMENT
    return T.StructType.fromDDL(ddl)


def number(x: Column) -> Column:
    return x.try_cast("double")


def minutes(resolution: Column) -> Column:
    """PT15M, PT1H, P1D and the like; null for others."""
    part = lambda pattern: F.regexp_extract(resolution, pattern, 1).try_cast("int")
    return F.coalesce(part(r"^PT(\d+)M$"), part(r"^PT(\d+)H$") * 60, part(r"^P(\d+)D$") * 1440)


def moment(x: Column) -> Column:
    """ISO 8601 with a zone, with or without seconds, as UTC without a zone."""
    whole = F.regexp_replace(x, r"(T\d\d:\d\d)(Z|[+-]\d\d:?\d\d)?$", "$1:00$2")
    return F.try_to_timestamp(whole).cast("timestamp_ntz")


def points(period: Column) -> Column:
    """at, q of a period's points in order of their position; those without a position are left out."""
    placed = F.transform(period["Point"], lambda p: F.struct(p["position"].try_cast("int").alias("at"), p["quantity"].alias("q")))
    return F.array_sort(F.filter(placed, lambda p: p["at"].isNotNull()))


def segments(points: Column, begin: Column, end: Column, step: Column) -> Column:
    """start, end, quantity of each point of a period; all four are columns, since a lambda works its expressions out for each point."""
    at = lambda p: begin + F.make_dt_interval(mins=(p["at"] - 1) * step)
    until = lambda i: F.when(i + 1 < F.size(points), at(F.get(points, i + 1))).otherwise(end)
    return F.transform(points, lambda p, i: F.struct(at(p).alias("start"), until(i).alias("end"), number(p["q"]).alias("q")))


def parsed(docs: DataFrame, kind: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(rows of COLUMNS, bad documents: zone, value, reason). docs: zone, value (text of one document). The session's time zone
    must be UTC.

    Each text is parsed once: the parsed documents are written to the shared folder and both results read them there. As one
    plan every condition and field would parse the text anew.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = F.from_xml if kind == "xml" else F.from_json
    x = docs.select("zone", "value").dropDuplicates().withColumn("d", read("value", schema(kind), options))
    d = F.col("d")
    reason = (
        F.when(F.col("value").isNull() | d.isNull() | d["_corrupt"].isNotNull(), "not a document")
        .when(d["mRID"].isNull() | (F.trim(d["mRID"]) == ""), "no id")
        .when(d["revisionNumber"].try_cast("long").isNull(), "no revision")
        .when(moment(d["createdDateTime"]).isNull(), "no creation time")
        .when(d["TimeSeries"].isNull() | (F.size(d["TimeSeries"]) == 0), "no series")
    )
    path = scratch(docs.sparkSession)
    x.withColumn("reason", reason).select("zone", "d", "reason", F.when(F.col("reason").isNotNull(), F.col("value")).alias("value")).write.parquet(path)
    x = docs.sparkSession.read.parquet(path)
    bad = x.where("reason is not null").select("zone", "value", "reason")
    series = x.where("reason is null").select("zone", F.col("d.mRID").alias("mrid"), d["revisionNumber"].try_cast("long").alias("revision"), moment(d["createdDateTime"]).alias("created_doc_time"), F.col("d.docStatus.value").alias("docstatus"), F.explode("d.TimeSeries").alias("s"))
    s = F.col("s")
    power = s[NOMINAL]["_VALUE"] if kind == "xml" else s[NOMINAL]
    periods = series.select("*", F.explode(F.coalesce(s["Available_Period"], F.array())).alias("p"))
    p = F.col("p")
    timed = periods.select("*", points(p).alias("points"), moment(p["timeInterval"]["start"]).alias("begin"), moment(p["timeInterval"]["end"]).alias("until"), minutes(p["resolution"]).alias("step"))
    cut = timed.select("*", F.explode(segments(*map(F.col, ("points", "begin", "until", "step")))).alias("g"))
    rows = cut.select(
        "zone", "mrid", "revision", "created_doc_time", "docstatus", s["businessType"].alias("businesstype"), s[f"{RESOURCE}.pSRType.psrType"].alias("plant_type"),
        s[f"{RESOURCE}.mRID"].alias("production_resource_id"), s[f"{RESOURCE}.name"].alias("production_resource_name"), number(power).alias("nominal_power"),
        F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("p.resolution").alias("resolution"), F.col("g.q").alias("avail_qty"), s["quantity_Measure_Unit.name"].alias("qty_uom"),
    )
    return rows, bad
