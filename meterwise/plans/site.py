"""What is published: which run stands, which mix may be used, and the documents of latest and past days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import quantiles as Q


def flag(c: str) -> Column:
    """A flag on rows older than the flag counts as false."""
    return F.coalesce(F.col(c), F.lit(False))


def edition_action(exists: Column, standing_evening: Column, run_evening: Column, before_gate: Column) -> Column:
    """What a run does with a day that may stand already: publish, replace (a morning over an evening edition before
    the gate), keep, or keep-late (the same after it)."""
    evening = F.coalesce(standing_evening, F.lit(False))
    return F.when(~exists, "publish").when(evening & ~F.coalesce(run_evening, F.lit(False)) & before_gate, "replace").when(evening & ~F.coalesce(run_evening, F.lit(False)), "keep-late").otherwise("keep")


def mix_stands(mix: DataFrame, nets: DataFrame) -> DataFrame:
    """Days of mixes made from the run that stands, with all 24 hours and 96 quarters."""
    runs = nets.groupBy("day").agg(F.max("generated_utc").alias("generated_utc"))
    counts = mix.groupBy("day", "nets_generated_utc", "components").agg(F.count_if(F.col("kind") == "h").alias("h"), F.count_if(F.col("kind") == "qh").alias("qh"))
    hit = counts.join(runs, (counts.day == runs.day) & (counts.nets_generated_utc == runs.generated_utc)).select(counts["*"])
    return hit.where("h = 24 and qh = 96").select("day", "components")


def mixed_rows(hours: DataFrame, other: DataFrame, quarters: DataFrame, components: str) -> DataFrame:
    """Rows kind, t, q of a mixed day: hours level by level, quarters moved with their hour.

    hours, other: t, q; quarters: t, q. Hours without a partner raise no row.
    """
    h = hours.join(other.select("t", F.col("q").alias("_o")), "t").withColumn("_m", Q.mix(F.col("q"), F.col("_o")))
    qh = quarters.select("t", F.date_trunc("hour", "t").cast("timestamp_ntz").alias("_h"), F.col("q").alias("_q")).join(h.select(F.col("t").alias("_h"), "q", "_m"), "_h")
    return h.select(F.lit("h").alias("kind"), "t", F.col("_m").alias("q")).unionByName(qh.select(F.lit("qh").alias("kind"), "t", Q.shifted(F.col("_q"), F.col("_m"), F.col("q")).alias("q"))).withColumn("components", F.lit(components))


def mix_logged(has_nets: Column, nets_evening: Column, has_other: Column, run_evening: Column) -> Column:
    """components (none, nets, both) and t0_missing of what a run logs: never a mix across editions, and the nets' own rows,
    flagged, where the other model is not there."""
    own = has_nets & (F.coalesce(nets_evening, F.lit(False)) == run_evening)
    return F.struct(F.when(~own, "none").when(has_other, "both").otherwise("nets").alias("components"), (own & ~has_other).alias("t0_missing"))


def served_mix(stands: Column, logged: Column, again: Column) -> Column:
    """q and source: the logged mix where it stands, else the one mixed again, else none (quarters are flat then)."""
    have = stands & logged.isNotNull()
    return F.struct(F.when(have, logged).otherwise(again).alias("q"), F.when(have, "logged").when(again.isNotNull(), "again").otherwise("flat").alias("source"))


def day_documents(log: DataFrame, levels: tuple[int, ...] = (1, 5, 10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """day, json: one document a day with nested hours; flags appear only if true. log: t, q, actual, evening."""
    point = F.struct(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), *[F.round(F.element_at("q", k), 2).alias(f"q{k:02d}") for k in levels], F.round("actual", 2).alias("actual"))
    days = log.groupBy(F.to_date("t").alias("day")).agg(F.array_sort(F.collect_list(point)).alias("hours"), F.bool_or(flag("evening")).alias("_e"))
    return days.select("day", F.to_json(F.struct(F.col("day").cast("string").alias("day"), F.when(F.col("_e"), True).alias("evening"), "hours"), {"ignoreNullFields": "true"}).alias("json"))


def merged_history(fresh: DataFrame, published: DataFrame, keep: int = 60) -> DataFrame:
    """The last `keep` days; a fresh document wins over a published one."""
    both = fresh.join(published.select("day", F.col("json").alias("_p")), "day", "full_outer").select("day", F.coalesce("json", "_p").alias("json"))
    return both.orderBy(F.desc("day")).limit(keep)
