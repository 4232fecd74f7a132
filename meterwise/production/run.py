"""The daily run: steps in order, each once a day and edition, optional ones fail softly and are tried again later."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.plans.site import edition_action
from meterwise.sources.tables import append_log, exists

LOG = logging.getLogger(__name__)
#: What no later step can outlive: the JVM is gone or memory is.
FATAL = (Py4JNetworkError, MemoryError)
KEPT = ("keep", "keep-late")
SCHEMA = "t timestamp_ntz, seq long, step string, edition string, state string, note string"


@dataclass(frozen=True)
class Step:
    """run(done) does the work; `done` holds the names of steps that stand. A required step's failure ends the run."""

    name: str
    run: Callable[[set[str]], None]
    needs: tuple[str, ...] = ()
    required: bool = False


def log_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("t", "seq", "step", "edition", "state", "note") if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def standing(log: DataFrame) -> DataFrame:
    """t (the delivery's midnight), step, edition, state: what was logged last."""
    return log.groupBy("t", "step").agg(F.max_by(F.struct("edition", "state"), "seq").alias("s")).select("t", "step", "s.edition", "s.state")


def run_day(spark: SparkSession, path: str, delivery: str, steps: list[Step], evening: bool = False, before_gate: bool = True) -> DataFrame:
    """Run the steps of a delivery day (yyyy-MM-dd) and return the day's log.

    A step that stands in this edition, or in the morning's, is kept; a morning run replaces an evening edition before
    the gate and leaves it (keep-late) after it. A step whose needs don't stand is skipped. Every outcome is one row of
    the log, so a later run picks up where this one failed.
    """
    day = F.lit(delivery).cast("date").cast("timestamp_ntz")
    old = log_of(spark, path).where(F.col("t") == day)
    last = old.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    have = {r["step"]: r["edition"] for r in standing(old).where("state = 'done'").collect()}  # one row a step
    exists_, was_evening = F.col("edition").isNotNull(), F.col("edition") == "evening"
    asked = spark.createDataFrame([(s.name, have.get(s.name)) for s in steps], "step string, edition string")
    action = {r["step"]: r["action"] for r in asked.select("step", edition_action(exists_, was_evening, F.lit(evening), F.lit(before_gate)).alias("action")).collect()}
    edition, done, rows = "evening" if evening else "morning", set(have), []
    add = lambda name, state, note: rows.append((delivery, last + 1 + sum(r[4] not in KEPT for r in rows), name, edition, state, note))
    for s in steps:
        state, note = action[s.name], ""
        if state in ("publish", "replace"):
            if set(s.needs) <= done:
                try:
                    s.run(set(done))
                    state = "done"
                    done.add(s.name)
                except FATAL:
                    raise
                except Exception as e:
                    LOG.exception("step %s of %s failed", s.name, delivery)
                    if s.required:
                        add(s.name, "failed", f"{type(e).__name__}: {e}")
                        _log(spark, [r for r in rows if r[4] not in KEPT], path)
                        raise
                    state, note = "failed", f"{type(e).__name__}: {e}"
            else:
                state, note = "skipped", "needs " + ", ".join(sorted(set(s.needs) - done))
        add(s.name, state, note)
    _log(spark, [r for r in rows if r[4] not in KEPT], path)
    return spark.createDataFrame([(*r,) for r in rows], "delivery string, seq long, step string, edition string, state string, note string")


def _log(spark: SparkSession, rows: list[tuple], path: str) -> None:
    if rows:
        df = spark.createDataFrame(rows, "delivery string, seq long, step string, edition string, state string, note string")
        append_log(df.withColumn("t", F.col("delivery").cast("date").cast("timestamp_ntz")).drop("delivery"), path)
