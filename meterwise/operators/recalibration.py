"""Exact quantiles over trailing days: the levels that recalibration serves.

A day asks for the values of the `window` days that end `lag` days before it. A key's days are cut into blocks as long as a
window reaches back, so what a day asks for lies in its own block and the one before, and each value is sent to two blocks,
however long the window is. In a block each day's values are one sorted run; from one day to the next the runs that come into
the window are merged into it and those that leave are taken out, and the levels are read off by rank.

A group is one key's two blocks: 2 x (window + lag - 1) days of values. Where those are more than `most` (counted first, over
keys and days alone), a key's windows are summed up by Spark's own exact percentile, which splits a window over tasks.

Null values and null days are left out; repeated values count each. A day that is asked for twice gets one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.quantiles import LEVELS

MOST = 1 << 23


def at_levels(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of sorted values, linear between ranks."""
    at = levels * (len(values) - 1)
    low = np.minimum(np.floor(at).astype(int), len(values) - 1)
    high = np.minimum(low + 1, len(values) - 1)
    return values[low] + (at - low) * (values[high] - values[low])


def with_run(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    return np.insert(values, np.searchsorted(values, run), run)


def without_run(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Each value of the run goes once."""
    again = np.arange(len(run)) - np.searchsorted(run, run)
    return np.delete(values, np.searchsorted(values, run) + again)


def sweep(days: np.ndarray, values: np.ndarray, asked: np.ndarray, window: int, lag: int, levels: np.ndarray) -> list[tuple[int, int, int, list[float]]]:
    """(day, values, days with values, quantiles) for each asked day that has any; all days are whole numbers."""
    order = np.lexsort((values, days))
    values = values[order]
    have, start = np.unique(days[order], return_index=True)
    runs = np.split(values, start[1:])
    held, first, end, out = np.zeros(0), 0, 0, []
    for day in np.unique(asked).tolist():
        while end < len(have) and have[end] <= day - lag:
            held, end = with_run(held, runs[end]), end + 1
        while first < end and have[first] <= day - lag - window:
            held, first = without_run(held, runs[first]), first + 1
        if len(held):
            out.append((day, len(held), end - first, at_levels(held, levels).tolist()))
    return out


def trailing_levels(values: DataFrame, asked: DataFrame, keys: list[str], window: int = 365, lag: int = 2, levels: list[float] = LEVELS, most: int = MOST) -> DataFrame:
    """keys, day, n, n_days, taus of each asked day (keys, day) whose window has values (keys, day, u)."""
    length = window + lag - 1
    no = F.datediff(F.col("day"), F.lit("1970-01-01"))
    block = F.floor(no / length).cast("int")
    known = values.where(F.col("u").isNotNull() & F.col("day").isNotNull()).select(*keys, no.alias("no"), block.alias("block"), F.col("u").cast("double").alias("u"))
    wanted = asked.where(F.col("day").isNotNull()).select(*keys, no.alias("no"), block.alias("block")).distinct()
    held = known.select(*keys, F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    large = held.groupBy(*keys, "block").count().where(F.col("count") > most).select(*keys).distinct()
    parts = []
    if large.isEmpty():
        small = known, wanted
    else:
        # at most one key for each `most` values
        same = lambda df: [df[k].eqNullSafe(large[k]) for k in keys]
        small = [df.join(F.broadcast(large), same(df), "left_anti") for df in (known, wanted)]
        back = F.explode(F.sequence(F.lit(lag), F.lit(lag + window - 1)))
        reach = wanted.join(F.broadcast(large), same(wanted), "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys], "no", back.alias("k"))
        found = known.withColumnRenamed("no", "past").join(reach.withColumn("past", F.col("no") - F.col("k")).withColumnRenamed("past", "_past"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("past") == F.col("_past")])
        exact = F.percentile("u", F.array(*[F.lit(x) for x in levels]))
        parts.append(found.groupBy(*keys, "no").agg(F.count("u").alias("n"), F.count_distinct("past").alias("n_days"), exact.alias("taus")))
    known, wanted = small
    both = known.select(*keys, "no", F.explode(F.array("block", F.col("block") + 1)).alias("block"), "u").unionByName(wanted.withColumn("u", F.lit(None).cast("double")))
    at = np.array(levels)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        no, u = pdf.no.to_numpy(), pdf.u.to_numpy()
        ask = np.isnan(u)
        rows = sweep(no[~ask], u[~ask], no[ask], window, lag, at)
        out = pd.DataFrame(rows, columns=["no", "n", "n_days", "taus"])
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "no", "n", "n_days", "taus"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*keys).schema)
    parts.append(both.groupBy(*keys, "block").applyInPandas(solve, f"{kinds}, no int, n long, n_days long, taus array<double>"))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return out.select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("no")).alias("day"), "n", "n_days", "taus")


def recalibration_levels(pits: DataFrame, days: DataFrame, keys: list[str], window_days: int = 365, min_days: int = 28) -> DataFrame:
    """keys, day, n_days, taus: the levels to serve on each day, from PITs of the days up to the second before it; with
    fewer than `min_days` of them taus is null."""
    got = trailing_levels(pits, days, keys, window_days)
    return got.select(*keys, "day", "n_days", F.when(F.col("n_days") >= min_days, F.col("taus")).alias("taus"))
