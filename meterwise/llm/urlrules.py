"""URL filters by a sort-merge range join over reversed-host keys.

A host becomes its labels in reverse order, each closed by a dot (`news.example.net` -> `net.example.news.`), so a
rule for a host and all its subdomains is an interval of keys. Rules and URLs are dealt by ranges of that key and
sorted; one sweep per range keeps the stack of rules whose interval is open. Intervals are nested or apart, so the
innermost rules are on top; a rule also asks that the URL's path starts with its own.

The longest rule wins: most host labels first, then the longest path; of rules alike in both, the verdict that sorts
first. Without a fitting rule the verdict is `default`.

Nulls: a null URL, or one without `://`, has an empty host and path and no rule. Rules with a null host or path
never fit; an empty rule host fits every host. A hot host is dealt over all ranges that its quantiles fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions.timekit import bounds_below
from meterwise.llm.common import cut, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def parse(url):
    """Host and path columns of a URL column; both empty for null and for a URL without ://."""
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_key(host):
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Level:
    """The rules of one host: by path, each path once, and the lengths of paths, longest first."""

    def __init__(self, key: str):
        self.key, self.by_path, self.lengths = key, {}, None

    def add(self, path: str, rule: str, verdict: str) -> None:
        last = self.by_path.get(path)
        if last is None or (verdict, rule) < (last[1], last[0]):
            self.by_path[path] = rule, verdict
        self.lengths = None

    def longest(self, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest path that the given one starts with: a look-up for each length."""
        if self.lengths is None:
            self.lengths = sorted(set(map(len, self.by_path)), reverse=True)
        return next((self.by_path[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.by_path), None)


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (range, key, rules first); the stack holds the open hosts' rules, innermost on top."""
    at, stack = None, []
    for rows in batches:
        out = []
        for i, (rng, key, kind, path, rule, verdict) in enumerate(rows[["rng", "key", "kind", "path", "rule", "verdict"]].itertuples(index=False)):
            if rng != at:
                at, stack = rng, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(Level(key))
                stack[-1].add(path, rule, verdict)
                continue
            found = next((hit for level in reversed(stack) if (hit := level.longest(path))), None) if key else None
            out.append((i, *(found or (None, None))))
        if out:
            idx, rule, verdict = zip(*out, strict=True)
            got = rows.iloc[list(idx)]
            yield pd.DataFrame({"page_id": got.page_id, "host": got.host, "path": got.path, "rule": list(rule), "verdict": list(verdict)})


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules: host, path, verdict."""
    spark = pages.sparkSession
    host, path = parse(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    n = partitions(spark)
    bounds = _bounds(urls, n)
    below = lambda key: bounds_below(bounds, key, "string")
    upto = lambda key: bounds_below(bounds, key, "string", equal=True)
    # equal keys may go to any range whose bounds they meet; so one host is never one task
    lo, hi = below(F.col("key")), upto(F.col("key"))
    urls = urls.select(
        (lo + F.pmod(F.xxhash64("page_id"), hi - lo + 1)).cast("int").alias("rng"), "key", F.lit(1).alias("kind"), F.col("page_id").cast("string").alias("page_id"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).distinct().withColumn("key", host_key(F.col("host")))
    rules = rules.select(
        F.explode(F.sequence(below(F.col("key")), upto(F.concat("key", F.lit(LAST))))).alias("rng"), "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("page_id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    dealt = rules.unionByName(urls).repartition(n, "rng").sortWithinPartitions("rng", "key", "kind")
    out = dealt.mapInPandas(_sweep, "page_id string, host string, path string, rule string, verdict string")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _bounds(urls: DataFrame, n: int) -> list[str]:
    """n - 1 keys (repeats included) that cut the URLs into ranges of about equal counts.

    From a sketch whose size depends on n alone: the heaviest keys, and for the others a sample by hash.
    """
    counted = cut(urls.groupBy("key").count())  # the URLs are read once for it
    heavy = {r[0]: r[1] for r in counted.orderBy(F.desc("count"), "key").limit(4 * n).collect()}
    light = {r[0]: r[1] for r in counted.orderBy(F.xxhash64("key"), "key").limit(64 * n).collect() if r[0] not in heavy}
    rest = counted.agg(F.sum("count")).first()[0] or 0
    scale = max(0, rest - sum(heavy.values())) / max(1, sum(light.values()))
    weights = heavy | {k: v * scale for k, v in light.items()}
    total = sum(weights.values())
    out, seen = [], 0.0
    for key in sorted(weights, key=lambda k: k.encode()):
        seen += weights[key]
        while len(out) < n - 1 and seen * n >= (len(out) + 1) * total:
            out.append(key)
    return out


def demo_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")], "host string, path string, verdict string")
