"""Boosted regression trees for many targets and periods at once, as a table of fitted trees.

A model belongs to a target and a period (a month, say) and learns from the rows of the periods before it. Rows are dealt by
(target, period): each goes to the periods that learn from it, `reach` at most, so a group is one model's window whatever the
history. The fit is on histograms of at most `bins` values a feature, and trees are complete to a fixed depth, so a model is a
few arrays, kept in a row of its own. Serving cogroups the rows that ask with their model; nothing passes through the driver.

A missing feature (null) goes to the side of a split where it does better in training. Rows without a target aren't learned from.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("feature", "threshold", "missing_left", "leaf", "base")


class Trees:
    def __init__(self, rounds: int = 100, rate: float = 0.1, depth: int = 5, bins: int = 64, least: int = 20):
        self.rounds, self.rate, self.depth, self.bins, self.least = rounds, rate, depth, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [_cuts(x[:, f], self.bins) for f in range(x.shape[1])]
        codes = np.stack([np.where(np.isnan(x[:, f]), self.bins, np.searchsorted(e, x[:, f], "left")) for f, e in enumerate(edges)])
        inner, n = 2**self.depth - 1, len(y)
        self.feature, self.threshold = np.zeros((self.rounds, inner), np.int32), np.full((self.rounds, inner), np.inf)
        self.missing_left, self.leaf = np.ones((self.rounds, inner), bool), np.zeros((self.rounds, inner + 1))
        self.base = np.array([y.mean()])
        rest = y - self.base[0]
        for r in range(self.rounds):
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = self._splits(codes, rest, node, width)
                for k, (gain, f, cut, missing_left) in enumerate(best):
                    if gain > 1e-12 and cut < len(edges[f]):
                        self.feature[r, first + k], self.threshold[r, first + k], self.missing_left[r, first + k] = f, edges[f][cut], missing_left
                node = self._step(x, r, first, node)
            count = np.bincount(node, minlength=inner + 1)
            self.leaf[r] = self.rate * np.bincount(node, rest, inner + 1) / np.maximum(count, 1)
            rest = rest - self.leaf[r][node]
        return self

    def _splits(self, codes: np.ndarray, rest: np.ndarray, node: np.ndarray, width: int) -> list[tuple[float, int, int, bool]]:
        """For each node of a level the best (gain, feature, cut, where missing values go)."""
        b, best = self.bins + 1, [(0.0, 0, 1 << 30, True)] * width
        for f, code in enumerate(codes):
            at = node * b + code
            count = np.bincount(at, minlength=width * b).reshape(width, b).astype(float)
            total = np.bincount(at, rest, width * b).reshape(width, b)
            n, s = count.sum(1, keepdims=True), total.sum(1, keepdims=True)
            left_n, left_s = np.cumsum(count[:, :-1], 1), np.cumsum(total[:, :-1], 1)
            for missing_left in (True, False):
                ln, ls = (left_n + count[:, -1:], left_s + total[:, -1:]) if missing_left else (left_n, left_s)
                rn, rs = n - ln, s - ls
                gain = ls**2 / np.maximum(ln, 1) + rs**2 / np.maximum(rn, 1) - s**2 / np.maximum(n, 1)
                gain[(ln < self.least) | (rn < self.least)] = -1.0
                cut = gain.argmax(1)
                for k in range(width):
                    if gain[k, cut[k]] > best[k][0] + 1e-12:
                        best[k] = float(gain[k, cut[k]]), f, int(cut[k]), missing_left
        return best

    def _step(self, x: np.ndarray, r: int, first: int, node: np.ndarray) -> np.ndarray:
        at = first + node
        value = x[np.arange(len(x)), self.feature[r, at]]
        left = np.where(np.isnan(value), self.missing_left[r, at], value <= self.threshold[r, at])
        return 2 * node + ~left

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base[0])
        for r in range(len(self.leaf)):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = self._step(x, r, 2**level - 1, node)
            out += self.leaf[r][node]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{p: getattr(self, p) for p in PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Trees:
        out = cls()
        with np.load(io.BytesIO(data)) as f:
            for p in PARTS:
                setattr(out, p, f[p])
        out.depth = int(np.log2(out.leaf.shape[1]))
        return out


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Values between which a feature may be split: all of them where they are few, else quantiles."""
    have = np.unique(values[~np.isnan(values)])
    if len(have) > bins:
        have = np.unique(np.quantile(values[~np.isnan(values)], np.arange(1, bins) / bins))
        return have
    return (have[1:] + have[:-1]) / 2


def period_of(t: Column, unit: str) -> Column:
    return F.date_trunc(unit, t).cast("date")


def fitted(rows: DataFrame, asked: DataFrame, unit: str = "month", reach: int = 24, gap: str = "0 HOURS", least_rows: int = 50, **how) -> DataFrame:
    """target, period, n, trees: a model for each asked (target, period).

    rows: target, t, x array<double>, y. A model learns from rows of `reach` periods before its own, up to `gap` before its start.
    A model of fewer than `least_rows` rows is left out.
    """
    known = rows.where(F.col("y").isNotNull()).select("target", "t", "x", "y")
    step = F.expr(f"INTERVAL 1 {unit}")
    own = period_of(F.col("t"), unit)
    known = known.withColumn("period", F.explode(F.sequence(own, (own + step * reach).cast("date"), step)))
    # the gap may reach beyond the start of the period, so a row's own period is among those looked at
    known = known.where(F.col("t") < F.col("period").cast("timestamp_ntz") - F.expr(f"INTERVAL {gap}"))
    known = known.join(asked.select("target", "period").distinct(), ["target", "period"], "left_semi")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"target": pdf.target.iloc[:1], "period": pdf.period.iloc[:1], "n": len(pdf)}
        if len(pdf) < least_rows:
            return pd.DataFrame(out).head(0).assign(trees=[])
        pdf = pdf.sort_values("t", kind="stable")
        return pd.DataFrame(out).assign(trees=[Trees(**how).fit(np.array(pdf.x.tolist(), float), pdf.y.to_numpy(float)).to_bytes()])

    return known.groupBy("target", "period").applyInPandas(solve, "target string, period date, n long, trees binary")


def served(ask: DataFrame, models: DataFrame, unit: str = "month") -> DataFrame:
    """target, t, pred of each row of ask (target, t, x) whose target and period have a model."""

    def predict(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = rows[["target", "t"]]
        if not len(own) or not len(rows):
            return out.head(0).assign(pred=[])
        return out.assign(pred=Trees.from_bytes(own.trees.iloc[0]).predict(np.array(rows.x.tolist(), float)))

    rows = ask.select("target", "t", "x", period_of(F.col("t"), unit).alias("period"))
    return rows.groupBy("target", "period").cogroup(models.groupBy("target", "period")).applyInPandas(predict, "target string, t timestamp_ntz, pred double")
