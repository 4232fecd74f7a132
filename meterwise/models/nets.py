"""Small neural forecasters in numpy, an ensemble member for each Spark group.

A net has one hidden layer and, for each target (such as the hours of a day), the numbers of its head: `quantile` (a
median and cumulated positive steps to both sides, so levels never cross; pinball loss), `normal` (place and scale) and
`jsu` (Johnson's SU: place, scale, skew and tail); the last two by negative log likelihood. Adam, early stopping on the
last part of the training rows.

Fitting: a group is (key, head, seed) with the key's training window, whose length the caller states (`most` rows a
key at most, or an error). Predicting: the fitted members go to the rows, which are never grouped, as a broadcast of
checked size; beyond it rows and members of a key meet in one group.
"""

from __future__ import annotations

import io
import math
from collections import defaultdict
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.quantiles import LEVELS

LEVEL = np.array(LEVELS)
Z = np.array([NormalDist().inv_cdf(p) for p in LEVELS])
WIDTH = {"quantile": 99, "normal": 2, "jsu": 4}
LEAST_SCALE = 1e-3
MOST_ROWS = 1 << 17
BLOCK_ROWS = 64
BROADCAST_BYTES = 256 << 20


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Net:
    """x (rows, width) -> tanh layer -> head for each column of y; inputs and targets standardised by the training rows."""

    def __init__(self, head: str, seed: int, hidden: int = 24):
        self.head, self.seed, self.hidden = head, seed, hidden

    def _start(self, width: int, targets: int) -> None:
        rng = np.random.default_rng(self.seed)
        n = WIDTH[self.head]
        bias = np.full((targets, n), -2.0 if self.head == "quantile" else 0.0)
        if self.head == "quantile":
            bias[:, 49] = 0.0
        else:
            bias[:, 1] = bias[:, -1] = math.log(math.e - 1)  # scale and tail begin at one
        w1, w2 = rng.normal(0, 1 / math.sqrt(width), (width, self.hidden)), rng.normal(0, 0.1 / math.sqrt(self.hidden), (self.hidden, targets * n))
        self.params = [w1, np.zeros(self.hidden), w2, bias.ravel()]

    def _head(self, hidden: np.ndarray) -> np.ndarray:
        return (hidden @ self.params[2] + self.params[3]).reshape(len(hidden), -1, WIDTH[self.head])

    def _levels(self, o: np.ndarray) -> np.ndarray:
        """99 levels of each row and target."""
        if self.head == "quantile":
            mid, up, down = o[..., 49:50], np.cumsum(softplus(o[..., 50:]), -1), np.cumsum(softplus(o[..., 48::-1]), -1)
            return np.concatenate([(mid - down)[..., ::-1], mid, mid + up], -1)
        place, scale = o[..., :1], softplus(o[..., 1:2]) + LEAST_SCALE
        if self.head == "normal":
            return place + scale * Z
        return place + scale * np.sinh((Z - o[..., 2:3]) / (softplus(o[..., 3:]) + LEAST_SCALE))

    def _loss(self, o: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its slope by the head's numbers."""
        d, n = np.zeros_like(o), y.size
        if self.head == "quantile":
            e = y[..., None] - self._levels(o)
            g = -(LEVEL - (e < 0)) / (n * len(LEVEL))  # by each level
            d[..., 49] = g.sum(-1)
            d[..., 50:] = np.cumsum(g[..., :49:-1], -1)[..., ::-1] * sigmoid(o[..., 50:])
            d[..., :49] = -np.cumsum(g[..., :49], -1) * sigmoid(o[..., :49])
            return float(np.maximum(LEVEL * e, (LEVEL - 1) * e).mean()), d
        scale = softplus(o[..., 1]) + LEAST_SCALE
        z = (y - o[..., 0]) / scale
        if self.head == "normal":
            loss, by_z = np.log(scale) + z * z / 2, z
        else:
            # a JSU variable is one whose bent z is standard normal
            tail, root, bent = softplus(o[..., 3]) + LEAST_SCALE, np.sqrt(1 + z * z), np.arcsinh(z)
            v = o[..., 2] + tail * bent
            loss, by_z = np.log(scale * root / tail) + v * v / 2, z / root**2 + v * tail / root
            d[..., 2], d[..., 3] = v, (v * bent - 1 / tail) * sigmoid(o[..., 3])
        d[..., 0], d[..., 1] = -by_z / scale, (1 - by_z * z) / scale * sigmoid(o[..., 1])
        return float(loss.mean()), d / n

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.01, patience: int = 30, held: float = 0.15) -> Net:
        y = y.reshape(len(y), -1)
        self.scales = [x.mean(0), x.std(0) + 1e-9, y.mean(0), y.std(0) + 1e-9]
        x, y = (x - self.scales[0]) / self.scales[1], (y - self.scales[2]) / self.scales[3]
        cut = max(1, int(len(y) * (1 - held)))
        self._start(x.shape[1], y.shape[1])
        m, v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        best, best_params, since = np.inf, [p.copy() for p in self.params], 0
        for t in range(1, rounds + 1):
            w1, b1, w2, _ = self.params
            h = np.tanh(x[:cut] @ w1 + b1)
            d = self._loss(self._head(h), y[:cut])[1].reshape(cut, -1)
            back = d @ w2.T * (1 - h * h)
            for i, g in enumerate((x[:cut].T @ back, back.sum(0), h.T @ d, d.sum(0))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.params[i] -= rate * (m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) + 1e-4 * self.params[i])
            loss = self._loss(self._head(np.tanh(x[cut:] @ self.params[0] + self.params[1])), y[cut:])[0] if cut < len(y) else 0.0
            if loss < best - 1e-6:
                best, best_params, since = loss, [p.copy() for p in self.params], 0
            else:
                since += 1
                if since >= patience:
                    break
        self.params = best_params
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, targets, 99 levels).

        Rows are taken in blocks of one shape, the last one filled up: how a product adds up depends on its shape, and a row's
        levels must not depend on the rows that came with it.
        """
        mean, sd, y_mean, y_sd = self.scales
        n = len(x)
        blocks = np.zeros((-(-n // BLOCK_ROWS) * BLOCK_ROWS, x.shape[1]))
        blocks[:n] = (x - mean) / sd
        outs = [self._head(np.tanh(b @ self.params[0] + self.params[1])) for b in blocks.reshape(-1, BLOCK_ROWS, x.shape[1])]
        return self._levels(np.concatenate(outs)[:n]) * y_sd[:, None] + y_mean[:, None]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.params, *self.scales)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, head: str, seed: int, data: bytes) -> Net:
        with np.load(io.BytesIO(data)) as f:
            arrays = [f[f"arr_{i}"] for i in range(8)]
        net = cls(head, seed, arrays[0].shape[1])
        net.params, net.scales = arrays[:4], arrays[4:]
        return net


def members(train: DataFrame, heads: tuple[str, ...] = ("jsu", "quantile"), seeds: int = 12, rounds: int = 400, least: int = 1, most: int = MOST_ROWS) -> DataFrame:
    """key, head, seed, n_rows, net: the fitted members. train: key, x array<double>, y array<double>.

    A key with fewer than `least` rows is an error, as one with more than `most` is: its window must be cut first.
    """
    out_of = train.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") < least) | (F.col("n") > most)).limit(5).collect()
    if out_of:
        raise ValueError(f"training rows must be {least} to {most} a key, got {[tuple(r) for r in out_of]}")
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("head"), F.lit(s).alias("seed")) for h in heads for s in range(seeds)]))
    rows = train.select("key", "x", "y", each.alias("m")).select("key", "x", "y", "m.head", "m.seed")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf.x.tolist(), float), np.array(pdf.y.tolist(), float)
        order = np.lexsort(np.hstack([y, x]).T)  # the same fit whatever the order of rows
        order = order[np.random.default_rng(1).permutation(len(order))]
        net = Net(str(pdf["head"].iloc[0]), int(pdf.seed.iloc[0])).fit(x[order], y[order], rounds)
        return pd.DataFrame({"key": pdf.key.iloc[:1], "head": net.head, "seed": net.seed, "n_rows": len(x), "net": [net.to_bytes()]})

    return rows.groupBy("key", "head", "seed").applyInPandas(solve, "key string, head string, seed int, n_rows long, net binary")


PREDICTED = "key string, t timestamp_ntz, i int, q array<double>"


def _mixed(nets: list[Net], rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The level-wise mean of all members, in order, a row for each target."""
    if not len(rows) or not nets:
        return
    x = np.array(rows.x.tolist(), float)
    q = np.sort(np.mean([n.predict(x) for n in nets], axis=0), axis=-1)
    for i in range(q.shape[1]):
        yield pd.DataFrame({"key": rows.key, "t": rows.t, "i": i, "q": list(q[:, i])})


def predict(ask: DataFrame, fitted: DataFrame) -> DataFrame:
    """key, t, i (target), q: for each row of ask (key, t, x) the level-wise mean over its key's members."""
    fitted = fitted.select("key", "head", "seed", "net")
    ask = ask.select("key", "t", "x")
    size = fitted.agg(F.coalesce(F.sum(F.octet_length("net")), F.lit(0))).first()[0]
    load = lambda rows: [Net.from_bytes(h, s, b) for h, s, b in sorted(rows, key=lambda r: (r[0], r[1]))]
    if size > BROADCAST_BYTES:
        def both(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            got = list(_mixed(load(own[["head", "seed", "net"]].itertuples(index=False)), rows))
            return pd.concat(got) if got else rows[["key", "t"]].head(0).assign(i=[], q=[])

        return ask.groupBy("key").cogroup(fitted.groupBy("key")).applyInPandas(both, PREDICTED)
    sent = ask.sparkSession.sparkContext.broadcast([tuple(r) for r in fitted.collect()])  # of the size checked above

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = defaultdict(list)
        for key, *rest in sent.value:
            own[key].append(rest)
        nets = {k: load(v) for k, v in own.items()}
        for pdf in batches:
            for key, rows in pdf.groupby("key"):
                yield from _mixed(nets.get(key, []), rows)

    return ask.mapInPandas(run, PREDICTED)


def ensemble(train: DataFrame, ask: DataFrame, heads: tuple[str, ...] = ("quantile", "normal"), seeds: int = 2, rounds: int = 400) -> DataFrame:
    """key, t, i, q: members() of train, then predict()."""
    return predict(ask, members(train, heads, seeds, rounds))
