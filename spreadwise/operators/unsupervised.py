"""Principal components and k-means on scaled features (section 2.12), each by map-side sums.

Both see the rows only through sums that every task makes of its own rows: cross products for the
components, sums by cluster for k-means. The sums are in fixed point, so results do not depend on how rows
are partitioned. What reaches the driver is bounded by the number of features and clusters.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

POINT = float(1 << 20)
_CELLS = "a int, b int, low long, high long"


def _x(feats: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in feats])


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)


def gram(rows: DataFrame, feats: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and cross products of the features, in one pass. Rows with a missing value are left out.

    Values are taken to 2^-20. Products are split in two parts so that a sum stays exact: ``low`` holds the part
    below 2^30, ``high`` the rest.
    """
    width = len(feats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for b in batches:
            x = np.rint(_matrix(b, width) * POINT).astype(np.int64)
            x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
            big, small = x >> 16, x & 0xFFFF
            for i in range(width + 1):
                # (big * 2^16 + small) * y, each part summed exactly
                for part, k in ((big, 16), (small, 0)):
                    sums = (part[:, i:i + 1] * (x[:, i:] >> 16)).sum(axis=0), (part[:, i:i + 1] * (x[:, i:] & 0xFFFF)).sum(axis=0)
                    for j in range(i, width + 1):
                        total[i, j] = total.get((i, j), 0) + (int(sums[0][j - i]) << k + 16) + (int(sums[1][j - i]) << k)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
            pa.array([v & (1 << 30) - 1 for v in total.values()], pa.int64()), pa.array([v >> 30 for v in total.values()], pa.int64())], names=["a", "b", "low", "high"])

    x = rows.select(_x(feats).alias("x")).filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    cells = x.mapInArrow(run, _CELLS).groupBy("a", "b").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()
    m = np.zeros((width + 1, width + 1))
    for r in cells:                                   # (features + 1)^2 / 2 rows
        m[r.a, r.b] = m[r.b, r.a] = ((r.high << 30) + r.low) / (POINT ** ((r.a > 0) + (r.b > 0)))
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def principal_components(rows: DataFrame, feats: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Variances of the components, largest first, and their loadings as rows: eigenvectors of the population
    covariance. The loading of the largest size is positive (the first of equal ones). No rows: zeros."""
    n, sums, cross = gram(rows, feats)
    if not n:
        return np.zeros(len(feats)), np.eye(len(feats))
    value, vector = np.linalg.eigh(cross / n - np.outer(sums / n, sums / n))
    order = np.argsort(-value, kind="stable")
    value, vector = np.maximum(value[order], 0.0), vector[:, order].T
    largest = vector[np.arange(len(vector)), np.abs(np.round(vector, 9)).argmax(axis=1)]
    return value, vector * np.where(largest < 0, -1.0, 1.0)[:, None]


def component_scores(rows: DataFrame, feats: Sequence[str], loadings: np.ndarray, names: Sequence[str]) -> DataFrame:
    """``rows`` with one column a component: the scalar product with its loadings (features are centred by scaling)."""
    return rows.withColumns({name: sum((F.col(c) * F.lit(float(w)) for c, w in zip(feats, v, strict=True)), F.lit(0.0))
                             for name, v in zip(names, loadings, strict=False)})


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equal ones) and its squared distance."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _unit(draw: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """An even number in [0, 1) of each row and turn."""
    rng = random.Random(seed * 7_919 + turn)
    p = (1 << 31) - 1
    return ((draw * rng.randrange(1, p) + rng.randrange(p)) % p) / p


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * POINT).astype(np.int64)


class KMeans:
    """Lloyd's rounds from k-means|| centres. ``rows``: ``draw`` (0 <= draw < 2^31 - 1) and the features; they are
    staged, since every round reads them."""

    def __init__(self, rows: DataFrame, feats: Sequence[str], k: int, seed: int = 42, rounds: int = 3, most: int = 50):
        self.feats, self.k, self.seed = list(feats), k, seed
        x = rows.select(F.col("draw").cast("long").alias("draw"), _x(feats).alias("x"))
        self.x = stage_table(x.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v))), "kmeans")
        self.inertia: list[float] = []
        self.centres = self._seeds(rounds)
        for _ in range(most if len(self.centres) else 0):
            sums, count, cost, far = self._sums(self.centres)
            self.inertia.append(cost)
            moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centres)
            empty = np.flatnonzero(count == 0)
            moved[empty] = [far[i] for i in range(len(empty))] if len(empty) else moved[empty]
            if np.array_equal(moved, self.centres):
                break
            self.centres = moved

    def _seeds(self, rounds: int) -> np.ndarray:
        """k-means||: in each round about 2 k rows are drawn, in proportion to their squared distance from the
        candidates so far; candidates are then weighted by the rows nearest to them and thinned to k by k-means++."""
        first = self.x.orderBy("draw", "x").limit(1).collect()
        if not first:
            return np.zeros((0, len(self.feats)))
        centres = np.array([first[0].x])
        for turn in range(rounds):
            cost = self._sums(centres)[2]
            if cost <= 0:
                break
            centres = np.concatenate([centres, self._drawn(centres, 2 * self.k / cost, turn)])
        centres = np.unique(centres, axis=0)
        weight = self._sums(centres)[1].astype(float)
        rng, chosen = random.Random(self.seed), [int(weight.argmax())]
        while len(chosen) < min(self.k, len(centres)):
            d = _nearest(centres, centres[chosen])[1] * weight
            d[chosen] = 0
            at = np.cumsum(d)
            left = [i for i in range(len(centres)) if i not in chosen]
            chosen.append(int(np.searchsorted(at, rng.random() * at[-1], side="right")) if at[-1] > 0 else left[0])
        return centres[chosen]

    def _drawn(self, centres: np.ndarray, rate: float, turn: int) -> np.ndarray:
        width, seed = len(self.feats), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = _nearest(_matrix(b, width), centres)[1]
                yield b.filter(pa.array(_unit(b.column("draw").to_numpy(zero_copy_only=False), seed, turn) < rate * d))
        rows = self.x.mapInArrow(run, self.x.schema).orderBy("draw", "x").limit(20 * self.k).collect()     # 2 k are expected
        return np.array([r.x for r in rows]).reshape(len(rows), width)

    def _sums(self, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
        """Sums and counts by nearest centre, the total squared distance, and the rows farthest from their centre."""
        width, k = len(self.feats), len(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, far = np.zeros((k, width + 2), np.int64), []
            for b in batches:
                x = _matrix(b, width)
                at, d = _nearest(x, centres)
                part = np.concatenate([_fixed(x), np.ones((len(x), 1), np.int64), _fixed(d)[:, None]], axis=1)
                for c in range(k):
                    total[c] += part[at == c].sum(axis=0)
                best = np.argsort(-d, kind="stable")[:k]
                far = sorted(far + [(-_fixed(d[i:i + 1])[0], x[i].tolist()) for i in best.tolist()])[:k]
            for c in range(k):
                yield pa.RecordBatch.from_arrays([pa.array([c] * (width + 2), pa.int32()), pa.array(range(width + 2), pa.int32()), pa.array(total[c]),
                                                  pa.nulls(width + 2, pa.list_(pa.float64()))], names=["c", "j", "v", "x"])
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(far), pa.int32()), pa.array([0] * len(far), pa.int32()), pa.array([int(-f[0]) for f in far], pa.int64()),
                                              pa.array([f[1] for f in far], pa.list_(pa.float64()))], names=["c", "j", "v", "x"])
        parts = self.x.mapInArrow(run, "c int, j int, v long, x array<double>")
        sums = np.zeros((k, width + 2), np.int64)
        for r in parts.filter("c >= 0").groupBy("c", "j").agg(F.sum("v").alias("v")).collect():
            sums[r.c, r.j] = r.v
        far = []
        if (sums[:, width] == 0).any():               # only an empty cluster asks for them
            far = [np.array(r.x) for r in parts.filter("c < 0").orderBy(F.desc("v"), "x").limit(k).collect()]
            far += [centres[0]] * (k - len(far))
        return sums[:, :width] / POINT, sums[:, width], float(sums[:, width + 1].sum() / POINT), far

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``cluster`` (from 0) and ``distance`` (squared) of the nearest centre; null where a feature is missing."""
        x = _x(self.feats)
        d = F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in self.centres])
        near = rows.withColumn("_d", d).withColumn("distance", F.array_min("_d"))
        return near.withColumn("cluster", F.when(F.col("distance").isNotNull(), F.array_position("_d", F.col("distance")) - 1).cast("long")).drop("_d")
