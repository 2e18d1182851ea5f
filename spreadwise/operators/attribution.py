"""Per-row, per-feature attribution: exact closed forms for linear scores and for tree ensembles.

Trees: the path-dependent Shapley value of a tree is a sum over its leaves. A leaf with the distinct
path features 1..m, of which a row satisfies o_j in {0, 1}, and through whose splits a share z_j of
the training rows passes (product of the cover ratios of j's splits), adds for feature i

    v * (o_i - z_i) * sum over S of |S|! (m - |S| - 1)! / m! * prod_{j in S} o_j * prod_{j not in S} z_j

over the subsets S of the other features (Lundberg et al., 2018). The sums over subsets of one size
are the coefficients of prod_j (z_j + o_j t). Rows are processed as NumPy columns; the only loop is
over leaves. The leaf table is bounded by the model (trees x leaves), not by the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"^\s*(If|Else|Predict:)\s*(?:\(feature (\d+) (<=|>) ([-\d.eE+NaInfity]+)\)|([-\d.eE+]+))")


def linear_attribution(rows: DataFrame, means: DataFrame, coefs: Sequence[float], feats: Sequence[str],
                       keys: Sequence[str] = ("gvkey", "date")) -> DataFrame:
    """``coef_j * (x_j - mean_j)`` as a long table ``(keys, feature, value, attribution)``.

    ``means``: one row with the mean of each feature.
    """
    j = rows.crossJoin(F.broadcast(means.select(*[F.col(c).alias(f"{c}__m") for c in feats])))
    return j.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), (F.lit(float(b)) * (F.col(c) - F.col(f"{c}__m"))).alias("attribution"))
        for c, b in zip(feats, coefs, strict=True)])).alias("r")).select(*keys, "r.*")


@dataclass
class Leaf:
    tree: int
    value: float
    splits: list[tuple[int, float, bool]]     # feature, threshold, goes left


def leaves_of(tree: int, text: str, weight: float) -> list[Leaf]:
    """Leaves of one tree from the printed form of its model."""
    out: list[Leaf] = []
    path: list[tuple[int, float, bool]] = []
    for line in text.splitlines():
        m = LINE.match(line)
        if not m:
            continue
        if m[1] == "Predict:":
            out.append(Leaf(tree, weight * float(m[5]), list(path)))
            while path and not path[-1][2]:          # a finished right branch
                path.pop()
            if path:
                path.pop()                           # its left branch is done: the Else follows
        else:
            path.append((int(m[2]), float(m[4]), m[1] == "If"))
    return out


def reached(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """Rows of a feature matrix that end in the leaf."""
    ok = np.ones(len(x), dtype=bool)
    for f, t, left in leaf.splits:
        ok &= (x[:, f] <= t) == left
    return ok


def covers(train: DataFrame, leaves: list[Leaf], features: str = "features") -> np.ndarray:
    """Training rows in each leaf; one count a leaf reaches the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(leaves), dtype=np.int64)
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                n += np.array([reached(x, leaf).sum() for leaf in leaves])
        yield pd.DataFrame({"leaf": np.arange(len(leaves)), "n": n})
    rows = train.select(vector_to_array(features).alias("x")).mapInPandas(count, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(leaves))
    for r in rows:
        out[r.leaf] = r.n
    return out


@dataclass
class LeafTerm:
    """What attribution needs of a leaf: its value and, by path feature, interval and cover share."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaf_terms(leaves: list[Leaf], cover: np.ndarray) -> list[LeafTerm]:
    """Combine the splits of a path by feature. A node's cover is that of the leaves below it."""
    node: dict[tuple, float] = {}
    for leaf, n in zip(leaves, cover, strict=True):
        for d in range(len(leaf.splits) + 1):
            key = (leaf.tree, tuple(leaf.splits[:d]))
            node[key] = node.get(key, 0.0) + n
    out = []
    for leaf in leaves:
        by: dict[int, list[float]] = {}
        for d, (f, t, left) in enumerate(leaf.splits):
            above, below = node[(leaf.tree, tuple(leaf.splits[:d]))], node[(leaf.tree, tuple(leaf.splits[:d + 1]))]
            low, high, share = by.get(f, [-np.inf, np.inf, 1.0])
            by[f] = [low if left else max(low, t), min(high, t) if left else high, share * (below / above if above else 0.0)]
        out.append(LeafTerm(leaf.value, list(by), [v[0] for v in by.values()], [v[1] for v in by.values()], [v[2] for v in by.values()]))
    return out


def base_value(terms: list[LeafTerm]) -> float:
    return float(sum(t.value * np.prod(t.share) for t in terms))


def shapley(x: np.ndarray, terms: list[LeafTerm]) -> np.ndarray:
    """Attributions of a feature matrix: rows by features."""
    phi = np.zeros(x.shape)
    for t in terms:
        m = len(t.features)
        if not m:
            continue
        met = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(t.features, t.low, t.high, strict=True)]
        weight = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
        for i, f in enumerate(t.features):
            poly = [np.ones(len(x))]
            for j in range(m):
                if j != i:
                    longer = [c * t.share[j] for c in poly] + [np.zeros(len(x))]
                    for k, c in enumerate(poly):
                        longer[k + 1] = longer[k + 1] + c * met[j]
                    poly = longer
            phi[:, f] += t.value * (met[i] - t.share[i]) * sum(w * c for w, c in zip(weight, poly, strict=True))
    return phi


def tree_attribution(rows: DataFrame, terms: list[LeafTerm], feats: Sequence[str], scale: float = 1.0,
                     features: str = "features") -> DataFrame:
    """Long table ``(gvkey, date, feature, value, attribution)`` of every row, times ``scale``."""
    names = list(feats)
    shared = rows.sparkSession.sparkContext.broadcast(terms)          # bounded by the model's size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["x"].to_numpy())
            phi = scale * shapley(x, shared.value)
            yield pd.DataFrame({"gvkey": np.repeat(b["gvkey"].to_numpy(), len(names)), "date": np.repeat(b["date"].to_numpy(), len(names)),
                                "feature": np.tile(names, len(b)), "value": x.ravel(), "attribution": phi.ravel()})
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("gvkey", "date", vector_to_array(features).alias("x")).mapInPandas(
        run, f"gvkey {kind['gvkey']}, date {kind['date']}, feature string, value double, attribution double")


def boosted_terms(model, train: DataFrame) -> list[LeafTerm]:
    """Leaf terms of an ensemble on its raw score: one of ``boosting`` (log-odds), or of ``pyspark.ml``."""
    if hasattr(model, "treeWeights"):
        leaves = [leaf for i, (t, w) in enumerate(zip(model.trees, model.treeWeights, strict=True)) for leaf in leaves_of(i, t.toDebugString, w)]
    else:
        leaves = model.leaves()
    return leaf_terms(leaves, covers(train, leaves))

