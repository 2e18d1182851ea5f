"""M5 / M6: gradient-boosted trees with regularised leaves, fitted by Spark aggregates.

A tree is grown level by level. For a level, every task sums first and second derivatives of the
logistic loss and counts rows by (fit, node, feature, bin); the sums of a node meet in one row, and the
best split of a node is that of the largest gain

    S(G_left, H_left) + S(G_right, H_right) - S(G, H),   S(G, H) = max(|G| - l1, 0)^2 / (H + l2)

with at least ``min_hessian`` and ``min_rows`` on either side. ``leaves`` limits a tree to that many leaves,
taken best first: a node's gain does not depend on when it is split, so the tree is grown to its depth
and the order is replayed afterwards. A leaf adds ``-rate * T(G) / (H + l2)``, with T shrinking G by l1.

Many fits (settings, folds) are grown side by side: one scan of the rows serves a level of all fits that leave out the
same fold. These scan the rows of the other folds only; another fold's fits are grown at the same time by a thread of
their own, so that the cluster works for one while the splits of another are found.
Rows are staged once as bins (a byte a feature), a block of rows, column after column, to a staged row, so that a
level does not take every row apart again. Beside the bins a block keeps the running scores of the fits that still
grow. They are brought up to date once a tree and persisted; every ``REFRESH`` trees they are checkpointed, so that
their lineage stays short. Of two children only the one with fewer rows is summed, the other is what is left of its
parent's sums, which stay where they were found. Derivatives are summed in fixed point, so a fit is the same however
rows are partitioned. What reaches the driver is one row a node; what is shuffled is tasks x nodes x features x bins,
whatever the rows.

Bins are cut at midpoints or quantiles of a sample: the ``SAMPLE_ROWS`` rows with the smallest draw. Only about as
many rows leave their tasks: counts of the draws by range tell how far the sample reaches.
"""

from __future__ import annotations

import gc
import heapq
import random
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from .attribution import Leaf

BINS = 64
SAMPLE_ROWS = 50_000
REFRESH = 25
ROWS_A_TASK = 100_000
WORK_A_TASK = 1_000_000             # rows x fits
BLOCK_ROWS = 30_000
FITS_A_TASK = 16                    # where sums of all tasks meet
DRAW_RANGES = 4096
POINT = float(1 << 24)              # fixed point of the derivatives
PRIME = (1 << 31) - 1
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``columns``: shares drawn for each tree. ``leaves``: None grows every level whole."""

    trees: int = 75
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.6
    columns: float = 0.6
    l1: float = 2.0
    l2: float = 2.0
    min_hessian: float = 1e-3
    min_rows: int = 1
    leaves: int | None = None


@dataclass
class Tree:
    """Nodes by number; ``feature`` -1 marks a leaf. Rows with bin <= ``cut`` go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    g: list[int] = field(default_factory=list)
    h: list[int] = field(default_factory=list)
    n: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, depth: int, g: int = 0, h: int = 0, n: int = 0) -> int:
        for name, v in (("feature", -1), ("cut", 0), ("left", -1), ("right", -1), ("depth", depth), ("g", g), ("h", h), ("n", n), ("gain", 0.0), ("value", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple[int, int, int], right: tuple[int, int, int]) -> None:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node] = self.add(self.depth[node] + 1, *left)
        self.right[node] = self.add(self.depth[node] + 1, *right)

    def keep_best(self, leaves: int) -> None:
        """Undo all splits but those that best-first growth to ``leaves`` leaves would make."""
        made, queue = set(), [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
        while queue and len(made) < leaves - 1:
            _, node = heapq.heappop(queue)
            made.add(node)
            for child in (self.left[node], self.right[node]):
                if self.feature[child] >= 0:
                    heapq.heappush(queue, (-self.gain[child], child))
        kept, old = Tree(), [0]
        kept.add(0, self.g[0], self.h[0], self.n[0])
        for new, node in enumerate(old):                     # grows as splits add their children
            if node in made:
                a, b = self.left[node], self.right[node]
                kept.split(new, self.feature[node], self.cut[node], self.gain[node], *((self.g[c], self.h[c], self.n[c]) for c in (a, b)))
                old += [a, b]
        self.__dict__.update(kept.__dict__)

    def finish(self, s: Settings) -> None:
        if s.leaves is not None:
            self.keep_best(s.leaves)
        self.value = [leaf_value(g, h, s) if f < 0 else 0.0 for f, g, h in zip(self.feature, self.g, self.h, strict=True)]

    def reach(self, bins: np.ndarray, upto: int) -> np.ndarray:
        """Node of each row after ``upto`` steps."""
        feature, cut, left, right = (np.asarray(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        for _ in range(upto):
            f = feature[at]
            go = np.flatnonzero(f >= 0)
            if not len(go):
                break
            node = at[go]
            at[go] = np.where(bins[go, f[go]] <= cut[node], left[node], right[node])
        return at

    def ends(self, columns: np.ndarray) -> np.ndarray:
        """Node in which each row ends; ``columns``: the bins, features by rows. A child has a greater number than its
        parent, so the last nodes are settled first: from the left one, as far as the right one for rows that go there
        (modulo 2^8 or 2^16)."""
        kind = np.uint8 if len(self.feature) <= 1 << 8 else np.uint16
        at: list = list(np.arange(len(self.feature), dtype=kind))
        for k in reversed(range(len(self.feature))):
            if self.feature[k] >= 0:
                low, high = at[self.left[k]], at[self.right[k]]
                with np.errstate(over="ignore"):
                    at[k] = (columns[self.feature[k]] > self.cut[k]).view(np.uint8) * (high - low) + low
        return at[0] if np.ndim(at[0]) else np.zeros(columns.shape[1], kind)

    def score(self, columns: np.ndarray) -> np.ndarray:
        return np.asarray(self.value).take(self.ends(columns))


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: int, h: int, s: Settings) -> float:
    return float(-s.rate * shrunk(g / POINT, s.l1) / (h / POINT + s.l2))


def best_split(cells: np.ndarray, features: np.ndarray, s: Settings):
    """Best split of a node from its sums ``[feature, bin, (g, h, n)]``: ``(feature, cut, gain, left, right)`` or
    None. Equal gains take the first feature, then the first bin."""
    left = cells.cumsum(axis=1)[:, :-1]
    total = cells[0].sum(axis=0)
    right = total - left
    part = lambda x: shrunk(x[..., 0] / POINT, s.l1) ** 2 / (x[..., 1] / POINT + s.l2)
    with np.errstate(divide="ignore", invalid="ignore"):          # an empty side without l2; it is not allowed below
        gain = part(left) + part(right) - part(total)
    ok = np.ones(gain.shape, bool)
    for side in (left, right):
        ok &= (side[..., 1] / POINT >= s.min_hessian) & (side[..., 2] >= max(s.min_rows, 1))
    gain = np.where(ok, gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > LEAST_GAIN:
        return None
    return int(features[f]), int(b), float(gain[f, b]), tuple(left[f, b].tolist()), tuple(right[f, b].tolist())


def drawn_rows(draw: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Rows in the sample of a tree: a pairwise independent hash of the row's draw."""
    rng = random.Random(seed * 1_000_003 + tree)
    a, b = rng.randrange(1, PRIME), rng.randrange(PRIME)
    return (draw * a + b) % PRIME < share * PRIME


def drawn_columns(n: int, seed: int, tree: int, share: float) -> np.ndarray:
    rng = random.Random(seed * 1_000_003 + tree + 500_009)
    return np.array(sorted(rng.sample(range(n), max(1, round(share * n)))))


@dataclass(frozen=True)
class Job:
    """One fit: its settings, and the fold whose rows it does not see (None: it sees all)."""

    settings: Settings
    fold: int | None = None


def smallest_draws(rows: DataFrame, n: int) -> DataFrame:
    """The rows whose draw lies in the first ranges that hold ``n`` rows together (all, if there are fewer)."""
    at = F.coalesce(F.floor(F.col("draw") / (PRIME // DRAW_RANGES + 1)), F.lit(-1))       # a missing draw sorts first
    held = 0
    for r in rows.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect():     # DRAW_RANGES rows
        held += r.n
        if held >= n:
            return rows.filter(at <= r["at"])
    return rows


def bin_edges(rows: DataFrame, feats: Sequence[str], bins: int = BINS, sample_rows: int = SAMPLE_ROWS) -> list[np.ndarray]:
    """Upper edges of the bins of each feature (the last bin is open), from a bounded sample."""
    sample = smallest_draws(rows, sample_rows).orderBy("draw", *feats).limit(sample_rows).select(*[F.col(c).cast("double").alias(c) for c in feats]).toPandas()
    out = []
    for c in feats:
        x = np.sort(sample[c].dropna().to_numpy())
        values = np.unique(x)
        if len(values) > bins:
            values = np.unique(x[np.minimum((np.arange(1, bins) * len(x)) // bins, len(x) - 1)])
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value; missing values are in the first bin."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], side="left")
        out[np.isnan(x[:, j]), j] = 0
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]) if names else np.zeros((batch.num_rows, 0))


_BLOCK = {"draw": np.int64, "fold": np.int32, "label": np.float64, "weight": np.float64, "bins": np.uint8, "scores": np.float64}
_BLOCKS = "rows int, " + ", ".join(f"{c} binary" for c in _BLOCK)
NO_DRAW = -(1 << 63)                # a row without a draw is in no sample of a tree


def _block(columns: Mapping[str, np.ndarray]) -> pa.RecordBatch:
    """One row that holds a block: ``bins`` and ``scores`` feature by feature and fit by fit."""
    values = [pa.array([np.ascontiguousarray(columns[c], kind).tobytes()], pa.binary()) for c, kind in _BLOCK.items()]
    return pa.RecordBatch.from_arrays([pa.array([len(columns["draw"])], pa.int32()), *values], names=["rows", *_BLOCK])


def _stage_rows(feats: Sequence[str], edges: Sequence[np.ndarray], fits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "label", "weight")}
            yield _block(own | {"draw": b.column("draw").fill_null(NO_DRAW).to_numpy(), "bins": binned(_matrix(b, feats), edges).T,
                                "scores": np.zeros((fits, b.num_rows))})
    return run


def _opened(features: int, fits: int, left_out: int | None):
    """Staged rows but those of a fold as arrays, put together to blocks of ``BLOCK_ROWS`` or a little more, with scores of 0."""
    def block(r: Row) -> dict[str, np.ndarray]:
        found = {c: np.frombuffer(r[c], kind) for c, kind in _BLOCK.items() if c != "scores"}
        found["bins"] = found["bins"].reshape(features, r["rows"])
        own = np.flatnonzero(found["fold"] != left_out) if left_out is not None else slice(None)
        return {c: x[..., own] for c, x in found.items()}

    def whole(found: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        one = {c: np.concatenate([x[c] for x in found], axis=-1) for c in found[0]}
        return one | {"scores": np.zeros((fits, len(one["draw"])))}

    def run(part: Iterator[Row]) -> Iterator[dict[str, np.ndarray]]:
        found: list[dict[str, np.ndarray]] = []
        for r in part:
            found.append(block(r))
            if sum(len(x["draw"]) for x in found) >= BLOCK_ROWS:
                yield whole(found)
                found = []
        if found:
            yield whole(found)
    return run


def _brought_up(newer: Mapping[int, Tree], places: Sequence[int]):
    """Scores of the fits that grow on, after one more tree; ``places``: where theirs were."""
    def run(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        scores = np.empty((len(newer), len(block["draw"])))
        for k, (t, place) in enumerate(zip(newer.values(), places, strict=True)):
            np.add(block["scores"][place], t.score(block["bins"]), out=scores[k])
        return block | {"scores": scores}
    return run


def cell_sums(columns: np.ndarray, features: np.ndarray, here: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums ``[node, feature, bin, (g, h, n)]`` of rows that lie in nodes ``here``."""
    first, out = here.astype(np.intp) * BINS, np.empty((nodes, len(features), BINS, 3), np.int64)
    total = h.sum()
    unit = 2.0 ** int(total).bit_length() if 0 <= total < 1 << 52 else np.inf
    if len(h) and h.min() >= 0 and unit * (len(h) + 1) <= 1 << 53:
        # one pass for all three: a row counts as one unit, which no sum of h reaches, and doubles are exact up to 2^53
        rows, sums = np.empty(len(g), complex), np.zeros((len(features), nodes * BINS), complex)
        rows.real, rows.imag = g, h + unit
        for own, f in zip(sums, features, strict=True):
            np.add.at(own, first + columns[f], rows)
        sums = sums.reshape(len(features), nodes, BINS).swapaxes(0, 1)
        out[..., 0], out[..., 2] = sums.real, sums.imag // unit
        out[..., 1] = sums.imag % unit
        return out
    for j, f in enumerate(features):
        cell = first + columns[f]
        for k, v in enumerate((g, h, None)):
            out[:, j, :, k] = np.bincount(cell, v, nodes * BINS).reshape(nodes, BINS)
    return out


def _settle() -> None:
    """A worker collects garbage after each of its many short tasks; it need not go through all modules every time."""
    if not gc.get_freeze_count():
        gc.freeze()


def _histograms(state: dict):
    """Sums of the level's nodes over a task's rows: ``((fit, share), {node: cells})``."""
    jobs, places, growing, tree = (state[k] for k in ("jobs", "places", "growing", "tree"))
    # fits that see the same rows take them once
    alike: dict[float, list[int]] = {}
    for i in growing:
        alike.setdefault(jobs[i].settings.rows, []).append(i)

    def run(part: int, blocks: Iterator[dict[str, np.ndarray]]) -> Iterator[tuple]:
        _settle()
        sums: dict[int, np.ndarray] = {}
        for block in blocks:
            draw, _, label, weight, bins, scores = (block[c] for c in _BLOCK)
            for share, fits in alike.items():
                use = np.flatnonzero(drawn_rows(draw, state["seed"], tree, share) & (draw != NO_DRAW))
                every = bins.take(use, axis=1)
                wide, y, w = every.astype(np.intp), label[use], weight[use] * POINT
                for i in fits:
                    grown, nodes, columns = growing[i]
                    number = np.full(len(grown.feature), -1)
                    number[nodes] = np.arange(len(nodes))
                    here, x, own, y_, w_ = number.take(grown.ends(every)), wide, use, y, w
                    if len(grown.feature) > 1:                # rows of the other nodes stay out
                        keep = np.flatnonzero(here >= 0)
                        here, own, y_, w_ = here[keep], use[keep], y[keep], w[keep]
                        x = {f: wide[f].take(keep) for f in columns}
                    p = 1 / (1 + np.exp(-scores[places[i]].take(own)))
                    found = cell_sums(x, columns, here, len(nodes), np.rint((p - y_) * w_), np.rint(p * (1 - p) * w_))
                    sums[i] = sums[i] + found if i in sums else found
        for i, cells in sums.items():
            yield (i, part % state["shares"]), dict(zip(growing[i][1], cells, strict=True))
    return run


def _added(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {k: v + b[k] for k, v in a.items()}


def _splits(state: dict):
    """Sums and best splits of a level's nodes, from the sums of those that were scanned (dicts) and what this returned
    for the level above: ``(fit, (cells by node, splits))``."""
    def run(part: Iterator[tuple]) -> Iterator[tuple]:
        _settle()
        scanned, above = {}, {}
        for fit, found in part:
            if isinstance(found, dict):
                scanned[fit] = found
            else:
                above[fit] = found[0]
        for fit, cells in scanned.items():
            grown, _, columns = state["growing"][fit]
            for parent, whole in above.get(fit, {}).items():
                if grown.feature[parent] >= 0:
                    one, other = sorted((grown.left[parent], grown.right[parent]), key=cells.__contains__)
                    cells[one] = whole - cells[other]
            yield fit, (cells, [(fit, k, own[0].sum(axis=0).tolist(), best_split(own, columns, state["jobs"][fit].settings)) for k, own in cells.items()])
    return run


@dataclass
class BoostedTrees:
    """A fitted ensemble on the log-odds scale; ``edges`` turn bins back into thresholds."""

    feats: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    threshold: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of_bins(np.ascontiguousarray(binned(x, self.edges).T))

    def margin_of_bins(self, columns: np.ndarray) -> np.ndarray:
        return sum((t.score(columns) for t in self.trees), np.zeros(columns.shape[1]))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p`` and ``pred`` (p above the model's threshold)."""
        model = rows.sparkSession.sparkContext.broadcast(self)       # bounded by trees x nodes
        width = len(self.feats)

        @F.arrow_udf("double")
        def probability(x: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-model.value.margin(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)))))
        # only the features leave the JVM; marked as not deterministic, p is made once for all columns that use it
        p = probability.asNondeterministic()(F.array(*[F.col(c).cast("double") for c in self.feats]))
        return rows.withColumn("p", p).withColumn("pred", (F.col("p") > self.threshold).cast("long"))

    def importances(self) -> list[float]:
        """Share of each feature in the gain of all splits."""
        total = np.zeros(len(self.feats))
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += gain
        return (total / total.sum() if total.sum() else total).tolist()

    def leaves(self) -> list[Leaf]:
        out = []
        for i, t in enumerate(self.trees):
            stack = [(0, [])]
            while stack:
                node, path = stack.pop()
                f = t.feature[node]
                if f < 0:
                    out.append(Leaf(i, t.value[node], path))
                else:
                    at = float(self.edges[f][t.cut[node]])
                    stack += [(t.right[node], [*path, (f, at, False)]), (t.left[node], [*path, (f, at, True)])]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a node: the stored form of the model."""
        rows = [(i, k, t.depth[k], t.feature[k], self.feats[t.feature[k]] if t.feature[k] >= 0 else None, t.cut[k],
                 float(self.edges[t.feature[k]][t.cut[k]]) if t.feature[k] >= 0 else None, t.left[k], t.right[k],
                 t.g[k] / POINT, t.h[k] / POINT, t.n[k], t.gain[k], t.value[k])
                for i, t in enumerate(self.trees) for k in range(len(t.feature))]
        return spark.createDataFrame(rows, "tree int, node int, depth int, feature int, name string, cut int, at double, left int, right int, "
                                           "g double, h double, n long, gain double, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.parquet(f"{path}/trees")
        spark.createDataFrame([(i, c, [float(e) for e in x], float(self.threshold)) for i, (c, x) in enumerate(zip(self.feats, self.edges, strict=True))],
                              "number int, name string, edges array<double>, threshold double").coalesce(1).write.parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        features = spark.read.parquet(f"{path}/features").orderBy("number").collect()
        trees: list[Tree] = []
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():     # bounded by trees x nodes
            if r.node == 0:
                trees.append(Tree())
            t = trees[-1]
            t.add(r.depth, round(r.g * POINT), round(r.h * POINT), r.n)
            t.feature[-1], t.cut[-1], t.left[-1], t.right[-1], t.gain[-1] = r.feature, r.cut, r.left, r.right, r.gain
            t.value.pop()
            t.value.append(r.value)
        return BoostedTrees([r.name for r in features], [np.array(r.edges) for r in features], trees, features[0].threshold if features else 0.5)


def fit_many(rows: DataFrame, feats: Sequence[str], jobs: Sequence[Job], seed: int = 42, edges: list[np.ndarray] | None = None) -> list[BoostedTrees]:
    """Grow the trees of all ``jobs`` together. ``rows``: ``draw`` (0 <= draw < 2^31 - 1, spread evenly), ``fold``,
    ``label`` (0 / 1), ``weight`` and the features; a null fold is in no fold, a null weight or label drops the row.
    An empty table gives trees of one leaf of value 0."""
    spark, jobs, feats = rows.sparkSession, list(jobs), list(feats)
    rows = rows.filter("label is not null and weight is not null").select(
        F.col("draw").cast("long").alias("draw"), F.coalesce(F.col("fold").cast("int"), F.lit(-1)).alias("fold"),
        F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), *[F.col(c).cast("double").alias(c) for c in feats])
    edges = bin_edges(rows, feats) if edges is None else edges
    n = rows.count()
    # a task has a level's fixed cost; with many fits a few rows are work for all cores
    tasks = max(1, -(-n // ROWS_A_TASK), min(-(-n * len(jobs) // WORK_A_TASK), 2 * spark.sparkContext.defaultParallelism))
    dealt = rows.coalesce(tasks) if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
    table = stage_table(dealt.mapInArrow(_stage_rows(feats, edges, 0), _BLOCKS), "boost")
    by_fold: dict[int | None, list[int]] = {}
    for i, job in enumerate(jobs):
        by_fold.setdefault(job.fold, []).append(i)
    # tasks of all folds are on their way at once: half as many again as there are cores
    tasks = max(1, -(-n // ROWS_A_TASK), -(-3 * spark.sparkContext.defaultParallelism // (2 * max(len(by_fold), 1))))
    staged = table.rdd.coalesce(tasks)
    grow = inheritable_thread_target(spark)(lambda own: _grow(staged, len(feats), [jobs[i] for i in own], seed))
    trees: list[list[Tree]] = [[] for _ in jobs]
    with ThreadPoolExecutor(max(len(by_fold), 1)) as pool:
        for own, found in zip(by_fold.values(), pool.map(grow, by_fold.values()), strict=True):
            for i, one in zip(own, found, strict=True):
                trees[i] = one
    return [BoostedTrees(feats, edges, one) for one in trees]


def _grow(table: RDD, features: int, jobs: Sequence[Job], seed: int) -> list[list[Tree]]:
    """Trees of ``jobs`` that leave out the same fold, from the staged rows."""
    active = list(range(len(jobs)))
    blocks = table.mapPartitions(_opened(features, len(jobs), jobs[0].fold))
    shares = max(1, isqrt(blocks.getNumPartitions()) // 4)
    parts = min(-(-len(jobs) // FITS_A_TASK), table.context.defaultParallelism)
    done: list[list[Tree]] = [[] for _ in jobs]
    for tree in range(max(j.settings.trees for j in jobs)):
        before = blocks
        if tree:
            places = {i: k for k, i in enumerate(active)}
            active = [i for i in active if tree < jobs[i].settings.trees]
            blocks = before.map(_brought_up({i: done[i][-1] for i in active}, [places[i] for i in active]))
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if tree and tree % REFRESH == 0:
            blocks.checkpoint()                                         # into the folder of the stage tables
        grown = {i: Tree() for i in active}
        columns = {i: drawn_columns(features, seed, tree, jobs[i].settings.columns) for i in active}
        scanned = {i: [t.add(0)] for i, t in grown.items()}
        above: RDD | None = None
        for level in range(max(jobs[i].settings.depth for i in active)):
            growing = {i: (grown[i], scanned[i], columns[i]) for i in active if scanned[i] and level < jobs[i].settings.depth}
            if not growing:
                break
            state = {"jobs": jobs, "places": {i: k for k, i in enumerate(active)}, "growing": growing, "tree": tree, "seed": seed, "shares": shares}
            sums = blocks.mapPartitionsWithIndex(_histograms(state))
            if shares > 1:
                sums = sums.reduceByKey(_added, parts * shares)
            sums = sums.map(lambda of: (of[0][0], of[1])).reduceByKey(_added, parts)
            if above:
                sums = sums.union(above).partitionBy(parts)             # both lie by fit: nothing moves
            last, above = above, sums.mapPartitions(_splits(state), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            for fit, node, total, found in sorted(above.flatMap(lambda of: of[1][1]).collect(), key=lambda r: r[:2]):      # one row a node
                t = grown[fit]
                t.g[node], t.h[node], t.n[node] = total
                if found:
                    t.split(node, *found)
            if last:
                last.unpersist()
            elif before is not blocks:
                before.unpersist()
            for i, (t, _, _) in growing.items():
                scanned[i] = [min(t.left[k], t.right[k], key=lambda c: t.n[c]) for k in range(len(t.feature)) if t.depth[k] == level and t.feature[k] >= 0]
        if above:
            above.unpersist()
        for i, t in grown.items():
            t.finish(jobs[i].settings)
            done[i].append(t)
    blocks.unpersist()
    return done
