"""Checks that a fitted model is the optimum it claims to be, made from the rows and the stored model alone."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boosting import BINS, LEAST_GAIN, POINT, BoostedTrees, Job, binned, cell_sums, drawn_columns, drawn_rows


def logistic_gradient(rows: DataFrame, feats: Sequence[str], coefs: Sequence[float], intercept: float, penalty: float,
                      label: str = "label", weight: str = "w_balanced") -> DataFrame:
    """Derivative of the penalised mean loss by each coefficient: ``(part, gradient)``; 0 everywhere at the optimum.

    ``penalty`` is the factor of half the squared norm of the coefficients; the intercept is free.
    """
    margin = sum((F.col(c) * F.lit(float(b)) for c, b in zip(feats, coefs, strict=True)), F.lit(float(intercept)))
    error = F.col(weight) * (1 / (1 + F.exp(-margin)) - F.col(label))
    d = rows.select(error.alias("e"), F.col(weight).alias("w"), *feats)
    row = d.agg(F.sum("w").alias("w"), F.sum("e").alias("_intercept"), *[F.sum(F.col("e") * F.col(c)).alias(c) for c in feats])
    part = lambda name, b: F.struct(F.lit(name).alias("part"), (F.col(name) / F.col("w") + F.lit(penalty * b)).alias("gradient"))
    return row.select(F.explode(F.array(part("_intercept", 0.0), *[part(c, float(b)) for c, b in zip(feats, coefs, strict=True)])).alias("r")).select("r.*")


def split_faults(rows: DataFrame, model: BoostedTrees, job: Job, seed: int = 42) -> DataFrame:
    """``(tree, faults)`` of each tree: nodes whose stored split is not the best of their rows, leaves above the
    greatest depth that could be split (where every level is grown whole), and leaves of a wrong value.

    Every row counts once for each tree that drew it and each node it passes, with its derivatives before that
    tree. A task sums its own rows by (tree, node, feature, bin), so what is shuffled is bounded by the model; the
    sums of all tasks and the gains are plain aggregates and windows.
    """
    s, feats = job.settings, model.feats
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    offered = [drawn_columns(len(feats), seed, i, s.columns) for i in range(len(model.trees))]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: BoostedTrees = shared.value
        sums = [np.zeros((len(t.feature), len(own), BINS, 3), np.int64) for t, own in zip(m.trees, offered, strict=True)]
        for b in batches:
            if not b.num_rows:
                continue
            x = np.ascontiguousarray(binned(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(feats)), m.edges).T)
            draw, label, weight = (b.column(c).to_numpy(zero_copy_only=False) for c in ("draw", "label", "weight"))
            margin = np.zeros(b.num_rows)
            for i, t in enumerate(m.trees):
                use, at = np.flatnonzero(drawn_rows(draw, seed, i, s.rows)), t.ends(x)
                p = 1 / (1 + np.exp(-margin[use]))
                g = np.rint((p - label[use]) * weight[use] * POINT)
                h = np.rint(p * (1 - p) * weight[use] * POINT)
                sums[i] += cell_sums(x[:, use], offered[i], at[use], len(t.feature), g, h)
                margin = margin + np.asarray(t.value)[at]
        for i, t in enumerate(m.trees):
            for k in reversed(range(len(t.feature))):           # a row passes the nodes above its last one
                if t.feature[k] >= 0:
                    sums[i][k] += sums[i][t.left[k]] + sums[i][t.right[k]]
            node, j, bin_ = np.nonzero(sums[i][..., 2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int32)) for v in (np.full(len(node), i), node, offered[i][j], bin_)] + [pa.array(sums[i][node, j, bin_, c]) for c in range(3)],
                names=["tree", "node", "feature", "bin", "g", "h", "n"])

    fold = F.coalesce(F.col("fold").cast("int"), F.lit(-1))
    own = rows.filter(fold != job.fold) if job.fold is not None else rows
    own = own.select(F.col("draw").cast("long").alias("draw"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
                     F.array(*[F.col(c).cast("double") for c in feats]).alias("x"))
    seen = own.mapInArrow(passed, "tree int, node int, feature int, bin int, g long, h long, n long")
    cells = seen.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"])     # bounded by the model
    upto = Window.partitionBy("tree", "node", "feature").orderBy("bin")             # at most as many rows as bins
    whole = Window.partitionBy("tree", "node", "feature")
    point = F.lit(POINT)
    shrunk = lambda g: F.signum(g) * F.greatest(F.abs(g) - s.l1, F.lit(0.0))
    part = lambda g, h: F.pow(shrunk(g), 2) / (h + s.l2)
    sums = cells.select("tree", "node", "feature", "bin", *[(F.sum(c).over(w) / d).alias(f"{side}{c}") for side, w in (("l", upto), ("t", whole))
                                                            for c, d in (("g", point), ("h", point), ("n", F.lit(1.0)))])
    rest = {c: F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn"}
    allowed = ((F.least(F.col("lh"), rest["h"]) >= s.min_hessian) & (F.least(F.col("ln"), rest["n"]) >= max(s.min_rows, 1)))
    gain = F.when(allowed, part(F.col("lg"), F.col("lh")) + part(rest["g"], rest["h"]) - part(F.col("tg"), F.col("th")))
    best = (sums.withColumn("gain", gain).groupBy("tree", "node")
            .agg(F.max("gain").alias("most"), F.collect_list(F.struct("feature", "bin", "gain")).alias("all"), F.first("tg").alias("tg"), F.first("th").alias("th")))
    stored = model.table(spark).select("tree", "node", "depth", F.col("feature").alias("f"), "cut", "value")
    j = stored.join(best, ["tree", "node"], "left")
    close = lambda a, b: F.abs(a - b) <= 1e-9 + 1e-9 * F.abs(b)
    # the stored cut may lie in a bin without rows of the node: its gain is that of the last filled bin up to it
    at_cut = F.element_at(F.sort_array(F.transform(F.filter("all", lambda c: (c["feature"] == F.col("f")) & (c["bin"] <= F.col("cut"))),
                                                   lambda c: F.struct(c["bin"].alias("bin"), c["gain"].alias("gain")))), -1)["gain"]
    value = -s.rate * shrunk(F.col("tg")) / (F.col("th") + s.l2)
    could = F.coalesce(F.col("most") > LEAST_GAIN * (1 + 1e-9), F.lit(False)) & (F.col("depth") < s.depth) & F.lit(s.leaves is None)
    fine = F.when(F.col("f") >= 0, close(F.try_element_at(F.array(at_cut), F.lit(1)), F.col("most"))).otherwise(
        F.coalesce(close(F.col("value"), value), F.col("value") == 0) & ~could)
    return j.groupBy("tree").agg(F.sum(F.when(F.coalesce(fine, F.lit(False)), 0).otherwise(1)).alias("faults"))
