"""Classification metrics as aggregates over a score table ``(label, p[, group])``.

Exact and distributed: nothing sorts the whole table in one task.

* Ranking metrics (AUC, average precision, ROC / PR points) first collapse the table to one
  row per distinct score with its positive / negative counts (partial aggregation). Cumulative
  counts over the distinct scores use a two-level prefix sum: totals per score bucket (at most
  ``BUCKETS`` + 1 rows) plus a running sum inside each bucket (``partitionBy(bucket)``), so no
  window spans the whole table. The buckets' edges are quantiles of the distinct scores, so they
  hold about equally many however the scores crowd and whatever range they have.
* Threshold metrics count rows per "number of thresholds passed" (17 groups), then use
  suffix sums over those groups instead of a cross join with the threshold grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_if
from ..schemas import THRESHOLD_GRID

BUCKETS = 512


def _z(x: Column) -> Column:
    """sklearn ``zero_division=0``: a 0/0 ratio is 0."""
    return F.coalesce(x, F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    g = df.groupBy(*by) if by else df
    out = g.agg(count_if((y == 0) & (p == 0)).alias("tn"), count_if((y == 0) & (p == 1)).alias("fp"),
                count_if((y == 1) & (p == 0)).alias("fn"), count_if((y == 1) & (p == 1)).alias("tp"))
    return out


def with_rates(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity from confusion counts (zero_division=0)."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec = _z(tp / F.nullif(tp + fp, F.lit(0)))
    rec = _z(tp / F.nullif(tp + fn, F.lit(0)))
    return c.withColumns({
        "n": n, "accuracy": (tp + tn) / n, "precision": prec, "recall": rec,
        "f1": _z(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))),
        "specificity": _z(tn / F.nullif(tn + fp, F.lit(0)))})


def score_counts(df: DataFrame, label: str = "label", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score): positives and negatives."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(
        F.sum(F.col(label)).cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum(F.col(label))).cast("long").alias("neg"))


def cumulative(counts: DataFrame, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Adds ``pos_before`` / ``neg_before``: counts strictly before each score in the chosen
    order (two-level prefix sum, see module doc)."""
    by = list(by)
    edges = counts.agg(F.percentile_approx("s", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("edges"))
    b = F.size(F.filter("edges", lambda e: e < F.col("s")))
    c = counts.crossJoin(F.broadcast(edges)).withColumn("b", -b if descending else b).drop("edges")   # one row
    key = -F.col("s") if descending else F.col("s")
    tot = c.groupBy(*by, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wb = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1) if by else \
        Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    # bucket totals: at most BUCKETS rows per group
    tot = tot.select(*by, "b", F.coalesce(F.sum("bp").over(wb), F.lit(0)).alias("pos_b"),
                     F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("neg_b"))
    wi = Window.partitionBy(*by, "b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = c.select(*by, "b", "s", "pos", "neg",
                     F.coalesce(F.sum("pos").over(wi), F.lit(0)).alias("pos_i"),
                     F.coalesce(F.sum("neg").over(wi), F.lit(0)).alias("neg_i"))
    j = inner.join(F.broadcast(tot) if not by else tot, [*by, "b"])
    return j.select(*by, "s", "pos", "neg", (F.col("pos_b") + F.col("pos_i")).alias("pos_before"),
                    (F.col("neg_b") + F.col("neg_i")).alias("neg_before"))


def auc(df: DataFrame, label: str = "label", score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with ties counted half: ``sum(pos * (neg_below + neg_tied / 2)) / (P * N)``."""
    cum = cumulative(score_counts(df, label, score, by), by)
    g = cum.groupBy(*by) if by else cum
    return g.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
                  / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"),
                 F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def curve_points(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Per distinct score (descending): tp, fp at threshold ``s`` (``p >= s``), fpr, tpr, precision, recall."""
    cum = cumulative(score_counts(df, label, score), descending=True)
    totals = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.crossJoin(F.broadcast(totals))
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    return j.select(F.col("s").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    (fp / F.nullif(F.col("N"), F.lit(0))).alias("fpr"),
                    (tp / F.nullif(F.col("P"), F.lit(0))).alias("tpr"),
                    (tp / (tp + fp)).alias("precision"),
                    (tp / F.nullif(F.col("P"), F.lit(0))).alias("recall"),
                    (F.col("pos") / F.nullif(F.col("P"), F.lit(0))).alias("recall_step"),
                    (F.col("P") / (F.col("P") + F.col("N"))).alias("prevalence"))


def average_precision(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Step-wise AP = sum over thresholds of (recall gain) * precision."""
    pts = curve_points(df, label, score)
    return pts.agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"),
                   F.first("prevalence").alias("prevalence"))


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "p",
                    grid: Sequence[float] = THRESHOLD_GRID) -> DataFrame:
    """Precision, recall, F1 of ``p >= t`` for every ``t`` of the grid (one pass, 17 groups)."""
    passed = sum((F.when(F.col(score) >= F.lit(t), 1).otherwise(0) for t in grid), F.lit(0))
    g = df.groupBy(passed.alias("k")).agg(F.sum(F.col(label)).alias("pos"),
                                          (F.count(F.lit(1)) - F.sum(F.col(label))).alias("neg"))
    row = g.agg(*[x for i in range(len(grid)) for x in (
        F.sum(F.when(F.col("k") > i, F.col("pos")).otherwise(0)).alias(f"tp{i}"),
        F.sum(F.when(F.col("k") > i, F.col("neg")).otherwise(0)).alias(f"fp{i}"))],
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    long = row.select("P", "N", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp")) for i, t in enumerate(grid)])).alias("r")).select("P", "N", "r.*")
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    return long.select("i", "threshold", "tp", "fp",
                       _z(tp / F.nullif(tp + fp, F.lit(0))).alias("precision"),
                       _z(tp / F.nullif(P, F.lit(0))).alias("recall"),
                       _z(2 * tp / F.nullif(tp + fp + P, F.lit(0))).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First maximum of F1 (lowest threshold among ties), the F1 at the grid point nearest 0.5,
    and the improvement."""
    best = sweep.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                              F.struct(F.col("f1"), -F.col("i"))).alias("b"),
                     F.min_by(F.col("f1"), F.struct(F.abs(F.col("threshold") - 0.5), F.col("i"))).alias("f1_default"))
    return best.select(F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"),
                       F.col("b.precision").alias("best_precision"), F.col("b.recall").alias("best_recall"),
                       "f1_default", (F.col("b.f1") - F.col("f1_default")).alias("f1_improvement"))


def spread_baseline(df: DataFrame, fit: DataFrame, col: str = "cds_spread") -> DataFrame:
    """Median and population std of ``col`` on ``fit`` (one broadcast row);
    ``pred`` = above the median (missing -> 0), ``p`` = logistic of the z-score (missing -> 0.5)."""
    from ..functions.stats import quantile_row
    med = quantile_row(fit, [col], [0.5], names=["med"]).withColumnRenamed(f"{col}_med", "_med")
    sd = fit.agg(F.stddev_pop(col).alias("_sd"))
    j = df.crossJoin(F.broadcast(med.crossJoin(sd)))
    x = F.col(col)
    z = (x - F.col("_med")) / (F.col("_sd") + F.lit(1e-6))
    p = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(0.5))
    return j.withColumns({"pred": F.when(x > F.col("_med"), 1).otherwise(0), "p": p}).drop("_med", "_sd")
