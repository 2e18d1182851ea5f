"""M7: random search over a parameter grid with stratified cross-validation."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from . import metrics
from .boosting import Job, Settings, binned, fit_many

# The grids that are searched, by model
GRIDS = {
    "Boosted Trees": {
        "trees": [50, 75, 100], "depth": [2, 3, 4], "rate": [0.01, 0.03, 0.05], "min_hessian": [5.0, 10.0, 15.0],
        "rows": [0.5, 0.6, 0.7], "columns": [0.5, 0.6, 0.7], "l1": [1.0, 2.0, 5.0], "l2": [1.0, 2.0, 5.0]},
    "Boosted Trees, Large Leaves": {
        "trees": [50, 75, 100], "depth": [2, 3, 4], "rate": [0.01, 0.03, 0.05], "leaves": [4, 7, 15], "min_rows": [50, 100, 150],
        "rows": [0.5, 0.6, 0.7], "columns": [0.5, 0.6, 0.7], "l1": [1.0, 2.0, 5.0], "l2": [1.0, 2.0, 5.0]},
}


def draw_settings(grid: Mapping[str, Sequence], draws: int, seed: int = 42) -> list[dict]:
    """Distinct settings of the grid, drawn without replacement; the same for the same seed."""
    names = list(grid)
    total = prod(len(grid[n]) for n in names)
    out = []
    for i in random.Random(seed).sample(range(total), min(draws, total)):
        one = {}
        for n in names:
            i, k = divmod(i, len(grid[n]))
            one[n] = grid[n][k]
        out.append(one)
    return out


def random_search(train: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], draws: int = 15, folds: int = 3,
                  fold_col: str = "fold", label_col: str = "label", seed: int = 42, parallelism: int = 2) -> DataFrame:
    """Mean and deviation of the exact AUC over the folds of each drawn setting, best first.

    ``train`` carries the fold of each row (``stratified_folds``). Rows: ``(rank, draw, setting,
    mean_auc, std_auc)``; ties rank by draw.
    """
    settings = draw_settings(grid, draws, seed)
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in settings]
    exact = BinaryClassificationEvaluator(labelCol=label_col, metricName="areaUnderROC", numBins=0)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=exact, numFolds=folds, foldCol=fold_col, parallelism=parallelism)
    model = cv.fit(train.withColumn(fold_col, train[fold_col].cast("int")))
    rows = sorted(((-m, i) for i, m in enumerate(model.avgMetrics)))
    return train.sparkSession.createDataFrame(
        [(r + 1, i + 1, setting_text(settings[i]), float(-m), float(model.stdMetrics[i])) for r, (m, i) in enumerate(rows)],
        "rank int, draw int, setting string, mean_auc double, std_auc double")


def setting_text(s: Mapping) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(s.items()))


def _left_out_scores(models: Broadcast, jobs: Sequence[Job], width: int):
    """Log-odds of each row under the fits that left out its fold. The fits of a search share their bins: a row is binned once."""
    by_fold: dict[int, list[int]] = {}
    for i, job in enumerate(jobs):
        by_fold.setdefault(job.fold, []).append(i)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            fold, label = b.column("fold").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False)
            bins = binned(m, models.value[0].edges).T
            for left_out, fits in by_fold.items():
                own = np.flatnonzero(fold == left_out)
                columns = bins.take(own, axis=1)
                p = np.concatenate([models.value[i].margin_of_bins(columns) for i in fits])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(fits, np.int32), len(own))), pa.array(np.tile(label[own], len(fits))), pa.array(p)], names=["fit", "label", "p"])
    return scored


def boosted_search(train: DataFrame, feats: Sequence[str], grids: Mapping[str, Mapping[str, Sequence]], draws: int = 15, folds: int = 3,
                   seed: int = 42) -> DataFrame:
    """Random search of the regularised booster: every drawn setting of every model is fitted on every
    choice of ``folds`` - 1 folds and scored by exact AUC on the other.

    All fits (models x draws x folds) are grown side by side, each level of all trees that leave out the same fold by
    one scan of the other rows; the left-out rows' scores are one table, whose AUCs are one aggregate. ``train``: ``draw``, ``fold``, ``label``,
    ``weight`` and the features. Rows: ``(model, draw, setting, fold, auc)``.
    """
    spark = train.sparkSession
    drawn = [(model, i, s) for model, grid in grids.items() for i, s in enumerate(draw_settings(grid, draws, seed), 1)]
    jobs = [Job(Settings(**s), fold) for _, _, s in drawn for fold in range(folds)]
    models = fit_many(train, feats, jobs, seed)
    shared = spark.sparkContext.broadcast(models)                       # bounded by fits x trees x nodes
    x = F.array(*[F.col(c).cast("double") for c in feats])
    rows = train.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("long").alias("label"), x.alias("x"))
    table = stage_table(rows.mapInArrow(_left_out_scores(shared, jobs, len(feats)), "fit int, label long, p double"), "search")       # AUC is the same on log-odds
    auc = metrics.auc(table, by=["fit"])
    fits = [(k * folds + f, model, i, setting_text(s), f) for k, (model, i, s) in enumerate(drawn) for f in range(folds)]
    named = spark.createDataFrame(fits, "fit int, model string, draw int, setting string, fold int")
    return named.join(auc.select("fit", "auc"), "fit", "left").select("model", "draw", "setting", "fold", "auc")


def ranked_settings(by_fold: DataFrame) -> DataFrame:
    """Mean and deviation over the folds of each setting, best first within a model; ties rank by draw."""
    mean = by_fold.groupBy("model", "draw", "setting").agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("folds"))
    best = Window.partitionBy("model").orderBy(F.desc("mean_auc"), "draw")              # as many rows as draws
    return mean.withColumn("rank", F.row_number().over(best)).select("model", "rank", "draw", "setting", "mean_auc", "std_auc", "folds")
