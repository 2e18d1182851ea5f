"""Fitted models with the statistics that prepare their input, saved and loaded.

A bundle is a folder with one folder a model, the imputer's medians and the scaler's moments. A model's
folder holds the model and its decision: its name, what kind of model it is, and the threshold above which
its probability means 1. A model that is not there is skipped, whatever else the bundle holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees


@dataclass
class Scorer:
    """A fitted model and its decision threshold; scores rows that hold the features, by column and assembled."""

    model: object
    threshold: float = 0.5

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the probability ``p`` of class 1 and the decision ``pred``."""
        if isinstance(self.model, BoostedTrees):
            out = self.model.score(rows).drop("pred")
        else:
            scored = self.model.transform(rows)
            out = scored.select(*rows.columns, vector_to_array("probability")[1].alias("p"))
        return out.withColumn("pred", (F.col("p") > self.threshold).cast("long"))


def folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name.lower().replace(' ', '_').replace(',', '')}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark uses for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_bundle(root: str, medians: DataFrame, moments: DataFrame, models: Mapping[str, object], thresholds: Mapping[str, float] | None = None) -> None:
    """Write the imputer's medians, the scaler's moments (one row each) and every model with its threshold
    (0.5 if none is given). A model counts as stored once its decision is written, which is the last step."""
    spark = medians.sparkSession
    medians.write.parquet(f"{root}/imputer")
    moments.write.parquet(f"{root}/scaler")
    for name, m in models.items():
        at = folder(root, name)
        boosted = isinstance(m, BoostedTrees)
        if boosted:
            m.save(spark, f"{at}/model")
        else:
            PipelineModel(stages=[m]).write().save(f"{at}/model")
        threshold = float((thresholds or {}).get(name, 0.5))
        spark.createDataFrame([(name, "boosted" if boosted else "pipeline", threshold)], "name string, kind string, threshold double").coalesce(1).write.parquet(f"{at}/decision")


def load_models(spark: SparkSession, root: str, names: Sequence[str]) -> tuple[dict[str, Scorer], list[str]]:
    """The models that exist under ``root``, and the names of those that do not."""
    found, absent = {}, []
    for name in names:
        at = folder(root, name)
        if not exists(spark, f"{at}/decision/_SUCCESS"):
            absent.append(name)
            continue
        d = spark.read.parquet(f"{at}/decision").first()
        model = BoostedTrees.load(spark, f"{at}/model") if d.kind == "boosted" else PipelineModel.load(f"{at}/model")
        found[name] = Scorer(model, d.threshold)
    return found, absent


def prepare(spark: SparkSession, root: str, rows: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Impute and scale raw rows with the stored statistics, and assemble ``features``."""
    stats = spark.read.parquet(f"{root}/imputer").crossJoin(spark.read.parquet(f"{root}/scaler"))
    j = rows.crossJoin(F.broadcast(stats))                     # one row
    sd = lambda c: F.when(F.col(f"{c}_sd") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_sd"))
    j = j.withColumns({c: (F.coalesce(F.col(c), F.col(f"{c}_med")) - F.col(f"{c}_mu")) / sd(c) for c in feats}).select(*rows.columns)
    return VectorAssembler(inputCols=list(feats), outputCol="features").transform(j)
