"""Queries of the model operators that need more than one fit: random search, model certificates, stored
bundles with thresholds and absent models, the feature file, principal components and k-means."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import boosting as B
from ..operators import certificates as K
from ..operators import feature_file as FF
from ..operators import metrics as M
from ..operators import search, unsupervised
from ..operators.model_store import load_models, prepare
from ..session import scratch_dir
from . import q_eval, q_ml
from .pipeline import Stages
from .q_ml import FEATS, MODELS, SCORE_SPEC, SEED, STORED_THRESHOLDS
from .registry import query

DRAWS, FOLDS = 15, 3


# ---------------------------------------------------------------- M7: random search ---------
def search_folds(st: Stages) -> DataFrame:
    """AUC of every drawn setting of both boosted models on each left-out fold; searched once."""
    table = st.__dict__.get("_search")
    if table is None:
        rows = q_ml.boosting_rows(st)
        table = st._search = st.cut(search.boosted_search(rows, st.feature_cols, search.GRIDS, DRAWS, FOLDS, SEED), "search_folds")
    return table


@query("ml_search", [("model", "s"), ("rank", "k"), ("draw", "k"), ("setting", "s"), ("mean_auc", 6), ("std_auc", 6), ("folds", "k")])
def ml_search(st: Stages) -> DataFrame:
    """M7: 15 settings a model from the full grids, each fitted on every choice of two folds."""
    return search.ranked_settings(search_folds(st))


@query("ml_search_check", [("model", "s"), ("settings", "k"), ("fits", "k"), ("bad", "k")],
       " UNION ALL ".join(f"SELECT '{m}' AS model, {DRAWS} AS settings, {DRAWS * FOLDS} AS fits, 0 AS bad" for m in search.GRIDS))
def ml_search_check(st: Stages) -> DataFrame:
    """Settings and fits of the search, and how many AUCs are missing or outside [0, 1]."""
    auc = F.col("auc")
    return search_folds(st).groupBy("model").agg(
        F.count_distinct("setting").alias("settings"), F.count(F.lit(1)).alias("fits"),
        F.count(F.when(auc.isNull() | (auc < 0) | (auc > 1), 1)).alias("bad"))


# ---------------------------------------------------------------- certificates --------------
GRADIENT = 2e-3


@query("ml_optimality", [("model", "s"), ("checks", "k"), ("off", "k")],
       f"SELECT 'Logistic Regression' AS model, {len(FEATS) + 1} AS checks, 0 AS off UNION ALL "
       + " UNION ALL ".join(f"SELECT '{m}' AS model, {s.trees} AS checks, 0 AS off" for m, s in q_ml.BOOSTED_SETTINGS.items()))
def ml_optimality(st: Stages) -> DataFrame:
    """M3, M5, M6: the logistic coefficients have a zero gradient, every tree's splits are the best of their
    rows and its leaves have the value their rows give. ``off`` counts parts and trees for which this fails."""
    train = q_ml.model_input(st).filter(F.col("split") == "train")
    lr = q_ml.fitted(st, "Logistic Regression")
    g = K.logistic_gradient(train, st.feature_cols, lr.coefficients.toArray().tolist(), lr.intercept, lr.getRegParam())
    out = g.agg(F.lit("Logistic Regression").alias("model"), F.count(F.lit(1)).alias("checks"),
                F.count(F.when(F.coalesce(F.abs("gradient") > GRADIENT, F.lit(True)), 1)).alias("off"))
    rows = q_ml.boosting_rows(st)
    for name, s in q_ml.BOOSTED_SETTINGS.items():
        f = K.split_faults(rows, q_ml.fitted(st, name), B.Job(s), SEED)
        out = out.unionByName(f.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("checks"), F.count(F.when(F.col("faults") > 0, 1)).alias("off")))
    return out


# ---------------------------------------------------------------- S12, S13 ------------------
@query("ml_stored_threshold", [("model", "s"), ("threshold", 6), ("rows", "k"), ("off", "k"), ("differs", "k")],
       " UNION ALL ".join(f"SELECT '{m}' AS model, {STORED_THRESHOLDS.get(m, 0.5)} AS threshold, count(*) AS rows, 0 AS off, "
                          f"{int(m in STORED_THRESHOLDS)} AS differs FROM split_tbl" for m in MODELS))
def ml_stored_threshold(st: Stages) -> DataFrame:
    """Models stored with their threshold and loaded again: rows whose decision is not p above it, and whether
    any decision differs from that at 0.5."""
    models, _ = load_models(st.spark, q_ml.stored(st), MODELS)
    data = prepare(st.spark, q_ml.stored(st), st.split, st.feature_cols)
    out = None
    for name, m in models.items():
        s = q_ml.score_table(m, data)
        at = STORED_THRESHOLDS.get(name, 0.5)
        r = s.agg(F.lit(name).alias("model"), F.lit(float(m.threshold)).alias("threshold"), F.count(F.lit(1)).alias("rows"),
                  F.count(F.when((F.col("p") > at).cast("long") != F.col("pred"), 1)).alias("off"),
                  F.max(((F.col("p") > 0.5).cast("long") != F.col("pred")).cast("int")).alias("differs"))
        out = r if out is None else out.unionByName(r)
    return out


@query("ml_model_roundtrip_tuned", SCORE_SPEC)
def ml_model_roundtrip_tuned(st: Stages) -> DataFrame:
    """Scores of a stored boosted model at its stored threshold."""
    return q_ml.reloaded_scores(st, q_ml.BOOSTED[:1])[q_ml.BOOSTED[0]]


def benchmark_of(st: Stages, root: str) -> DataFrame:
    """The baselines and those of the models that the bundle holds, each at its own threshold."""
    models, _ = load_models(st.spark, root, MODELS)
    base = q_eval._baselines(st)
    if not models:
        return base
    data = prepare(st.spark, root, st.split, st.feature_cols)
    return base.unionByName(q_ml.metric_rows({name: st.cut(q_ml.score_table(m, data), "stored_scores") for name, m in models.items()}))


_BENCH = [("Model", "s"), ("Type", "s"), ("Accuracy", 6), ("Precision", 6), ("Recall", 6), ("F1", 6), ("AUC", 6)]


@query("eval_benchmark_stored", _BENCH)
def eval_benchmark_stored(st: Stages) -> DataFrame:
    """A43 from a stored bundle."""
    return benchmark_of(st, q_ml.stored(st)).orderBy(F.desc("AUC"), "Model")


@query("eval_benchmark_absent", _BENCH, f"SELECT model AS Model, 'Baseline' AS Type, accuracy AS Accuracy, precision AS Precision, recall AS Recall, f1 AS F1, auc AS AUC FROM ({q_eval._ALL_BASE})",
       extra_ctes=q_eval.DRAW_CTES)
def eval_benchmark_absent(st: Stages) -> DataFrame:
    """The same report over a bundle folder that holds no model: its baseline rows."""
    return benchmark_of(st, f"{scratch_dir(st.spark).rstrip('/')}/models/none-{uuid.uuid4().hex}")


@query("eval_by_year_models", [("model", "s"), *q_eval.BY_YEAR])
def eval_by_year_models(st: Stages) -> DataFrame:
    """Yearly test metrics of every fitted model."""
    out = None
    for name in MODELS:
        s = q_ml.scores(st, name).filter(F.col("split") == "test").withColumn("year", F.year("date").cast("long")).withColumn("pred05", F.col("pred"))
        r = q_eval.by_year(s).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


@query("eval_report_models", [("model", "s"), ("metric", "s"), ("value", "s"), ("description", "s")])
def eval_report_models(st: Stages) -> DataFrame:
    """The report of the tree models: AUC, average precision, top feature and its importance, best and worst
    year, deviation of the yearly AUC."""
    importance = q_ml.ml_importance(st).filter("rank = 1").select("model", F.col("feature").alias("top"), "importance")
    y = eval_by_year_models(st).groupBy("model").agg(
        F.max(F.struct("auc", "year")).alias("best"), F.min(F.struct("auc", "year")).alias("worst"), F.stddev_samp("auc").alias("dev"))
    overall = None
    for name in q_ml.TREES:
        s = q_ml.scores(st, name).filter(F.col("split") == "test")
        r = M.auc(s).select(F.lit(name).alias("model"), "auc").crossJoin(M.average_precision(s).select("average_precision"))
        overall = r if overall is None else overall.unionByName(r)
    j = overall.join(importance, "model").join(y, "model")
    year = lambda c: F.format_string("%d (%.3f)", F.col(f"{c}.year"), F.col(f"{c}.auc"))
    lines = [("ROC AUC", F.format_string("%.4f", "auc"), "Area under ROC curve"), ("Average Precision", F.format_string("%.4f", "average_precision"), "Area under PR curve"),
             ("Top Feature", F.col("top"), "Most important feature"), ("Top Feature Importance", F.format_string("%.4f", "importance"), "Importance score"),
             ("Best Year (AUC)", year("best"), "Year with best AUC"), ("Worst Year (AUC)", year("worst"), "Year with worst AUC"),
             ("AUC Std Dev", F.format_string("%.4f", "dev"), "AUC stability across years")]
    return j.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(d).alias("description")) for m, v, d in lines])).alias("r")).select("model", "r.*")


# ---------------------------------------------------------------- S8: feature file ----------
def feature_file(st: Stages) -> str:
    """Where the list of model features is stored; written once, after the selection."""
    path = st.__dict__.get("_feature_file")
    if path is None:
        path = st._feature_file = f"{scratch_dir(st.spark).rstrip('/')}/features-{uuid.uuid4().hex}"
        FF.write_feature_list(st.spark, st.feature_cols, path)
    return path


@query("feature_projection", [("gvkey", "k"), ("date", "d"), *((c, "g10") for c in FEATS)], f"SELECT gvkey, date, {', '.join(FEATS)} FROM ml_dataset")
def feature_projection(st: Stages) -> DataFrame:
    """The labelled dataset, read by the columns that the stored list names."""
    return FF.project(st.ml_dataset, FF.read_feature_list(st.spark, feature_file(st)), keep=["gvkey", "date"])


# ---------------------------------------------------------------- section 2.12 --------------
def pca(st: Stages) -> tuple[np.ndarray, np.ndarray]:
    found = st.__dict__.get("_pca")
    if found is None:
        found = st._pca = unsupervised.principal_components(q_ml.model_input(st).filter(F.col("split") == "train"), st.feature_cols)
    return found


@query("ml_pca", [("component", "k"), ("variance", 6), ("share", 6), ("cumulative", 6), ("feature", "s"), ("loading", 4)])
def ml_pca(st: Stages) -> DataFrame:
    """Loadings of every component of the scaled train rows, with its explained variance."""
    value, vector = pca(st)
    share = value / max(value.sum(), 1e-300)
    rows = [(i + 1, float(value[i]), float(share[i]), float(share[:i + 1].sum()), f, float(w)) for i in range(len(value)) for f, w in zip(st.feature_cols, vector[i], strict=True)]
    return st.spark.createDataFrame(rows, "component int, variance double, share double, cumulative double, feature string, loading double")


_COV = ("sc_z AS (SELECT " + ", ".join(f"({c} - {c}_mu) / {c}_sd AS {c}" for c in FEATS) + " FROM sc_imp, sc_mom WHERE split = 'train'),\n"
        "sc_cov AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, covar_pop({a}, {b}) AS v FROM sc_z"
                                                         for i, a in enumerate(FEATS) for j, b in enumerate(FEATS)) + "))")


@query("ml_pca_moments", [("power", "k"), ("total", 4)], """
    SELECT 1 AS power, sum(v) AS total FROM sc_cov WHERE a = b
    UNION ALL SELECT 2, sum(v * v) FROM sc_cov
    UNION ALL SELECT 3, sum(x.v * y.v * z.v) FROM sc_cov x JOIN sc_cov y ON x.b = y.a JOIN sc_cov z ON y.b = z.a AND z.b = x.a""",
       extra_ctes=q_ml.TOP5_SQL_CTE + ",\n" + _COV)
def ml_pca_moments(st: Stages) -> DataFrame:
    """Sums of powers of the explained variances: traces of powers of the covariance matrix."""
    value, _ = pca(st)
    return st.spark.createDataFrame([(k, float((value ** k).sum())) for k in (1, 2, 3)], "power int, total double")


COMPONENTS = 5


@query("ml_pca_check", [("component", "k"), ("rows", "k"), ("off", "k")],
       f"SELECT c AS component, count(*) AS rows, 0 AS off FROM split_tbl, (SELECT unnest(range(1, {COMPONENTS + 1})) AS c) WHERE split = 'train' GROUP BY c")
def ml_pca_check(st: Stages) -> DataFrame:
    """Projected train rows: the variance of each component is the explained one, and it varies with no other."""
    value, vector = pca(st)
    names = [f"pc{i}" for i in range(1, COMPONENTS + 1)]
    train = unsupervised.component_scores(q_ml.model_input(st).filter(F.col("split") == "train"), st.feature_cols, vector, names)
    row = train.agg(F.count(F.lit(1)).alias("rows"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for a in names for b in names])
    off = lambda a, i: sum((F.abs(F.col(f"{a}_{b}") - (float(value[i]) if a == b else 0.0)) > 1e-3).cast("int") for b in names)
    return row.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), "rows", off(a, i).alias("off")) for i, a in enumerate(names)])).alias("r")).select("r.*")


CLUSTERS = 4


def kmeans(st: Stages) -> unsupervised.KMeans:
    found = st.__dict__.get("_kmeans")
    if found is None:
        found = st._kmeans = unsupervised.KMeans(q_ml.boosting_rows(st), st.feature_cols, CLUSTERS, SEED)
    return found


@query("ml_kmeans", [("gvkey", "k"), ("date", "d"), ("split", "s"), ("cluster", "k"), ("distance", 6)])
def ml_kmeans(st: Stages) -> DataFrame:
    """Cluster of every labelled row; centres are fitted on the train rows."""
    return kmeans(st).assign(q_ml.model_input(st)).select("gvkey", "date", "split", "cluster", "distance")


@query("ml_kmeans_check", [("rows", "k"), ("clusters", "k"), ("off", "k"), ("rises", "k"), ("off_centre", "k")],
       f"SELECT count(*) AS rows, {CLUSTERS} AS clusters, 0 AS off, 0 AS rises, 0 AS off_centre FROM split_tbl")
def ml_kmeans_check(st: Stages) -> DataFrame:
    """Against the stored centres: rows that lie nearer to another centre than to their own, rounds after which the
    total squared distance rose, and centres that are not the mean of their train rows."""
    km = kmeans(st)
    spark, feats = st.spark, st.feature_cols
    centres = st.cut(spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(km.centres)], "c int, centre array<double>"), "centres")
    rows = km.assign(q_ml.model_input(st)).withColumn("x", F.array(*[F.col(c).cast("double") for c in feats])).withColumn("row", F.xxhash64("gvkey", "date"))
    each = rows.crossJoin(F.broadcast(centres)).withColumn(                              # as many centres as clusters
        "d", F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    per = each.groupBy("gvkey", "date").agg(F.min("d").alias("least"), F.max(F.when(F.col("c") == F.col("cluster"), F.col("d"))).alias("own"))
    mean = rows.filter(F.col("split") == "train").select("cluster", F.posexplode("x").alias("j", "v")).groupBy("cluster", "j").agg(F.avg("v").alias("mean"))
    away = (mean.join(F.broadcast(centres), mean["cluster"] == centres["c"]).withColumn("gap", F.abs(F.col("mean") - F.element_at("centre", F.col("j") + 1)))
            .agg(F.count(F.when(F.col("gap") > 1e-3, 1)).alias("off_centre")))
    rises = sum(b > a * (1 + 1e-9) for a, b in zip(km.inertia, km.inertia[1:], strict=False))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(km.centres)).alias("clusters"),
                   F.count(F.when(F.coalesce(F.col("own") > F.col("least") + 1e-9, F.lit(True)), 1)).alias("off"), F.lit(rises).alias("rises")).crossJoin(F.broadcast(away))
