"""Search, certificates, components, k-means, feature file and bundles on small inputs."""
import copy
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from spreadwise.operators import boosting as B
from spreadwise.operators import certificates as K
from spreadwise.operators import feature_file as FF
from spreadwise.operators import metrics as M
from spreadwise.operators import search as R
from spreadwise.operators import unsupervised as U
from spreadwise.operators.model_store import load_models, save_bundle

from .test_boosting import BEST_FIRST, DEPTHWISE, FEATS, table


# ---------------------------------------------------------------- certificates --------------
def test_a_wrong_tree_turns_the_check_red(spark):
    rows = spark.createDataFrame(table())
    for job in (B.Job(DEPTHWISE), B.Job(BEST_FIRST), B.Job(DEPTHWISE, fold=2)):
        model = B.fit_many(rows, FEATS, [job])[0]
        faults = lambda m, job=job: {r.tree: r.faults for r in K.split_faults(rows, m, job).collect()}
        assert faults(model) == dict.fromkeys(range(4), 0)
        other = copy.deepcopy(model)
        other.trees[1].cut[0] = max(0, other.trees[1].cut[0] - 9)
        assert faults(other)[1] > 0
        leaf = model.trees[2].feature.index(-1)
        other = copy.deepcopy(model)
        other.trees[2].value[leaf] += 0.01
        assert faults(other)[0] == faults(other)[1] == 0 and faults(other)[2] > 0
        if job.settings.leaves is None:
            other = copy.deepcopy(model)
            other.trees[0].feature[0] = -1                      # a node that should have been split
            other.trees[0].value[0] = B.leaf_value(other.trees[0].g[0], other.trees[0].h[0], job.settings)
            assert faults(other)[0] > 0


def test_a_wrong_coefficient_turns_the_gradient_red(spark):
    rows = VectorAssembler(inputCols=FEATS, outputCol="features").transform(spark.createDataFrame(table())).withColumn("w_balanced", F.col("weight"))
    model = LogisticRegression(regParam=0.02, standardization=False, weightCol="w_balanced", maxIter=1000).fit(rows)
    coefs = model.coefficients.toArray().tolist()
    top = lambda c, b: K.logistic_gradient(rows, FEATS, c, b, 0.02).agg(F.max(F.abs("gradient"))).first()[0]
    assert top(coefs, model.intercept) < 2e-3
    assert top([coefs[0] + 0.05, *coefs[1:]], model.intercept) > 2e-3 and top(coefs, model.intercept - 0.05) > 2e-3


# ---------------------------------------------------------------- search --------------------
def test_search_scores_every_setting_on_every_fold_by_exact_auc(spark):
    pdf = table(400, 7)
    rows = spark.createDataFrame(pdf)
    grids = {"first": {"trees": [2, 3], "depth": [1, 2], "rate": [0.1, 0.3]}, "second": {"trees": [2], "leaves": [3, 4], "min_rows": [5, 40]}}
    by_fold = R.boosted_search(rows, FEATS, grids, draws=3).toPandas()
    assert len(by_fold) == 18 and by_fold.groupby(["model", "setting"]).fold.nunique().eq(3).all()
    model = {}
    for name, grid in grids.items():
        for i, s in enumerate(R.draw_settings(grid, 3), 1):
            for fold in range(3):
                model[name, i, fold] = B.fit_many(rows, FEATS, [B.Job(B.Settings(**s), fold)])[0] if i == 2 else None
    for r in by_fold.itertuples():
        if (m := model[r.model, r.draw, r.fold]) is not None:
            own = pdf[pdf.fold == r.fold]
            scored = spark.createDataFrame(pd.DataFrame({"label": own.label.astype(int), "p": m.margin(own[FEATS].to_numpy())}))
            assert math.isclose(M.auc(scored).first().auc, r.auc, rel_tol=1e-12)
    ranked = R.ranked_settings(spark.createDataFrame(by_fold)).toPandas()
    for name, own in ranked.groupby("model"):
        mean = by_fold[by_fold.model == name].groupby("draw").auc.mean()
        assert own[own["rank"] == 1].draw.item() == mean.idxmax() and sorted(own["rank"]) == [1, 2, 3]
        assert math.isclose(own[own["rank"] == 1].mean_auc.item(), mean.max())


def test_grids_are_whole():
    assert [math.prod(map(len, g.values())) for g in R.GRIDS.values()] == [3 ** 8, 3 ** 9]
    for name, grid in R.GRIDS.items():
        drawn = R.draw_settings(grid, 15)
        assert len({R.setting_text(s) for s in drawn}) == 15 and all(B.Settings(**s) for s in drawn)


# ---------------------------------------------------------------- components, k-means -------
@pytest.mark.parametrize("partitions", [1, 6])
def test_components_equal_numpy(spark, partitions):
    pdf = table(300, 8)
    z = (pdf[FEATS] - pdf[FEATS].mean()) / pdf[FEATS].std(ddof=0)
    df = spark.createDataFrame(pd.concat([z, pd.DataFrame({c: [np.nan if c == "a" else 1e6] for c in FEATS})])).repartition(partitions)
    value, vector = U.principal_components(df, FEATS)
    want = np.linalg.eigh(np.cov(z.to_numpy().T, ddof=0))
    assert np.allclose(value, want[0][::-1], atol=1e-5)
    assert np.allclose(np.abs(vector @ want[1][:, ::-1]), np.eye(4), atol=1e-3)
    assert all(v[np.abs(v).argmax()] > 0 for v in vector)
    assert U.principal_components(df.limit(0), FEATS)[0].tolist() == [0, 0, 0, 0]


def test_cross_products_of_large_values_are_exact(spark):
    x = np.array([[3e5, -2e5], [1e5, 7e5], [-4e5, 5.5]])
    n, sums, cross = U.gram(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"])
    assert n == 3 and np.array_equal(sums, x.sum(axis=0)) and np.array_equal(cross, x.T @ x)


def test_kmeans_is_a_fixed_point_at_any_partitioning(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (5, 0), (0, 5), (6, 6))])
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "draw": rng.integers(0, B.PRIME, len(x))})
    one = U.KMeans(spark.createDataFrame(pdf).coalesce(1), ["a", "b"], 4)
    many = U.KMeans(spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(9), ["a", "b"], 4)
    assert np.array_equal(one.centres, many.centres) and one.inertia == many.inertia
    assert all(b <= a for a, b in zip(one.inertia, one.inertia[1:]))
    got = one.assign(spark.createDataFrame(pdf)).toPandas()
    d = ((x[:, None, :] - one.centres[None]) ** 2).sum(axis=2)
    assert np.array_equal(got.cluster, d.argmin(axis=1)) and np.allclose(got.distance, d.min(axis=1))
    assert sorted(got.groupby("cluster").size()) == [60, 60, 60, 60]
    for c in range(4):
        assert np.allclose(one.centres[c], x[got.cluster == c].mean(axis=0), atol=1e-5)


def test_kmeans_with_empty_clusters_few_and_no_rows(spark):
    pdf = pd.DataFrame({"a": [0.0] * 8 + [1.0, 9.0, None], "draw": range(11)})
    df = spark.createDataFrame(pdf)
    km = U.KMeans(df, ["a"], 3)
    assert sorted(km.centres.ravel().tolist()) == [0.0, 1.0, 9.0] and km.inertia[-1] == 0
    km.centres = np.array([[0.0], [50.0], [60.0]])
    sums, count, cost, far = km._sums(km.centres)
    assert count.tolist() == [10, 0, 0] and [v.tolist() for v in far[:2]] == [[9.0], [1.0]]
    assert [r.cluster for r in km.assign(df).filter("a is null").collect()] == [None]
    assert len(U.KMeans(df.filter("a = 0"), ["a"], 3).centres) == 1
    assert len(U.KMeans(df.limit(0), ["a"], 3).centres) == 0


# ---------------------------------------------------------------- feature file --------------
def test_stored_list_decides_what_is_scanned(spark, tmp_path):
    spark.range(20).selectExpr("id as gvkey", "id * 1.0 as x1", "id * 2.0 as x2", "id * 3.0 as x3").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    scan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    FF.write_feature_list(spark, ["x3", "x1"], f"{tmp_path}/f")
    names = FF.read_feature_list(spark, f"{tmp_path}/f")
    assert names == ["x3", "x1"]
    text = scan(FF.project(t, names, ["gvkey"]))
    assert "x1" in text and "x3" in text and "x2" not in text
    FF.write_feature_list(spark, ["x2", " x2 ", ""], f"{tmp_path}/f")              # the list is changed
    names = FF.read_feature_list(spark, f"{tmp_path}/f")
    out = FF.project(t, names, ["gvkey"])
    assert out.columns == ["gvkey", "x2"] and "x1" not in scan(out)
    with pytest.raises(ValueError, match="x9"):
        FF.project(t, ["x1", "x9"])
    assert FF.project(t, ["x1", "x9"], absent="skip").columns == ["x1"]
    assert FF.project(t, ["x9"], ["gvkey"], absent="null").filter("x9 is null").count() == 20


# ---------------------------------------------------------------- bundles -------------------
def test_bundle_of_both_kinds_with_thresholds_and_an_absent_model(spark, tmp_path):
    pdf = table(200, 6)
    rows = VectorAssembler(inputCols=FEATS, outputCol="features").transform(spark.createDataFrame(pdf))
    models = {"Linear": LogisticRegression(maxIter=5).fit(rows), "Boosted Trees": B.fit_many(rows, FEATS, [B.Job(DEPTHWISE)])[0]}
    stats = spark.createDataFrame([(0.0,)], "x double")
    save_bundle(f"{tmp_path}/b", stats, stats, models, {"Boosted Trees": 0.3})
    found, absent = load_models(spark, f"{tmp_path}/b", ["Linear", "Boosted Trees", "Gone"])
    assert absent == ["Gone"] and {n: m.threshold for n, m in found.items()} == {"Linear": 0.5, "Boosted Trees": 0.3}
    for name, m in found.items():
        got = m.score(rows).toPandas()
        assert (got.pred == (got.p > m.threshold)).all() and set(rows.columns) < set(got.columns)
    p = 1 / (1 + np.exp(-models["Boosted Trees"].margin(pdf[FEATS].to_numpy())))
    assert np.allclose(found["Boosted Trees"].score(rows).toPandas().p, p)
    assert load_models(spark, f"{tmp_path}/nowhere", ["Linear"]) == ({}, ["Linear"])
