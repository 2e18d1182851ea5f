"""Quantiles, ranking metrics, folds and attribution against plain versions."""
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwise.functions.exprs import draw_key, uniform
from spreadwise.functions.stats import quantile_table
from spreadwise.operators import attribution as A
from spreadwise.operators import metrics as M
from spreadwise.operators import profile as P
from spreadwise.plans.q_eval import improvement
from spreadwise.plans.q_ml import stratified_folds


def quantiles(df, cols, probs, **kw):
    return {(r["var"], r["p"]): r["q"] for r in quantile_table(df, cols, probs, **kw).collect()}


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_quantiles_of_more_values_than_the_sketch_holds(spark, partitions):
    n = 60_000
    df = spark.range(n).select(
        (F.hash("id") / 7.0).alias("x"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.sqrt("id")).alias("ties"),
        F.exp(F.randn(3)).alias("skew"), F.when(F.col("id") < 2, F.col("id").cast("double")).alias("two"), F.lit(None).cast("double").alias("none"))
    df = df.repartition(partitions, "id").cache()
    probs = [0.01, 0.5, 0.95, 1.0]
    got = quantiles(df, ["x", "ties", "skew", "two", "none"], probs, accuracy=200)
    pdf = df.toPandas()
    for c in ("x", "ties", "skew", "two"):
        for p in probs:
            assert math.isclose(got[(c, p)], pdf[c].quantile(p), rel_tol=1e-12, abs_tol=1e-12)
    assert ("none", 0.5) not in got or got[("none", 0.5)] is None
    df.unpersist()


def test_a_bracket_that_misses_its_rank_raises(spark):
    df = spark.range(100_000).select(F.hash("id").cast("double").alias("x")).repartition(16)
    with pytest.raises(Exception, match="misses its rank"):
        quantiles(df, ["x"], [0.313], accuracy=4, margin=0.0)


def brute_auc(pos, neg):
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", [1, 16])
def test_ranking_metrics_with_crowded_scores(spark, partitions):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), (rng.random() * 1e-5 if rng.random() < 0.99 else rng.choice([-3.0, 0.5, 40.0])), i % 3) for i in range(1500)]
    df = spark.createDataFrame(rows, "label int, p double, g int").repartition(partitions)
    split = lambda rs: ([p for y, p, _ in rs if y], [p for y, p, _ in rs if not y])
    assert math.isclose(M.auc(df).first().auc, brute_auc(*split(rows)), rel_tol=1e-9)
    for r in M.auc(df, by=["g"]).collect():
        assert math.isclose(r.auc, brute_auc(*split([x for x in rows if x[2] == r.g])), rel_tol=1e-9)
    ap, hits = 0.0, 0
    total = sum(y for y, _, _ in rows)
    for s in sorted({p for _, p, _ in rows}, reverse=True):
        tied = [y for y, p, _ in rows if p == s]
        above = [y for y, p, _ in rows if p >= s]
        hits = sum(above)
        ap += sum(tied) / total * hits / len(above)
    assert math.isclose(M.average_precision(df).first().average_precision, ap, rel_tol=1e-9)


def test_folds_differ_by_one_row_at_any_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("gvkey"), F.lit("2010-01-01").alias("date"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    deal = lambda d: {r.gvkey: r.fold for r in stratified_folds(d, "y", draw_key("gvkey", "date")).collect()}
    a, b = deal(df.repartition(1)), deal(df.repartition(13))
    assert a == b
    for y in (0, 1):
        sizes = [sum(1 for i, f in a.items() if (i % 7 == 0) == bool(y) and f == k) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_draws_are_uniform(spark):
    r = spark.range(20000).agg(F.avg(uniform(draw_key("id"))).alias("m"), F.max(uniform(draw_key("id"))).alias("x")).first()
    assert abs(r.m - 0.5) < 0.01 and r.x < 1


def brute_shapley(x, leaves, cover, n_features):
    """Shapley values of the cover-weighted conditional expectation of one tree."""
    node = {}
    for leaf, n in zip(leaves, cover):
        for d in range(len(leaf.splits) + 1):
            node[tuple(leaf.splits[:d])] = node.get(tuple(leaf.splits[:d]), 0) + n

    def value(known):
        total = 0.0
        for leaf in leaves:
            w = leaf.value
            for d, (f, t, left) in enumerate(leaf.splits):
                if f in known:
                    w *= (x[f] <= t) == left
                else:
                    w *= node[tuple(leaf.splits[:d + 1])] / node[tuple(leaf.splits[:d])]
            total += w
        return total
    phi = []
    for i in range(n_features):
        rest = [j for j in range(n_features) if j != i]
        phi.append(sum(math.factorial(k) * math.factorial(n_features - k - 1) / math.factorial(n_features) * (value(set(s) | {i}) - value(set(s)))
                       for k in range(n_features) for s in itertools.combinations(rest, k)))
    return phi, value(set())


TREE = """DecisionTreeRegressionModel: uid=dtr, depth=3, numNodes=9, numFeatures=4
  If (feature 0 <= 0.5)
   If (feature 2 <= -1.0E-3)
    Predict: 1.5
   Else (feature 2 > -1.0E-3)
    If (feature 0 <= 0.2)
     Predict: -2.0
    Else (feature 0 > 0.2)
     Predict: 0.25
  Else (feature 0 > 0.5)
   If (feature 1 <= 2.0)
    Predict: 3.0
   Else (feature 1 > 2.0)
    Predict: -1.0
"""


def test_tree_attribution_against_all_subsets():
    leaves = A.leaves_of(0, TREE, 1.0)
    assert [(x.value, len(x.splits)) for x in leaves] == [(1.5, 2), (-2.0, 3), (0.25, 3), (3.0, 2), (-1.0, 2)]
    rng = np.random.default_rng(4)
    train = rng.normal(size=(500, 4)) + [0.5, 2, 0, 0]
    cover = np.array([A.reached(train, x).sum() for x in leaves])
    assert cover.sum() == 500
    terms = A.leaf_terms(leaves, cover)
    rows = rng.normal(size=(20, 4)) + [0.5, 2, 0, 0]
    got = A.shapley(rows, terms)
    for x, phi in zip(rows, got):
        want, base = brute_shapley(x, leaves, cover, 4)
        assert np.allclose(phi, want) and math.isclose(base, A.base_value(terms), rel_tol=1e-12)


def test_correlation_against_pandas(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in (a, a * 2 + rng.normal(), rng.normal())) + (7.0,) for a in rng.normal(size=300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    want = df.toPandas().corr()
    got = {(r.feature1, r.feature2): r["corr"] for r in P.corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    assert len(got) == 6
    for (x, y), r in got.items():
        assert (r is None) if "k" in (x, y) else math.isclose(r, want.loc[x, y], rel_tol=1e-9)


def test_improvement_compares_the_rows_of_the_largest_auc(spark):
    df = spark.createDataFrame([("m1", "ML Model", 0.6, 0.2), ("m2", "ML Model", 0.7, 0.1), ("b1", "Baseline", 0.5, 0.0), ("b0", "Baseline", 0.5, 0.4)],
                               "Model string, Type string, AUC double, F1 double")
    got = {r.Metric: tuple(r)[1:] for r in improvement(df, ("AUC", "F1")).collect()}
    assert got["AUC"][:2] == ("m2", "b0") and math.isclose(got["AUC"][-1], 40.0)
    assert math.isclose(got["F1"][-2], -0.3) and math.isclose(got["F1"][-1], -75.0)


def test_parameters_of_fitting_rows_and_centuries(spark):
    from spreadwise.operators import clean, prep
    df = spark.createDataFrame([(1, "2010-03-31", 1.0, "a"), (1, "2010-06-30", None, "a"), (2, "2010-03-31", None, "a"), (3, "2011-03-31", 9.0, "b")],
                               "gvkey long, date string, niq double, part string")
    got = {r.gvkey: r.niq for r in prep.fill_medians(df, ["niq"], fit_on=F.col("part") == "a").filter("gvkey = 2").collect()}
    assert got == {2: 1.0}
    many = spark.range(101).select(F.col("id").cast("double").alias("price"), (F.col("id") <= 50).alias("old"))
    assert prep.winsorize(many, ["price"], fit_on=F.col("old")).agg(F.max("price")).first()[0] == 49.5
    cells = spark.createDataFrame([("A", "01.02.98", "1"), ("A", "01.02.15", "2")], "iqt string, date_str string, value string")
    assert sorted(r.date.year for r in clean.parse_spread_cells(cells, latest_year=2050).collect()) == [1998, 2015]
    assert sorted(r.date.year for r in clean.parse_spread_cells(cells).collect()) == [2015, 2098]
