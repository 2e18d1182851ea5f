"""Scores of a fitted model are made once, and the booster takes whole blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spreadwise.operators import boosting as B
from spreadwise.operators.model_store import Scorer
from spreadwise.plans import q_ml
from spreadwise.plans.pipeline import Stages


def _rows(spark, n=3000):
    x = F.col("id") % 17
    return spark.range(n).select(
        F.col("id").alias("gvkey"), F.lit("2014-03-31").cast("date").alias("date"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
        (x > 8).cast("int").alias("distress_flag"), x.cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 7).cast("double").alias("b"),
        F.pmod(F.xxhash64("id"), F.lit(B.PRIME)).alias("draw"), (F.col("id") % 3).cast("int").alias("fold"),
        (x > 8).cast("double").alias("label"), F.lit(1.0).alias("weight"))


def _model(spark):
    return B.fit_many(_rows(spark), ["a", "b"], [B.Job(B.Settings(trees=3, depth=2, l1=0.0, columns=1.0))])[0]


def test_scores_are_staged_once(spark):
    st = Stages(spark, "/none")
    name = q_ml.BOOSTED[0]
    st._models, st._model_input = {name: _model(spark)}, _rows(spark)
    got = q_ml.scores(st, name)
    assert q_ml.scores(st, name) is got
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "parquet" in plan.lower()
    assert got.count() == 3000


def test_a_score_is_made_once_and_only_its_features_leave(spark):
    out = Scorer(_model(spark), 0.45).score(_rows(spark))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    m = _model(spark)
    for r in out.filter("gvkey % 100 = 0").collect():
        p = 1 / (1 + np.exp(-m.margin(np.array([[r.a, np.nan if r.b is None else r.b]]))[0]))
        assert abs(r.p - p) < 1e-12 and r.pred == int(r.p > 0.45)


def test_booster_stages_blocks_not_rows(spark):
    rows = _rows(spark).withColumn("draw", F.when(F.col("gvkey") % 10 != 0, F.col("draw"))).coalesce(1)
    edges = B.bin_edges(rows, ["a", "b"])
    [r] = rows.mapInArrow(B._stage_rows(["a", "b"], edges, 2), B._BLOCKS).collect()
    assert r.rows == 3000 and len(r.bins) == 2 * 3000 and len(r.scores) == 2 * 3000 * 8
    draw = np.frombuffer(r.draw, np.int64)
    assert (draw == B.NO_DRAW).sum() == 300
    # a row without a draw is in no tree's sample
    tree = B.fit_many(rows, ["a", "b"], [B.Job(B.Settings(trees=1, depth=1, rows=1.0, l1=0.0, columns=1.0))])[0].trees[0]
    assert tree.n[0] == 2700
