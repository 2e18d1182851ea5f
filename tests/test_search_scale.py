"""The random search on many rows: what a level of the trees scans, and what goes along with it."""

import pickle
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadwise.operators import boosting as B
from spreadwise.operators import search

FEATS = ["a", "b", "c"]


def rows(spark, n=600):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    return (spark.range(n).repartition(3).select(F.pmod(F.xxhash64("id"), F.lit(B.PRIME)).alias("draw"), (F.col("id") % 3).cast("int").alias("fold"),
                                                 *[u(k).alias(c) for k, c in enumerate(FEATS)], (1 + u(7)).alias("weight"), u(8).alias("e"))
            .withColumn("label", (F.col("a") + F.col("b") * F.col("c") + F.col("e") > 1.2).cast("double")).drop("e"))


def levels_of(spark, monkeypatch, jobs):
    states, old = [], B._histograms
    monkeypatch.setattr(B, "_histograms", lambda state: states.append(pickle.dumps(state)) or old(state))
    B.fit_many(rows(spark), FEATS, jobs)
    return [(pickle.loads(s), len(s)) for s in states]


def test_a_level_scans_the_smaller_of_two_children(spark, monkeypatch):
    seen = 0
    for state, _ in levels_of(spark, monkeypatch, [B.Job(B.Settings(trees=2, depth=3, l1=0.0, columns=1.0))]):
        for t, nodes, _ in state["growing"].values():
            below = {k for x in nodes for k in range(len(t.feature)) if x in (t.left[k], t.right[k])}
            assert nodes == [0] or len(below) == len(nodes) > 0
            for k in below:
                [x] = set(nodes) & {t.left[k], t.right[k]}
                assert t.n[x] == min(t.n[t.left[k]], t.n[t.right[k]])
                seen += 1
    assert seen > 2


def test_a_level_does_not_carry_older_trees(spark, monkeypatch):
    sizes = [n for state, n in levels_of(spark, monkeypatch, [B.Job(B.Settings(trees=8, depth=1, l1=0.0))])]
    assert len(sizes) == 8 and max(sizes) < min(sizes) + 100


def test_fits_that_are_done_and_folds_left_out_are_not_carried(spark, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    jobs = [B.Job(B.Settings(trees=n, depth=2, l1=0.0), fold) for n in (2, 5) for fold in (0, 1)]
    levels = [s for s, _ in levels_of(spark, monkeypatch, jobs)]
    assert {len(s["places"]) for s in levels if s["tree"] < 2} == {2} and {len(s["places"]) for s in levels if s["tree"] >= 2} == {1}
    monkeypatch.undo()
    own = rows(spark)
    edges = B.bin_edges(own, FEATS)
    found = own.mapInArrow(B._stage_rows(FEATS, edges, 0), B._BLOCKS).rdd.mapPartitions(B._opened(3, 2, 1)).collect()
    assert sum(len(x["draw"]) for x in found) == 400 and all(1 not in x["fold"] and x["bins"].shape == (3, len(x["draw"])) and x["scores"].shape == (2, len(x["draw"])) for x in found)
    # together or alone, with other folds or without: the trees are the same
    monkeypatch.setattr(B, "REFRESH", 2)
    together = B.fit_many(own, FEATS, jobs)
    for job, one in zip(jobs, together, strict=True):
        [alone] = B.fit_many(own, FEATS, [job])
        assert [vars(t) for t in alone.trees] == [vars(t) for t in one.trees] and len(one.trees) == job.settings.trees


@pytest.mark.parametrize("scale", [1.0, 1e9, -1.0])
def test_sums_of_cells_are_exact(scale):
    rng = np.random.default_rng(1)
    columns, here = rng.integers(0, B.BINS, (4, 500)).astype(np.uint8), rng.integers(0, 3, 500)
    g, h = np.rint(rng.normal(size=500) * scale * 1e6), np.rint(rng.random(500) * scale * 1e6)
    want = np.zeros((3, 2, B.BINS, 3), np.int64)
    for r in range(500):
        for j, f in enumerate((1, 3)):
            want[here[r], j, columns[f, r]] += (int(g[r]), int(h[r]), 1)
    assert (B.cell_sums(columns, np.array([1, 3]), here, 3, g, h) == want).all()
    assert not B.cell_sums(columns[:, :0], np.array([1]), here[:0], 2, g[:0], h[:0]).any()


@pytest.mark.parametrize("splits", [0, 1, 40, 300])
def test_rows_end_where_the_steps_lead(splits):
    rng = np.random.default_rng(splits)
    t = B.Tree()
    t.add(0)
    for _ in range(splits):
        k = int(rng.choice([k for k, f in enumerate(t.feature) if f < 0]))
        t.split(k, int(rng.integers(0, 5)), int(rng.integers(0, B.BINS - 1)), 1.0, (0, 0, 0), (0, 0, 0))
    t.value = rng.normal(size=len(t.feature)).tolist()
    x = rng.integers(0, B.BINS, (700, 5)).astype(np.uint8)
    at = t.reach(x, max(t.depth) + 1)
    assert (t.ends(np.ascontiguousarray(x.T)) == at).all() and (t.score(np.ascontiguousarray(x.T)) == np.asarray(t.value)[at]).all()


def test_rows_are_binned_once_for_all_fits(spark, monkeypatch):
    calls, old = [], search.binned
    monkeypatch.setattr(search, "binned", lambda x, edges: calls.append(len(x)) or old(x, edges))
    jobs = [B.Job(B.Settings(trees=1, depth=1, l1=0.0), fold) for _ in range(2) for fold in range(3)]
    models = B.fit_many(rows(spark), FEATS, jobs)
    pdf = rows(spark).toPandas()
    batch = pa.RecordBatch.from_pydict({"x": pa.array(pdf[FEATS].to_numpy().tolist()), "fold": pa.array(pdf.fold), "label": pa.array(pdf.label.astype(int))})
    found = pa.Table.from_batches(search._left_out_scores(SimpleNamespace(value=models), jobs, 3)([batch])).to_pandas()
    assert calls == [600] and len(found) == 1200
    for i, job in enumerate(jobs):
        own = pdf[pdf.fold == job.fold]
        assert (found[found.fit == i].p.to_numpy() == models[i].margin(own[FEATS].to_numpy())).all() and (found[found.fit == i].label.to_numpy() == own.label).all()


def test_search_takes_the_margins_of_its_models(spark):
    grids = {"m": {"trees": [2, 3], "depth": [2], "l1": [0.0, 1.0]}}
    got = {(r.draw, r.fold): r.auc for r in search.boosted_search(rows(spark), FEATS, grids, 2, 3).collect()}
    pdf = rows(spark).toPandas()
    for i, s in enumerate(search.draw_settings(grids["m"], 2), 1):
        for fold in range(3):
            [m] = B.fit_many(rows(spark), FEATS, [B.Job(B.Settings(**s), fold)])
            own = pdf[pdf.fold == fold]
            p, y = m.margin(own[FEATS].to_numpy()), own.label.to_numpy()
            d = p[y == 1][:, None] - p[y == 0][None]
            assert abs(got[i, fold] - ((d > 0) + (d == 0) / 2).mean()) < 1e-9
