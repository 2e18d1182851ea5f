"""The regularised booster against a plain one, and its bookkeeping."""
import math
import random

import numpy as np
import pandas as pd
import pytest

from spreadwise.operators import boosting as B

FEATS = ["a", "b", "c", "d"]


def table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float), "c": rng.exponential(size=n), "d": np.round(rng.normal(size=n), 1)})
    odds = 1.5 * (pdf.a > 0.2) * (pdf.b > 3) - 0.8 * (pdf.c > 1) + 0.4 * pdf.d
    pdf["label"] = (rng.random(n) < 1 / (1 + np.exp(-odds))).astype(float)
    pdf["weight"] = np.where(pdf.label == 1, 1.7, 1.0)
    pdf["draw"] = rng.integers(0, B.PRIME, n)
    pdf["fold"] = rng.integers(0, 3, n)
    return pdf


def plain_booster(pdf, s, fold, edges, seed=42):
    """One row and one candidate at a time; trees as nested tuples (feature, edge, left, right) or values."""
    x = pdf[FEATS].to_numpy()
    rows = [i for i in range(len(pdf)) if fold is None or pdf.fold[i] != fold]
    margin = [0.0] * len(pdf)
    out = []

    def part(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    def value(g, h):
        return -s.rate * math.copysign(max(abs(g) - s.l1, 0), g) / (h + s.l2)

    for t in range(s.trees):
        rng = random.Random(seed * 1_000_003 + t)
        m, k = rng.randrange(1, B.PRIME), rng.randrange(B.PRIME)
        use = [i for i in rows if (int(pdf.draw[i]) * m + k) % B.PRIME < s.rows * B.PRIME]
        cols = sorted(random.Random(seed * 1_000_003 + t + 500_009).sample(range(len(FEATS)), max(1, round(s.columns * len(FEATS)))))
        p = {i: 1 / (1 + math.exp(-margin[i])) for i in use}
        g = {i: round((p[i] - pdf.label[i]) * pdf.weight[i] * B.POINT) / B.POINT for i in use}
        h = {i: round(p[i] * (1 - p[i]) * pdf.weight[i] * B.POINT) / B.POINT for i in use}
        tot = lambda own: (sum(g[i] for i in own), sum(h[i] for i in own))

        def find(own):
            best = None
            for f in cols:
                for e in edges[f]:
                    left, right = [i for i in own if x[i, f] <= e], [i for i in own if x[i, f] > e]
                    if min(len(left), len(right)) < max(s.min_rows, 1) or min(tot(left)[1], tot(right)[1]) < s.min_hessian:
                        continue
                    gain = part(*tot(left)) + part(*tot(right)) - part(*tot(own))
                    if gain > B.LEAST_GAIN and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, e, left, right)
            return best

        # nodes in growing order: [rows, depth, split or None, children]
        nodes = [[use, 0, find(use), None]]
        leaves = 1
        while True:
            open_ = [k for k, nd in enumerate(nodes) if nd[2] and nd[3] is None and nd[1] < s.depth]
            if not open_ or (s.leaves is not None and leaves >= s.leaves):
                break
            k = max(open_, key=lambda k: (nodes[k][2][0], -k)) if s.leaves is not None else open_[0]
            for own in nodes[k][2][3:]:
                nodes.append([own, nodes[k][1] + 1, find(own) if nodes[k][1] + 1 < s.depth else None, None])
            nodes[k][3] = (len(nodes) - 2, len(nodes) - 1)
            leaves += 1

        def nested(k):
            own, _, split, children = nodes[k]
            return (split[1], float(split[2]), nested(children[0]), nested(children[1])) if children else value(*tot(own))

        def score(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree
        tree = nested(0)
        out.append(tree)
        for i in range(len(pdf)):
            margin[i] += score(tree, x[i])
    return out


def nested(model, t, k=0):
    f = t.feature[k]
    return t.value[k] if f < 0 else (f, float(model.edges[f][t.cut[k]]), nested(model, t, t.left[k]), nested(model, t, t.right[k]))


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)


DEPTHWISE = B.Settings(trees=4, depth=3, rate=0.3, min_hessian=2.0)
BEST_FIRST = B.Settings(trees=4, depth=4, rate=0.2, rows=0.7, columns=0.8, l1=0.5, l2=1.0, min_rows=15, leaves=5)


def test_trees_equal_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    pdf = table()
    jobs = [B.Job(DEPTHWISE), B.Job(BEST_FIRST), B.Job(DEPTHWISE, fold=1)]
    models = B.fit_many(spark.createDataFrame(pdf).repartition(5), FEATS, jobs)
    for job, model in zip(jobs, models, strict=True):
        want = plain_booster(pdf, job.settings, job.fold, model.edges)
        got = [nested(model, t) for t in model.trees]
        assert len(got) == len(want) and all(map(same, got, want)), (job, got, want)
        for t in model.trees:
            leaves = [k for k, f in enumerate(t.feature) if f < 0]
            assert len(t.feature) == 2 * len(leaves) - 1 and max(t.depth) <= job.settings.depth
            assert (job.settings.leaves is None or len(leaves) <= job.settings.leaves) and all(t.n[k] >= job.settings.min_rows for k in leaves)
            # totals of the leaves are those of the root
            assert [sum(getattr(t, x)[k] for k in leaves) for x in ("g", "h", "n")] == [t.g[0], t.h[0], t.n[0]]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_splits_do_not_depend_on_partitions(spark, partitions):
    pdf = table(800, 9)
    a = B.fit_many(spark.createDataFrame(pdf).coalesce(1), FEATS, [B.Job(BEST_FIRST)])[0]
    b = B.fit_many(spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(partitions), FEATS, [B.Job(BEST_FIRST)])[0]
    assert [vars(t) for t in a.trees] == [vars(t) for t in b.trees]


def test_sums_in_two_steps_are_the_same(spark, monkeypatch):
    pdf = table(300, 4)
    a = B.fit_many(spark.createDataFrame(pdf), FEATS, [B.Job(DEPTHWISE)])[0]
    monkeypatch.setattr(B, "isqrt", lambda n: 12)
    b = B.fit_many(spark.createDataFrame(pdf).repartition(6), FEATS, [B.Job(DEPTHWISE)])[0]
    assert [vars(t) for t in a.trees] == [vars(t) for t in b.trees]


def test_stored_model_scores_alike_and_follows_its_threshold(spark, tmp_path):
    pdf = table(300, 5)
    df = spark.createDataFrame(pdf)
    model = B.fit_many(df, FEATS, [B.Job(BEST_FIRST)])[0]
    model.threshold = 0.45
    model.save(spark, str(tmp_path / "m"))
    again = B.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert again.threshold == 0.45 and [vars(t) for t in again.trees] == [vars(t) for t in model.trees]
    rows = again.score(df).collect()
    want = 1 / (1 + np.exp(-model.margin(pdf[FEATS].to_numpy())))
    assert np.allclose([r.p for r in rows], want) and all(r.pred == (r.p > 0.45) for r in rows)
    assert math.isclose(sum(model.importances()), 1.0)


def test_l1_and_l2_shrink_and_rows_limit():
    cells = np.zeros((1, B.BINS, 3), np.int64)
    cells[0, 0], cells[0, 1] = (-8 * B.POINT, 4 * B.POINT, 20), (3 * B.POINT, 4 * B.POINT, 20)
    f = np.array([0])
    gain = lambda **k: B.best_split(cells, f, B.Settings(**k))
    assert math.isclose(gain(l1=0, l2=0)[2], 64 / 4 + 9 / 4 - 25 / 8)
    assert math.isclose(gain(l1=2, l2=2)[2], 36 / 6 + 1 / 6 - 9 / 10)
    assert gain(l1=2, l2=2, min_rows=21) is None and gain(l1=2, l2=2, min_hessian=4.5) is None and gain(l1=9, l2=2) is None


def test_empty_and_one_sided_tables(spark):
    df = spark.createDataFrame(table(40))
    for rows in (df.limit(0), df.withColumn("label", df.label * 0)):
        model = B.fit_many(rows, FEATS, [B.Job(B.Settings(trees=2))])[0]
        assert len(model.trees) == 2 and model.score(df).count() == 40
