import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spreadwise.llm.frames import crc_mod
from spreadwise.llm.queries import queries
from spreadwise.llm.toxicity import FREQUENT_SHARE, LEAST_GAIN, MIN_TEXTS, Machine, distinct, fit, likelihood_ratio, reject_toxic, score_toxicity, text_terms
from spreadwise.llm.text import U

from . import brute


def test_margin_against_all_pairs():
    rng = np.random.default_rng(2)
    m = Machine(np.arange(1, 9, dtype=U), rng.normal(size=8), rng.normal(size=(8, 3)), 0.3)
    docs = [[0, 3, 4], [], [7], list(range(8))]
    doc, row = np.repeat(np.arange(4), [len(d) for d in docs]), np.array(sum(docs, []))
    for got, d in zip(m.margin(doc, row, 4), docs, strict=True):
        want = 0.3 + sum(m.weight[i] for i in d) + sum(m.factor[i] @ m.factor[j] for i in d for j in d if i < j)
        assert abs(got - want) < 1e-9


def test_pairs_that_no_linear_model_can_learn():
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{rng.randrange(50)}" for _ in range(5)]))
        labels.append(float(a and b or not a and not b))
    column = pa.array(texts)
    doc, term = distinct(*text_terms(column))
    full = fit(doc, term, np.array(labels), l1=0.5, epochs=60, factor_rate=0.05, positive_weight=1.0)
    linear = fit(doc, term, np.array(labels), factors=0, l1=0.5, epochs=60, positive_weight=1.0)
    hit = lambda m: ((m.score(column) >= 0.5) == (np.array(labels) == 1)).mean()
    assert hit(full) > 0.95 and hit(linear) < 0.7


def test_likelihood_ratio():
    both, often, positive, n = 3, 5, 10, 40
    table = np.array([[3, 2], [7, 28]], float)
    want = 2 * sum(o * np.log(o * n / (table[i].sum() * table[:, j].sum())) for i in range(2) for j in range(2) for o in [table[i, j]])
    assert np.isclose(likelihood_ratio(np.array([both]), np.array([often]), positive, n)[0], want)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    p = queries()["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).filter("held_out").toPandas()
    pos, neg = p[p.toxic == 1].score.to_numpy(), p[p.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.95
    assert (neg >= 0.5).mean() < 0.01 and (pos >= 0.5).mean() > 0.75
    assert ((p.score >= 0.5) == (p.predicted == 1)).all()


def test_held_out_labels_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = crc_mod("doc_id", 5) == 0
    a = score_toxicity(docs, labels, held).orderBy("doc_id").collect()
    b = score_toxicity(docs.repartition(5), labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))), held).orderBy("doc_id").collect()
    assert a == b


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(i, "you idiot here" if i % 2 else "hello there", "x") for i in range(60)] + [(None, None, "y"), (100, "", "y"), (1, "you idiot here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels, F.lit(False)).collect()
    assert len(out) == 63 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id or 0) % 2 for r in out if r.doc_id is not None and r.doc_id < 60)
    blank = {r.doc_id: r.score for r in out}
    assert blank[None] == blank[100]
    for few in (labels.limit(0), labels.filter("toxic = 1")):
        assert len({r.score for r in score_toxicity(docs, few, F.lit(False)).collect()}) == 1
    assert score_toxicity(docs.limit(0), labels, F.lit(False)).collect() == []


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a word"), (2, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert reject_toxic(docs, labels, crc_mod("doc_id", 5) == 0).count() == 3
    assert reject_toxic(docs.limit(0), labels, crc_mod("doc_id", 5) == 0).count() == 0


def plain_scores(rows, labels, held, factors=4, epochs=16, batch=64, rate=1.0, l1=8.0, l2=1e-3, factor_rate=0.005, positive_weight=3.0, seed=7):
    """The whole query in plain loops: rows (id, text), labels {id: 0 or 1}."""
    words = lambda t: sorted(set(brute.ALNUM.findall(brute.lower_ascii(t))))
    name = lambda w: int(text_terms(pa.array([w]))[1][0])
    fitted = [(labels[i], words(t)) for i, t in sorted(rows, key=lambda r: str(r[0])) if i in labels and not held(i)]
    n, positive = len(fitted), sum(y for y, _ in fitted)
    often, both = Counter(w for _, ws in fitted for w in ws), Counter(w for y, ws in fitted if y for w in ws)

    def gain(w):
        a, k, total = both[w], often[w], 0.0
        for seen, row, column in ((a, k, positive), (k - a, k, n - positive), (positive - a, n - k, positive), (n - k - positive + a, n - k, n - positive)):
            total += 2 * seen * math.log(seen * n / (row * column)) if seen else 0
        return total
    kept = sorted((w for w in often if often[w] >= MIN_TEXTS and (gain(w) >= LEAST_GAIN or often[w] >= FREQUENT_SHARE * n)), key=name)
    at = {w: i for i, w in enumerate(kept)}
    share = (positive + 1) / (n + 2)
    bias, rng = math.log(share / (1 - share)), np.random.default_rng(seed)
    v = rng.normal(0, 0.01, (len(kept), factors)).tolist()
    w, z, g2, v2, b2 = [0.0] * len(kept), [0.0] * len(kept), [0.0] * len(kept), [[1e-2] * factors for _ in kept], 1.0
    texts = [(y, [at[x] for x in ws if x in at]) for y, ws in fitted]

    def chance(own):
        pairs = sum(v[i][f] * v[j][f] for k, i in enumerate(own) for j in own[:k] for f in range(factors))
        return 1 / (1 + math.exp(-(bias + sum(w[i] for i in own) + pairs)))
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            own = [texts[k] for k in order[lo:lo + batch]]
            error = [(chance(t) - y) * (positive_weight if y else 1.0) for y, t in own]
            b2 += sum(e * e for e in error)
            bias -= 0.1 * sum(error) / math.sqrt(b2)
            used = sorted({i for _, t in own for i in t})
            for i in used:
                g = sum(e for e, (_, t) in zip(error, own, strict=True) if i in t)
                was = math.sqrt(g2[i])
                g2[i] += g * g
                z[i] += g - (math.sqrt(g2[i]) - was) / rate * w[i]
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(g2[i])) / rate + l2)
            for f in range(factors):
                total = [sum(v[i][f] for i in t) for _, t in own]
                step = {i: sum(e * (s - v[i][f]) for e, s, (_, t) in zip(error, total, own, strict=True) if i in t) + l2 * v[i][f] for i in used}
                for i, g in step.items():
                    v2[i][f] += g * g
                    v[i][f] -= factor_rate * g / math.sqrt(v2[i][f])
    return {i: chance([at[x] for x in words(t) if x in at]) for i, t in rows}


def test_query_against_plain_loops(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = [], {}
    for i in range(260):
        toxic = rng.random() < 0.3
        own = rng.choices([f"w{k}" for k in range(40)], k=12) + (["Insult", "group"] if toxic else [rng.choice(["insult", "GROUP", "calm"])])
        rows.append((i, " ".join(rng.sample(own, len(own)))))
        if i % 6:
            labels[i] = int(toxic)
    rows += [(900, None), (901, ""), (902, "insult group unseen")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    want = plain_scores(rows, labels, held)
    got = {r.doc_id: r for r in queries()["op7_toxicity"](spark, str(tmp_path)).collect()}
    assert len(got) == len(want)
    for i, p in want.items():
        assert got[i].held_out == held(i) and math.isclose(got[i].score, p, rel_tol=1e-9, abs_tol=1e-12) and got[i].predicted == (p >= 0.5)
