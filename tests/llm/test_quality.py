import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spreadwise.llm.quality import COUNTS, fit_votes, judge_quality, measure, posterior
from spreadwise.llm.queries import queries

from . import brute
from .conftest import SF


def test_base_columns_against_brute_force(spark, doc_rows):
    got = {r.doc_id: r for r in queries()["op9_quality"](spark, SF).collect()}
    assert len(got) == len(doc_rows)
    for i, t in doc_rows:
        n = brute.quality_counts(t)
        assert tuple(got[i])[1:6] == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)


def test_counts_of_odd_texts():
    rng = random.Random(6)
    texts = [None, "", "\n", "a\na\n", "\na \n a\na\n\n", "é é é é", "x"] + [
        "".join(rng.choice(["a", "b ", "\n", "é", " ", "#", "a b\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    found = measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(found[c][i]) for c in COUNTS[:5]) == brute.quality_counts(t), t
        w = brute.WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if brute.WORD.search(x)]
        assert (found["n_lines"][i], found["n_distinct_words"][i]) == (len(lines), len(set(w)))
        assert found["n_ended_lines"][i] == sum(brute.WORD.findall(x)[-1][-1] in ".!?:;\"')" for x in lines)
        assert found["n_symbol_words"][i] == sum("#" in x for x in w)


def slow_fit(votes, rounds=200):
    """The same expectation-maximisation, row by row."""
    rules, n = len(votes[0]), len(votes)
    good = [min(0.95, max(0.05, 0.5 + 0.4 * sum(v) / rules)) for v in votes]
    for _ in range(rounds):
        share = (1 + sum(good)) / (2 + n)
        p = [[[3.0, 1.0, 1.0] if c == 0 else [1.0, 1.0, 3.0] for _ in range(rules)] for c in (0, 1)]
        for v, g in zip(votes, good, strict=True):
            for r in range(rules):
                p[0][r][v[r] + 1] += 1 - g
                p[1][r][v[r] + 1] += g
        new = []
        for v in votes:
            like = [share if c else 1 - share for c in (0, 1)]
            for c in (0, 1):
                for r in range(rules):
                    like[c] *= p[c][r][v[r] + 1] / sum(p[c][r])
            new.append(like[1] / sum(like))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-10
        good = new
        if done:
            break
    return good


def test_fit_against_row_by_row_version(spark):
    out = judge_quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    want = slow_fit([r.votes for r in out])
    assert all(math.isclose(r.p_good, w, rel_tol=1e-6, abs_tol=1e-9) for r, w in zip(out, want, strict=True))


def test_fit_recovers_rule_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy = [0.95, 0.9, 0.75, 0.6, 0.85]
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where((rng.random(20000) < a) == truth, 1, -1)) for a in accuracy], axis=1)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    share, logs = fit_votes(patterns, n.astype(float))
    right = np.exp(logs[1][:, 2]) / (np.exp(logs[1][:, 2]) + np.exp(logs[1][:, 0]))
    assert abs(share - 0.7) < 0.02 and np.abs(right - accuracy).max() < 0.03
    true = np.log([[[0.8 * (a if (v > 0) == c else 1 - a) if v else 0.2 for v in (-1, 0, 1)] for a in accuracy] for c in (False, True)])
    hit = lambda share, logs: ((posterior(votes, share, logs) > 0.5) == truth).mean()
    assert hit(share, logs) > hit(0.7, true) - 0.002


def test_junk_goes_and_clean_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    r = got.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("clean"),
                F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("junk")).first()
    assert r.clean > 0.97 and r.junk < 0.1


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "a b c", 3), (2, "a b c", 3)]
    df = spark.createDataFrame(rows, "votes long, n_words string, p_good int")
    got = judge_quality(df.withColumnsRenamed({"votes": "key", "n_words": "body"}), "key", "body").collect()
    assert sorted(((r.key, r.n_words) for r in got), key=str) == [(1, 0), (2, 3), (2, 3), (None, 0)]
    assert judge_quality(df.limit(0).withColumnsRenamed({"votes": "key", "n_words": "body"}), "key", "body").collect() == []
