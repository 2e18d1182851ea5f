import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from spreadwise.llm import minhash_dedup as M
from spreadwise.llm.components import components, joined_components
from spreadwise.llm.queries import queries

from . import brute
from .conftest import SF


def classes(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=str)


def test_query_against_all_pairs(spark, doc_rows):
    got = queries()["op2_minhash_dedup"](spark, SF)
    want = sorted(brute.near_classes(doc_rows), key=str)
    assert classes(got) == want and any(a != b for a, b in want)
    kept = [r.doc_id for r in got.collect() if r.keep]
    assert sorted(kept) == sorted({c for _, c in want})


def test_same_dart_as_often_as_similarity():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(w if rng.random() > 0.03 else "x" for w in base), " ".join(base[:200] * 2), "a b c", "a b c d e f"]
    doc, key, weight = M.weighted(*M.shingles(pa.array(texts)))
    same = []
    for salt in range(30):
        sig, known = M.signatures(doc, M.mix64(key + M.U(salt)), weight, len(texts))
        assert known.all() and (sig != 0).all()
        same.append([(sig[0] == sig[j]).mean() for j in range(len(texts))])
    want = [brute.jaccard(brute.shingle_weights(texts[0]), brute.shingle_weights(t)) for t in texts]
    assert np.abs(np.mean(same, axis=0) - want).max() < 0.02
    assert np.allclose(M.similarity(pa.array([texts[0]] * 5), pa.array(texts)), want)


@pytest.mark.parametrize("crowd", [2, 24])
def test_large_groups_of_near_copies(spark, crowd):
    rng = random.Random(11)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(70):
            edits = rng.choice([0, 0, 1, 2, 3, 4, 6])
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, " ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes(M.near_duplicate_classes(df, crowd=crowd)) == sorted(brute.near_classes(rows), key=str)


def test_nulls_blanks_repeats_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (5, t), (5, t), (4, t), (7, t + " more"), (6, "one"), (8, "one"), (None, "lone")]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, node int, band int, u int")
    out = M.near_duplicate_classes(df).collect()
    assert sorted(((r.doc_id, r.class_id) for r in out), key=str) == sorted(brute.near_classes(rows), key=str)
    assert sorted((str(r.doc_id) for r in out if r.keep)) == sorted(map(str, [1, 1, 2, 3, 4, 6, None]))
    assert {r.doc_id: r.class_size for r in out}[5] == 4
    twice = M.near_duplicate_classes(df.filter("doc_id = 5")).collect()
    assert sorted(r.keep for r in twice) == [False, True]
    assert M.near_duplicate_classes(df.limit(0)).collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in links)}
    assert Counter(got.values())[1000] == 101
    # the same in two parts
    frame = lambda part: spark.createDataFrame(part, "u long, v long")
    again = joined_components(components(frame(links[::2])), frame(links[1::2]))
    assert {r.node: r.component for r in again.collect() if r.node in got} == got


def test_recall_of_every_fiftieth_row_against_all(spark):
    """Exact similarities of the rows with an id divisible by 50 to all rows that share a shingle with them."""
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    sets = {i: brute.shingle_weights(t) for i, t in rows if brute.WORD.search(t or "")}
    holders = defaultdict(list)
    for i, own in sets.items():
        for s in own:
            holders[s].append(i)
    links = set()
    for i in sets:
        if i % 50 == 0:
            size, met = sum(sets[i].values()), Counter(j for s in sets[i] for j in holders[s])
            for j, shared in met.items():
                other = sum(sets[j].values())
                if j != i and min(size, other) >= 0.8 * max(size, other) and brute.jaccard(sets[i], sets[j]) >= 0.8:
                    links.add((i, j))
    got = {r.doc_id: r.class_id for r in M.near_duplicate_classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(links) > 20 and all(got[i] == got[j] for i, j in links)
