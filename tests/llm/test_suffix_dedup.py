import random

import numpy as np
import pytest

from spreadwise.llm.queries import queries
from spreadwise.llm.suffix_dedup import equal_suffixes, remove_repeated_bytes

from . import brute
from .conftest import SF


def run(spark, rows, window, k, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeated_bytes(df, window=window, k=k, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out), key=str)


def test_query_against_brute_force(spark, doc_rows):
    got = queries()["op3_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_bytes(doc_rows, 200))


def test_sort_against_a_dictionary():
    rng = np.random.default_rng(3)
    for window in (8, 13, 40, 75, 200):
        text = rng.integers(97, 99, 3000, dtype=np.uint8)
        for _ in range(20):
            i, j = rng.integers(0, 2500, 2)
            text[j:j + 240] = text[i:i + 240][:len(text[j:j + 240])]
        start = np.arange(len(text) - window)
        group = start % 2
        keys = [(int(g), text[s:s + window].tobytes()) for s, g in zip(start, group)]
        seen = {}
        for x in keys:
            seen[x] = seen.get(x, 0) + 1
        assert equal_suffixes(text, start, group, window).tolist() == [seen[x] > 1 for x in keys]


@pytest.mark.parametrize("crowd", [0, 3, 2000])
def test_random_texts_with_shared_parts(spark, crowd):
    rng = random.Random(9)
    parts = ["".join(rng.choice("abé") for _ in range(rng.choice([9, 25, 60]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) + rng.choice("xyz") for _ in range(rng.choice([0, 1, 4, 9])))) for i in range(50)]
    assert run(spark, rows, 24, 10, crowd=crowd) == sorted(brute.substring_bytes(rows, 24), key=str)


def test_nulls_repeats_ties_and_empty_input(spark):
    rows = [(1, None), (2, ""), (None, "abcdefghijklmnop"), (None, "abcdefghijklmnop"), (3, "Zabcdefghijklm"), (4, "q" * 50)]
    assert run(spark, rows, 10, 4) == sorted(brute.substring_bytes(rows, 10), key=str)
    assert run(spark, [], 10, 4) == []


def test_a_text_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh") for _ in range(2_300_000))
    rows = [(1, base + base[1_000:900_000] + "$" + base[2_299_000:]), (2, base[500:2_000_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeated_bytes(df).collect()}
    assert got[2] == (len(rows[1][1]), len(rows[1][1]))
    assert got[1] == (len(rows[0][1]), 2_000_000 - 500 + 899_000 + 1000 + 1000)
