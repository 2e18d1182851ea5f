import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwise.llm import byte_lm
from spreadwise.llm.frames import crc_mod
from spreadwise.llm.queries import queries

from . import brute
from .conftest import SF

START, END = -1, 255


class BruteTrie:
    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            b = [START] * 4 + list(t.encode()) + [END]
            for i in range(4, len(b)):
                for d in range(5):
                    self.counts[tuple(b[i - d:i])][b[i]] += 1

    def score(self, t):
        b, total = [START] * 4 + list((t or "").encode()) + [END], 0.0
        for i in range(4, len(b)):
            out = set()
            for d in range(4, -1, -1):
                c = self.counts.get(tuple(b[i - d:i]), {})
                rest = {s: n for s, n in c.items() if s not in out}
                if not rest:
                    continue
                mass = sum(rest.values()) + len(rest)
                if b[i] in rest:
                    total += math.log10(rest[b[i]] / mass)
                    break
                total += math.log10(len(rest) / mass)
                out |= set(rest)
            else:
                total -= math.log10(256 - len(out))
        return total


def expected(rows, held):
    token = lambda t: brute.WORD.findall(brute.lower_ascii(t)) + [None]
    train = [(i, t) for i, t in rows if not held(i)]
    count = Counter(w for _, t in train for w in token(t))
    n, v = sum(count.values()), len(count)
    trie = BruteTrie([t or "" for _, t in train])
    return [(i, held(i), len(token(t)), sum(count[w] > 0 for w in token(t)), n,
             sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token(t)), trie.score(t)) for i, t in rows]


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-5, abs=1e-5)


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_query_against_brute_force(spark, doc_rows):
    same(queries()["op6_lm_scoring"](spark, SF).collect(), expected(doc_rows, lambda i: crc(i, 7) == 2))


@pytest.mark.parametrize("group_bytes,dense", [(300, 1 << 26), (300, 1), (10 ** 9, 1 << 26)])
def test_groups_and_shards_do_not_matter(spark, group_bytes, dense, monkeypatch):
    monkeypatch.setattr(byte_lm, "DENSE", dense)
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab éA\n") for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(byte_lm.score_texts(df, crc_mod("doc_id", 3) == 1, group_bytes=group_bytes).collect(), expected(rows, lambda i: crc(i, 3) == 1))


@pytest.mark.parametrize("fan,shards", [(2, 1), (3, 4)])
def test_requests_that_climb_several_levels(spark, fan, shards, monkeypatch):
    monkeypatch.setattr(byte_lm, "FAN", fan)
    monkeypatch.setattr(byte_lm, "SHARDS", shards)
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ab éA\n") for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(50)] + [(100 + i, "the same text") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(byte_lm.score_texts(df, crc_mod("doc_id", 3) == 1, group_bytes=250).collect(), expected(rows, lambda i: crc(i, 3) == 1))


def test_counts_beyond_32_bits_and_packed_keys():
    keys = np.array([0, 3, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (byte_lm.unpack(byte_lm.pack(keys)) == keys).all()
    for n in ([1, 2, 3, 4], [1, 1 << 40, 0, 7]):
        assert byte_lm._unpack_counts(byte_lm._pack_counts(np.array(n)), 4).tolist() == n


def test_nulls_repeats_no_training_rows_and_empty_table(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "Aa aa"), (None, "Aa aa"), (3, " \t")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, g string, score double, shard int")
    for flag in (False, True):
        same(byte_lm.score_texts(df, F.lit(flag), text_col="g").collect(), expected(rows, lambda i: flag))
    assert byte_lm.score_texts(df.limit(0), F.lit(False), text_col="g").collect() == []
