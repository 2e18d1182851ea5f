import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadwise.llm import language_id as L
from spreadwise.llm.frames import crc_mod
from spreadwise.llm.language_id import Trees, grams, identify_language
from spreadwise.llm.queries import queries
from spreadwise.llm.text import utf8

import pyarrow as pa


def brute_bits(train, text, order):
    """Code length of a text under a tree trained on texts, one symbol at a time."""
    counts = defaultdict(Counter)
    for t in train:
        b = b"\n" * order + t
        for i in range(order, len(b)):
            for d in range(order + 1):
                counts[b[i - d:i]][b[i]] += 1
    total, b = 0.0, b"\n" * order + text
    for i in range(order, len(b)):
        for d in range(order, -1, -1):
            c = counts.get(b[i - d:i])
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_against_brute_force(order):
    rng = random.Random(order)
    make = lambda al, n: "".join(rng.choice(al) for _ in range(n)).encode()
    train = [[make("abcd ", 300), make("ab", 40), b"", b"x"], [make("cdef\n", 300), make("é ", 30)]]
    tests = [make("abcdef \n", 80), b"", b"a", make("zé\x00", 20), make("ab", 3)]
    keys, lang, n = [], [], []
    for i, docs in enumerate(train):
        k, c = np.unique(np.concatenate([grams(*utf8(pa.array([d], pa.binary())), order) for d in docs]), return_counts=True)
        keys.append(k), n.append(c), lang.append(np.full(len(k), i))
    assert (np.concatenate([grams(*utf8(pa.array([d], pa.binary())), order) for d in train[0]]) == grams(*utf8(pa.array(train[0], pa.binary())), order)).all()
    trees = Trees(["p", "q"], order, np.concatenate(keys), np.concatenate(lang), np.concatenate(n).astype(float))
    got = trees.code_lengths(*utf8(pa.array(tests, pa.binary())))
    want = [[brute_bits(train[i], t, order) for i in range(2)] for t in tests]
    assert np.allclose(got, want, rtol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op5_language_id"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = got.join(truth, "doc_id").filter("held_out and lang_pred != 'und'").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert r.n > 150 and r.acc > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(i, "lorem ipsum " * 3, "la" if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = crc_mod("doc_id", 5) == 0
    a = identify_language(df, held).orderBy("doc_id").collect()
    b = identify_language(df.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))), held).orderBy("doc_id").collect()
    assert a == b and {r.lang_pred for r in a} == {"la"}


def test_nulls_no_letters_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 #_?", "en", "s"), (None, "the words", "en", "s"), (None, "the words", "en", "s"), (5, "é", None, "s")]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(df, F.lit(False)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None] == got[5] == ("en", 1.0)
    assert {(r.lang_pred, r.score) for r in identify_language(df, F.lit(True)).collect()} == {("und", 0.0)}
    assert identify_language(df.limit(0), F.lit(False)).collect() == []


def brute_query(rows, held, order=4):
    """The whole query: rows (id, text, lang). Learns from each distinct text of a language once."""
    texts = defaultdict(set)
    for i, t, lang in rows:
        if not held(i) and t is not None and lang is not None:
            texts[lang].add(t)
    out = []
    for i, t, _ in rows:
        if not texts or t is None or not re.search(r"[^\W\d_]", t):
            out.append((i, held(i), "und", 0.0))
            continue
        bits = {k: brute_bits([x.encode() for x in sorted(v)], t.encode(), order) for k, v in texts.items()}
        best = min(sorted(bits), key=bits.get)
        out.append((i, held(i), best, 1 / sum(2 ** (bits[best] - b) for b in bits.values())))
    return out


def test_query_against_brute_force(spark, tmp_path):
    rows = duckdb.sql("select doc_id, left(text, 400), lang from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit 60").fetchall()
    rows += [(1000 + i, f"zz yy {i % 3}", "zz") for i in range(9)] + [(2000, None, "zz"), (2001, "12", None), (2002, "", "de")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, h string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op5_language_id"](spark, str(tmp_path)).collect()}
    want = brute_query(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert len(got) == len(want)
    for i, held, lang, score in want:
        assert (got[i].held_out, got[i].lang_pred) == (held, lang) and math.isclose(got[i].score, score, rel_tol=1e-3, abs_tol=1e-6)


def test_sample_is_bounded_and_has_every_language(spark):
    rows = [("aa", f"text {i} of the large one " * 4) for i in range(3000)] + [("aa", "copy " * 9)] * 5000 + [("bb", "b" * 50_000)] + [("cc", "few")]
    df = spark.createDataFrame(rows, "lang string, text string")
    for bytes_ in (1, 1000, 20_000):
        own = defaultdict(list)
        for r in L.sample(df, bytes_).collect():
            own[r.lang].append(r.text)
        assert set(own) == {"aa", "bb", "cc"} and len(own["bb"][0]) == min(bytes_, 50_000) and len(set(own["aa"])) == len(own["aa"])
        assert sum(map(len, own["aa"])) <= 3 * bytes_ + 200
    # a language of far more than 2^20 times the sample keeps the share that the sample asks for
    assert L.MOST * 2_000_000 // (10 ** 15) > 1 << 30


def test_many_languages_within_bounded_memory(spark):
    rng = random.Random(1)
    word = lambda i: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) + chr(0x4E00 + i)
    vocab = [[word(i) for _ in range(30)] for i in range(200)]
    rows = [(k * 200 + i, " ".join(rng.choice(vocab[i]) for _ in range(25)), f"l{i:03d}") for i in range(200) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = L.train(df.select("lang", "text"), 4, 2_000_000, max_cells=200 * 20_000)
    assert len(trees.languages) == 200 and all(b.size <= 200 * 20_000 for b in trees.bits)
    out = identify_language(df, F.col("doc_id") >= 600).join(df.select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out and lang = lang_pred").count() > 190


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abc ") for _ in range(30_000)).encode()
    key, n = np.unique(grams(*utf8(pa.array([b"abc abd"], pa.binary())), 4), return_counts=True)
    trees = Trees(["p"], 4, key, np.zeros(len(key), np.int64), n.astype(float))
    column = pa.array([b"ab", text, b"", text[:7]], pa.binary())
    whole = trees.code_lengths(*utf8(column))
    monkeypatch.setattr(L, "CELLS_AT_ONCE", 1)
    assert np.allclose(trees.code_lengths(*utf8(column)), whole)
