import random

import duckdb
from pyspark.sql import functions as F

from spreadwise.llm.decontaminate import find_benchmark_spans
from spreadwise.llm.queries import queries

from . import brute
from .conftest import SF


def digest(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", "items"), 256), F.col("n_hit") > 0).collect()), key=str)


def run(spark, rows, items, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return digest(find_benchmark_spans(docs, spark.createDataFrame(items, "item_id long, text string"), **kw))


def test_query_against_brute_force(spark, doc_rows):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = queries()["op10_decontaminate"](spark, SF).collect()
    want = brute.decontaminate(doc_rows, items)
    assert sorted(map(tuple, got)) == sorted(want) and any(r[-1] for r in want)


def test_random_texts_and_short_items(spark):
    rng = random.Random(4)
    words = lambda n, vocab="abc": " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, words(rng.choice([0, 2, 9, 10, 11, 60]))) for i in range(60)]
    items = [(i, words(rng.choice([0, 4, 6, 9, 10, 11, 15]))) for i in range(25)]
    assert run(spark, rows, items) == sorted(brute.decontaminate(rows, items), key=str)
    assert run(spark, rows, items, window=6, k=6) == sorted(brute.decontaminate(rows, items, 6), key=str)


def test_nulls_repeats_case_and_empty_tables(spark):
    t = "One two, three FOUR five-six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (None, t), (None, t), (3, "x " + t.upper() + " y"), (4, "... --- !!!"), (5, "é" * 3 + " one two")]
    items = [(7, t.lower()), (7, t.lower()), (11, t), (None, t), (8, None), (9, "..."), (10, "Two")]
    assert run(spark, rows, items) == sorted(brute.decontaminate(rows, items), key=str)
    assert run(spark, rows, []) == sorted(brute.decontaminate(rows, []), key=str)
    assert run(spark, [], items) == []
