import random

from spreadwise.llm.queries import queries
from spreadwise.llm.substring_dedup import remove_repeated_passages

from . import brute
from .conftest import SF


def run(spark, rows, window, k, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeated_passages(df, window=window, k=k, **kw).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text)) for r in out), key=str)


def test_query_against_brute_force(spark, doc_rows):
    got = queries()["op1_substring_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring_words(doc_rows, 35))


def test_random_texts_from_a_tiny_vocabulary(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 7, 30, 200])))) for i in range(60)]
    for window, k in ((8, 4), (7, 7), (5, 1)):
        assert run(spark, rows, window, k) == sorted(brute.substring_words(rows, window), key=str)


def test_nulls_repeats_ties_and_empty_input(spark):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(1, None), (2, ""), (None, text), (None, text), (3, "a b"), (3, "x " + text), (4, "\t\n"), (5, "z " * 40)]
    assert run(spark, rows, 6, 3) == sorted(brute.substring_words(rows, 6), key=str)
    assert run(spark, [], 6, 3) == []


def test_clashing_columns_and_a_very_long_text(spark):
    long = " ".join(str(i % 70001) for i in range(90000))
    df = spark.createDataFrame([(1, long, 5, "q"), (2, "k1 k2", 6, "r")], "n_words long, spans string, k1 long, a string")
    out = {r.n_words_in: r for r in remove_repeated_passages(df.withColumnRenamed("n_words", "n_words_in"), "n_words_in", "spans", window=35).collect()}
    assert out[1].n_words == 90000 and out[1].n_removed == 2 * (90000 - 70001) and out[2].n_removed == 0
    assert len(out[1].removed) == 2
