"""One text of some megabytes among small ones: whole results, equal to plain versions."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spreadwise.llm.byte_lm import score_texts
from spreadwise.llm.decontaminate import find_benchmark_spans
from spreadwise.llm.language_id import identify_language
from spreadwise.llm.minhash_dedup import near_duplicate_classes
from spreadwise.llm.personal_data import find_personal_data
from spreadwise.llm.quality import COUNTS, measure
from spreadwise.llm.toxicity import score_toxicity

from . import brute
from .test_byte_lm import expected, same


def long_text(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"wort{i}" for i in range(5000)] + ["", "\n", "é", "12", "#x"]
    return " ".join(rng.choices(vocab, k=n))


@pytest.fixture(scope="module")
def text():
    return long_text(400_000)


def test_quality_counts(text):
    found = measure(pa.array(["a", text, None]))
    assert tuple(int(found[c][1]) for c in COUNTS[:5]) == brute.quality_counts(text)


def test_benchmark_windows_at_both_ends(spark, text):
    words = brute.ALNUM.findall(text)
    items = [(1, " ".join(words[:10])), (2, " ".join(words[-10:])), (3, " ".join(words[200_000:200_015])), (4, "not there at all")]
    got = find_benchmark_spans(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    want = {r[0]: r for r in brute.decontaminate([(1, text), (2, "x")], items)}
    assert all((rows[i].n_words, rows[i].n_hit, len(rows[i]["items"])) == want[i][1:4] for i in (1, 2)) and rows[1].n_hit >= 35


def test_near_copies(spark, text):
    changed = text[:1_000_000] + " other words here " + text[1_000_000:]
    rows = [(1, text), (2, changed), (3, long_text(400_000, 2)), (4, "small"), (5, text)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 5: (1, 3), 3: (3, 1), 4: (4, 1)}


def test_language_and_toxicity(spark, text):
    rows = [(i, "der wort1 und wort2" if i % 2 else "the words of it", "de" if i % 2 else "en") for i in range(40)] + [(100, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_language(df, F.col("doc_id") >= 30).collect()}
    assert got[100].lang_pred == "de" and got[100].score == 1.0 and len(got) == 41
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in score_toxicity(df, labels, F.lit(False)).collect()}
    assert len(scored) == 41 and 0 <= scored[100].score <= 1


def test_language_model(spark):
    rows = [(1, long_text(12_000)), (2, "wort1 wort2"), (3, None)]
    same(score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 2).collect(), expected(rows, lambda i: i == 2))


def test_personal_data_far_apart(spark, text):
    body = f"a.b@c.de {text} +1 (017) 555-7713 {text[:100]} 1.2.3.4"
    r = find_personal_data(spark.createDataFrame([(1, body)], "doc_id long, text string")).first()
    base = [s for s in r.spans if s.base]
    assert [body[s.start:s.end] for s in base] == ["a.b@c.de", "1.2.3.4", "+1 (017) 555-7713"]
