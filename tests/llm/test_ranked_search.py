import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from spreadwise.llm import ranked_search as rs
from spreadwise.llm.queries import op13_ranked_search

from .brute import ALNUM, lower_ascii

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(docs, items, k=50):
    terms = [ALNUM.findall(lower_ascii(t)) for _, t in docs]
    n_docs, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for ts in terms for t in set(ts))
    out = []
    for item, text in items:
        asked = set(ALNUM.findall(lower_ascii(text)))
        rows = []
        for (doc, _), ts in zip(docs, terms, strict=True):
            tf = Counter(ts)
            m = 50 + (50 * len(ts) * n_docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in asked if t in tf)
            if score > 0:
                rows.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if null else doc, -s) for i, (s, null, doc) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def made_up(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "ßtra", "naïve", "x" * 3000]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 120)))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)] + [(5, docs[5][1]), (5, docs[5][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,;\n"), (None, "w1 w2 w3 W250"), (None, None), (2003, "w1 " * 60_000 + "w290")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)] + [(7, "W0 w1"), (7, "W0 w1"), (None, "w3 w250"), (90, None), (91, "--"), (92, "nowhere")]
    return docs, items


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    docs, items = made_up()
    spark.createDataFrame(docs, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = op13_ranked_search(spark, str(tmp_path))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and [f.dataType for f in out.schema][1:] == [T.IntegerType(), T.LongType(), T.LongType()]
    assert got(out) == brute(docs, items)


@pytest.mark.parametrize("segment,block", [(2_000, 1 << 22), (8 << 20, 400)])
def test_any_segment_and_block_size_gives_the_same(spark, monkeypatch, segment, block):
    docs, items = made_up(9)
    monkeypatch.setattr(rs, "SEGMENT_BYTES", segment)
    out = rs.search_ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=7, block_bytes=block)
    assert got(out) == brute(docs, items, 7)


def test_empty_tables_clashing_columns_and_text_ids(spark):
    docs, items = made_up(2)
    none = rs.search_ranked(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS))
    assert none.count() == 0
    assert rs.search_ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    wide = spark.createDataFrame([(i, t, 1, "a", "b", 2) for i, t in docs], T.StructType([*DOCS.fields, *(T.StructField(n, t) for n, t in (
        ("item", T.LongType()), ("terms", T.StringType()), ("id", T.StringType()), ("score", T.LongType())))]))
    assert got(rs.search_ranked(wide, spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_blocks_that_cannot_reach_the_best_are_skipped():
    """Documents of 10,000 hold a common term; 30 of them, together, also a rare one: few others are met."""
    n = 10_000
    rare = np.arange(4_000, 4_030)
    docs = np.concatenate([np.arange(n), rare]).astype(np.int32)
    common = np.ones(n, np.int64)
    segment = rs.Segment(np.full(n, 50), pa.array(["common", "rare"]), np.array([n, len(rare)]), docs, np.concatenate([common, np.full(len(rare), 2)]),
                         np.arange(n), pa.array(["common", "rare"]), np.array([10, 5_000]), n, 50 * n)
    top, score, met = segment.best(np.array([0, 1]), 10)
    assert top.tolist() == rare[:10].tolist() and len(set(score.tolist())) == 1 and met < n // 10
