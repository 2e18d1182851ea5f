import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from spreadwise.llm import personal_data as p
from spreadwise.llm.queries import op12_personal_data

from .conftest import SF

EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_base(text):
    """The contract's patterns, as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in digits(m[0])][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@-+ (09é%_", max_size=40))
def test_base_spans_are_the_patterns_matches(text):
    assert p.base_spans(text) == plain_base(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "255.256.1.1", "x@a.b", "@", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", " ", ".", "é", "0004.1.1.1", "\n"]), max_size=8))
def test_base_spans_of_joined_pieces(parts):
    assert p.base_spans("".join(parts)) == plain_base("".join(parts))


def test_no_pattern_is_quadratic():
    n = 300_000
    for text in ("1" * n, "a" * n, "1." * n, "+1" + " " * n, "a@" * n, "1 " * n, "a.b@c" * n):
        p.base_spans(text)


def exact(own, links, pair, known):
    total = np.zeros(own.shape)
    for y in itertools.product(range(p.N), repeat=len(own)):
        if any(k >= 0 and k != v for k, v in zip(known, y)):
            continue
        score = sum(own[i, v] for i, v in enumerate(y)) + sum(pair[k, y[a], y[b]] for a, b, k in links)
        total[np.arange(len(own)), y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def made(nodes, links, known, seed):
    rng = np.random.default_rng(seed)
    graph = p.Graph()
    graph.doc, graph.known, graph.links = [0] * nodes, known, links
    graph.rows, graph.cols = list(range(nodes)), list(range(nodes))
    node = np.zeros((p.WIDTH, p.N))
    node[:nodes] = rng.normal(size=(nodes, p.N))
    pair = rng.normal(size=(p.CHAIN + 1, p.N, p.N))
    pair[:p.CHAIN] = (pair[:p.CHAIN] + pair[:p.CHAIN].transpose(0, 2, 1)) / 2
    return p.Field(node, pair), graph, node[:nodes]


def test_messages_on_trees_are_exact():
    for seed, known in enumerate(([-1] * 5, [2, -1, -1, 0, -1], [-1, -1, 4, -1, 1])):
        model, graph, own = made(5, [(0, 1, p.CHAIN), (1, 2, p.CHAIN), (1, 3, 0), (3, 4, 2)], list(known), seed)
        assert np.allclose(model.marginals(graph), exact(own, graph.links, model.pair, known), atol=1e-3)


def test_messages_on_loops_are_near():
    links = [(0, 1, p.CHAIN), (1, 2, p.CHAIN), (2, 3, p.CHAIN), (0, 3, 0), (1, 3, 1)]
    model, graph, own = made(4, links, [-1, -1, -1, 1], 8)
    model.pair *= 0.5
    assert np.abs(model.marginals(graph, rounds=200) - exact(own, links, model.pair, [-1, -1, -1, 1])).max() < 0.08


def with_base():
    rows = duckdb.sql(f"select text from '{SF.replace('sf0.001', 'sf0.1')}/documents.parquet' where text is not null and length(text) < 10000").fetchall()
    return sorted({t for t, in rows if p.base_spans(t)})


def test_mentions_are_found_by_their_links_and_decoys_are_not():
    """Fitted on half of the texts; in the other half each datum is mentioned in another spelling."""
    texts = with_base()
    held = [t for t in texts if zlib.crc32(t.encode()) % 2]
    model = p.learn([t for t in texts if not zlib.crc32(t.encode()) % 2])
    unlinked = p.Field(model.node, model.pair * (np.arange(p.CHAIN + 1) == p.CHAIN)[:, None, None])
    rng, hit, all_, false, without = random.Random(3), 0, 0, 0, 0
    for t in held:
        longer, mentions = p.with_mentions(t, p.base_spans(t)[:6], rng)
        graph, _ = p.read_graph(pa.array([longer]))
        for m in (model, unlinked):
            got = p.added_spans(graph, m.marginals(graph), pa.array([longer]), 0.9).get(0, [])
            right = [any(k == k2 and lo < e and s < hi for k2, lo, hi, _ in got) for k, s, e in mentions]
            if m is model:
                hit, all_ = hit + sum(right), all_ + len(right)
                false += sum(not any(s < hi and lo < e for _, s, e in mentions) for _, lo, hi, _ in got)
            else:
                without += sum(right)
    assert hit >= 0.8 * all_ and false <= 0.01 * all_ and without < 0.3 * hit


def test_repeated_words_make_few_links():
    text = "und.34@mail7.example.com " + "und.34 98765432 " * 5_000
    graph, _ = p.read_graph(pa.array([text]))
    assert len(graph.links) < 4 * len(graph)


def digest(text, spans):
    return ",".join(f"{p.KINDS[k]}:{lo}:{hi}" for k, lo, hi in spans)


def test_query_equals_the_patterns_and_adds_to_them(spark, tmp_path):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows += [(90_000, None), (90_001, ""), (90_002, "é" * 50 + " 1.2.3.4 +1 (017) 555-7713 x 4111 1111 1111 1111 a.b@c.de"), (None, "1.2.3.4"), (rows[0][0], rows[0][1]),
             (90_003, "word 12 " * 60_000 + "a@b.c")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_personal_data(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        base = plain_base(t or "")
        want.append((i, *(sum(k == x for k, *_ in base) for x in range(4)), hashlib.sha256(digest(t, base).encode()).hexdigest(), digest(t, base)))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((w[:6] for w in want), key=str)
    spans = {(w[0], w[5]): set(filter(None, w[6].split(","))) for w in want}
    for r in got:
        mine = list(filter(None, r.spans.split(",")))
        key = lambda s: (p.KINDS.index(s.split(":")[0]), int(s.split(":")[1]))
        assert spans[r.doc_id, r.base_sha256] <= set(mine) and mine == sorted(mine, key=key)


def test_clashing_columns_empty_tables_and_no_base(spark):
    wide = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in ("id", "h", "kind", "spans", "n"))])
    docs = spark.createDataFrame([(1, "call +1 (017) 555-7713", *"abcde"), (2, "555-7713", *"abcde"), (2, None, *"abcde")], wide)
    got = {(r.doc_id, len(r.spans)) for r in p.find_personal_data(docs).collect()}
    assert got == {(1, 1), (2, 0)}
    assert p.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.spans for r in p.find_personal_data(spark.createDataFrame([(1, "12 34"), (2, None)], DOCS)).collect()] == [[], []]


@pytest.mark.parametrize("seed", [1, 2])
def test_fit_is_the_same_at_any_partitioning(spark, seed):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = p.fit_on(docs.repartition(3)), p.fit_on(docs.repartition(7 + seed))
    assert np.array_equal(a.node, b.node) and np.array_equal(a.pair, b.pair)
