import random

import pytest

from spreadwise.llm import sentencepiece_codec as S
from spreadwise.llm.queries import queries, vocabulary

from . import brute
from .conftest import SF

MODEL = vocabulary("piece_bpe_32k.model")


def expected(rows):
    model = S.load(MODEL)
    out = []
    for i, t in rows:
        ids = model.encode(t or "") + [model.eos_id()]
        out.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(model.decode(ids))))
    return out


def test_query_against_the_library(spark, doc_rows):
    got = queries()["op4_sentencepiece"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(expected(doc_rows))


def odd_rows():
    rng = random.Random(1)
    letters = " ▁abé\n\t\x00\x01<s></s><unk>⁇　\U0001f600́ <0x41>"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30)))) for i in range(3000)]
    return rows + [(None, x) for x in (None, None, "", " ", "  ", "▁", "a ", " a", "﻿a", "\r\n", "é" * 500, " " * 900, "x" * 3000 + " y", "y" * 199 + " z")]


@pytest.mark.parametrize("entries", [10, 500_000])
def test_codec_on_odd_texts(monkeypatch, entries):
    monkeypatch.setattr(S, "TABLE_ENTRIES", entries)
    codec, rows = S.Codec(S.load(MODEL)), odd_rows()
    for lo in range(0, len(rows), 100):
        part = rows[lo:lo + 100]
        ids, texts = codec.encode([t or "" for _, t in part], 2)
        assert [(i, x.count(" ") + 1, brute.sha(x), brute.sha(d)) for (i, _), x, d in zip(part, ids, texts)] == expected(part)


def test_ids_nulls_repeats_and_empty_input(spark):
    rows = [(1, None, 3), (1, None, 3), (2, "Hello  wörld", 4), (None, " ", 5)]
    df = spark.createDataFrame(rows, "n_tokens_id long, ids string, decoded int")
    got = S.sentencepiece_round_trip(df, MODEL, "n_tokens_id", "ids").collect()
    assert sorted(((r.n_tokens_id, r.n_tokens, r.decoded) for r in got), key=str) == sorted(
        [(1, 1, ""), (1, 1, ""), (2, len(S.load(MODEL).encode("Hello  wörld")) + 1, "Hello  wörld"), (None, len(S.load(MODEL).encode(" ")) + 1, " ")], key=str)
    assert S.sentencepiece_round_trip(df.limit(0), MODEL, "n_tokens_id", "ids").collect() == []
