import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from spreadwise.llm import token_file as M
from spreadwise.llm.queries import queries, vocabulary

from .conftest import SF

FILE = vocabulary("word_bpe_49k.json")


def library_ids(t):
    return Library.from_file(FILE).encode(t or "", add_special_tokens=False).ids + [2]


def expected(rows):
    """Rows in file order."""
    library, start, out = Library.from_file(FILE), 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, doc_rows):
    got = queries()["op8_token_file"](spark, SF).collect()
    assert sorted(map(tuple, got)) == expected(doc_rows)


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 6000])
def test_round_trip_of_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, int), rng.integers(0, 5, n), np.full(n, 65534), np.arange(n) % 700,
                np.minimum(rng.zipf(1.3, n), 49407)):
        blocks = M.encode_blocks(ids.astype(np.uint16))
        back = M.decode_blocks(blocks, [min(M.BLOCK, n - lo) for lo in range(0, n, M.BLOCK)])
        assert (back == ids).all()


def test_coder_profits_from_every_order():
    rng = np.random.default_rng(1)
    size = lambda ids: 8 * sum(map(len, M.encode_blocks(ids.astype(np.uint16)))) / len(ids)
    n = 40 * M.BLOCK
    assert size(rng.integers(0, 49408, n)) < 16.5
    # order 0: a cached id costs 8 bits instead of 16; 75 ids in 256 slots collide in a quarter of the cases
    assert size(rng.integers(0, 75, n)) < 0.75 * 8 + 0.25 * 16 + 1
    step = rng.permutation(60)                                      # far fewer than a block: it is reset between blocks
    chain = [0]
    for _ in range(n - 1):
        chain.append(int(step[chain[-1]]) if rng.random() < 0.9 else int(rng.integers(60)))
    assert size(np.array(chain)) < 0.4 * size(rng.permutation(chain))   # order 1
    assert size(np.tile([1, 2, 3, 1, 4, 2, 5], n // 7)) < 0.6       # two ids tell the next one, one id does not


def test_words_are_encoded_as_whole_texts():
    rng = random.Random(4)
    letters = ["a", "B", "it's", "'S", " ", "\t", "\n", "\x0b", "\x1c", " ", " ", "é", "é", "́", "Σ", "ς", "İ", "ß", "７", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "!?", "漢", "\x00", "ﬁ", "가", "가"]
    texts = [None, "", " "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    tokens = M.Tokenizer(FILE, 2)
    library = Library.from_file(FILE)
    for lo in range(0, len(texts), 500):
        part = texts[lo:lo + 500]
        ids, n = tokens.encode(pa.array(part, pa.string()))
        want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in part]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_table_that_overflows(monkeypatch):
    monkeypatch.setattr(M, "TABLE_ENTRIES", 30)
    tokens = M.Tokenizer(FILE, 2)
    for r in range(10):
        texts = [f"word{r}{i} and Word{i}, again" for i in range(20)]
        assert tokens.encode(pa.array(texts))[0].tolist() == sum(map(library_ids, texts[:1]), []) + tokens.encode(pa.array(texts[1:]))[0].tolist()


def test_nulls_ties_small_chunks_and_empty_table(spark, monkeypatch):
    rows = [(None, "b c"), (None, "b c"), (3, "same id"), (3, "same id"), (3, None), (-1, ""), (2, "x " * 5000), (9, "last")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, part int, start int")
    got = M.token_file_round_trip(df, FILE, 2, digests=True).collect()
    assert len(got) == len(rows)
    byid = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in byid] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    assert [r.start for r in byid] == np.cumsum([0] + [r.n_tokens for r in byid])[:-1].tolist()
    crc = lambda t: zlib.crc32(np.array(library_ids(t), "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in rows)
    ids = {r.doc_id: list(r.ids) for r in M.token_file_round_trip(df.filter("doc_id in (2, 9)"), FILE, 2).collect()}
    assert ids == {2: library_ids("x " * 5000), 9: library_ids("last")}
    assert M.token_file_round_trip(df.limit(0), FILE, 2).collect() == []


def test_damage_is_found(spark):
    df = spark.createDataFrame([(1, "some words here to damage")], "doc_id long, text string")
    row = M.write_token_file(df, FILE, 2).collect()[0].asDict()
    assert M.decode_chunk(row).tolist() == library_ids("some words here to damage")
    row["block_crc32"] = [row["block_crc32"][0] ^ 1]
    with pytest.raises(ValueError, match="damaged"):
        M.decode_chunk(row)


def test_order_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"t{rng.randrange(50)}" for _ in range(rng.randrange(30)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, F.rand(3))
    got = M.token_file_round_trip(df, FILE, 2, digests=True).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_words_in_groups_equal_the_library_one_by_one(monkeypatch):
    rng = random.Random(8)
    alphabet = "abcXYZ019.,!?-_'<|>&(~\x7f\x01é日İ½ßÀÿ×÷ªµ" + "\u0301"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    words += ["<|endoftext|>", "a<|startoftext|>b", "<|", "</w>", "it's", "</w</w>", "A" * 5000, "!" * 3000, "'", "don't", "x" * 300 + "."]
    words += [chr(c) * k for c in range(0xA1, 0x180) for k in (1, 3)] + ["É" + chr(c) + "a" for c in range(0xA1, 0x180)]
    tokens, library = M.Tokenizer(FILE, 2), Library.from_file(FILE)
    for group in (1, 7, 512):
        monkeypatch.setattr(M, "GROUP", group)
        ids, size = tokens.encode_words(words)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert tokens.encode_words([])[1].tolist() == []


def test_other_tokenizers_are_refused():
    for change in ("normalizer", "pre_tokenizer"):
        library = Library.from_file(FILE)
        setattr(library, change, None)
        with pytest.raises(ValueError):
            M.check_tokenizer(library)
    with pytest.raises(ValueError):
        M.Tokenizer(vocabulary("byte_bpe_50k.json"), 2)
