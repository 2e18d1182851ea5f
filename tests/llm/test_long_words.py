"""Words built so that every polynomial hash modulo 2^64 takes them for equal (Thue-Morse words)."""
import numpy as np
import pyarrow as pa
import pytest

from spreadwise.llm.byte_lm import Group
from spreadwise.llm.decontaminate import drop_contaminated, find_benchmark_spans
from spreadwise.llm.frames import keyed
from spreadwise.llm.minhash_dedup import near_duplicate_classes
from spreadwise.llm.quality import measure
from spreadwise.llm.queries import vocabulary
from spreadwise.llm.substring_dedup import remove_repeated_passages
from spreadwise.llm.text import Words, utf8
from spreadwise.llm.token_file import Tokenizer
from spreadwise.llm.toxicity import text_terms

from . import brute


def twins(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


SIZES = [1024, 2048, 4096]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    a, b = twins(n)
    column = pa.array([f"{a} {b}", f"{b}\n{a}\n{a}"])
    h = Words(*utf8(column)).hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] != h[0]
    assert measure(column)["n_dup_lines"].tolist() == [0, 1]
    assert len(set(text_terms(pa.array([f"{a} {b}"]))[1].tolist())) == 2
    assert len(Group(pa.array([f"{a} {b}"])).words) == 3


def test_hash_depends_on_bytes_alone():
    words = ["", *("x" * i for i in range(1, 40)), *("y" * i + "x" for i in range(40)), "é", "日本語"]
    text = " ".join(words)
    a, b = Words(*utf8(pa.array([text]))).hashes(), Words(*utf8(pa.array(["zz " + text, "z"]))).hashes()[1:-1]
    assert np.array_equal(a, b) and len(set(a.tolist())) == len(set(filter(None, words)))


def test_passages_and_windows_with_twins(spark):
    a, b = twins(1024)
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([*rest[:20], a, *rest[20:]])), (2, " ".join([*rest[:20], b, *rest[20:]])), (3, " ".join([*rest[:20], a, *rest[20:]]))]
    got = {r.doc_id: r.n_removed for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 35, 2: 0, 3: 35}
    items = [(1, " ".join([a, *rest[:9]])), (2, a)]
    docs = [(1, " ".join([b, *rest[:9]])), (2, " ".join([a, *rest[:9]])), (3, b)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in find_benchmark_spans(*frames).collect()} == {1: 0, 2: 10, 3: 0}
    assert [tuple(r)[:3] for r in brute.decontaminate(docs, items)] == [(1, 10, 0), (2, 10, 10), (3, 1, 0)]


def test_near_duplicates_with_twins(spark):
    a, b = twins(1024)
    rows = [(i, " ".join([x] * 3 + [x + str(k) for k in range(12)])) for i, x in enumerate((a, b, a))]
    got = {r[0]: r[1] for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_tokens_of_twins():
    a, b = twins(1024)
    file = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer as Library
    library = Library.from_file(file)
    ids, n = Tokenizer(file, 2).encode(pa.array([f"{a} x", f"{b} x"]))
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in (f"{a} x", f"{b} x")]
    assert np.split(ids, np.cumsum(n))[0].tolist() == want[0] and np.split(ids, np.cumsum(n))[1].tolist() == want[1]


def test_row_key_tells_null_id_from_null_text(spark):
    rows = keyed(spark.createDataFrame([("x", None), (None, "x")], "doc_id string, text string"), "doc_id", "text").collect()
    assert (rows[0].k1, rows[0].k2) != (rows[1].k1, rows[1].k2)


def test_dropping_contaminated_rows_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 1, 2, "r"), (2, "clean", 1, 2, "r"), (3, None, 1, 2, "r")],
                                 "doc_id long, text string, hit_k1 long, k1 int, row string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    out = drop_contaminated(docs, items)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]
    assert drop_contaminated(docs, items.limit(0)).count() == 3
