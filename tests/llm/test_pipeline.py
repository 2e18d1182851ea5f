import duckdb
import pytest

import corpus_pipeline as P
from spreadwise.llm import sentencepiece_codec as S
from spreadwise.llm.frames import crc_mod
from spreadwise.llm.queries import vocabulary
from spreadwise.llm.toxicity import score_toxicity

from . import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, written and read as the driver does."""
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        out[name] = (before, docs)
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])
    assert P.ORACLE_SQL is None


def test_toxicity_drops_what_the_operator_marks(spark, stages):
    before, after = stages["toxicity"]
    marked = score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod("doc_id", 5) == 0).filter("predicted = 1")
    gone = {r.doc_id for r in marked.collect()}
    assert rows(after) == [r for r in rows(before) if r[0] not in gone] and gone


def test_near_dedup_against_all_pairs(stages):
    before, after = stages["near_dedup"]
    keep = {c for _, c in brute.near_classes([r[:2] for r in rows(before)])}
    assert rows(after) == [r for r in rows(before) if r[0] in keep] and len(keep) < before.count()


def test_substring_dedup_against_brute_force(stages):
    before, after = stages["substring_dedup"]
    want = {i: (n, sha) for i, _, n, sha in brute.substring_words([r[:2] for r in rows(before)], 35)}
    old = {r[0]: r for r in rows(before)}
    assert {r[0] for r in rows(after)} == set(old) and any(n for n, _ in want.values())
    for r in rows(after):
        n, sha = want[r[0]]
        assert (brute.sha(r[1]) == sha if n else r[1] == old[r[0]][1]) and r[4] == len(r[1]) and r[2:4] == old[r[0]][2:4]


def test_decontamination_against_brute_force(stages):
    before, after = stages["decontamination"]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in brute.decontaminate([r[:2] for r in rows(before)], items) if r[-1]}
    assert rows(after) == [r for r in rows(before) if r[0] not in bad] and bad


def test_sentencepiece_against_the_library(stages):
    before, after = stages["sentencepiece"]
    model = S.load(vocabulary("piece_bpe_32k.model"))
    want = [(r[0], len(ids := model.encode(r[1] or "") + [2]), ids, model.decode(ids)) for r in rows(before)]
    assert sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in after.collect()) == sorted(want)


def test_run_gives_the_last_stage(spark, stages):
    assert rows(P.run(spark, SF)) == rows(stages["sentencepiece"][1])


def test_stages_on_nulls_repeats_extra_columns_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(60))
    data = [(1, None, "en", "a", None, 0, "x"), (1, None, "en", "a", None, 0, "x"), (None, t, "en", "a", 3, 1, "y"), (None, t, "en", "a", 3, 1, "y"),
            (4, "", None, None, 0, 2, "z"), (5, "pre " + t, "de", "b", 9, 3, "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, k1 int, spans string")
    docs, counts = df, []
    for name, stage in P.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        counts.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == df.columns
    assert counts == [6, 4, 4, 4, 4]
    empty = df.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == []
