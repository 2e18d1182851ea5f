"""Every registered query with an oracle value-matches DuckDB on the smallest data set; model
queries (no oracle) run and return rows."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["supplier", "lineitem"]


def _norm(df):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, pd.Timestamp):
            return str(v.date())
        return str(v)
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


QUICK = ["target_by_year", "merge_panel", "pre_fill_median", "feat_drawdown", "target_flag", "quality_fundamentals",
         "profile_summary", "eval_auc", "eval_threshold_sweep", "eval_by_year", "attr_row_top5", "ml_scale"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert _norm(got) == _norm(exp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["year", "distress_events", "total_obs", "distress_rate"]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_model_scores_are_probabilities_and_auc_beats_chance(spark):
    from pyspark.sql import functions as F
    from spreadwise.operators import metrics
    df = E.queries()["ml_random_forest"](spark, "/root/testdata/sf0.01")
    assert df.filter((F.col("p") < 0) | (F.col("p") > 1)).count() == 0
    train = df.filter(F.col("split") == "train")
    assert metrics.auc(train).first().auc > 0.5
