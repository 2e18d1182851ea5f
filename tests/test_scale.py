"""Steps that must not repeat work or widen rows as the tables grow, on rows of their own."""
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spreadwise.plans.pipeline import Stages
from spreadwise.sources import fixtures as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(s, 900_000.0 + 37.13 * i * s, float(i % 50 + 1), (i % 11) / 100, (i % 9) / 100, "RAN"[i % 3], "OF"[i % 2], datetime(1996 + i % 4, 1 + i * s % 12, 1 + i % 28))
             for s in range(1, 9) for i in range(120)]
    items += [(3, None, 1.0, 0.05, None, None, "O", datetime(1997, 2, 1)), (None, 5.0, 1.0, 0.1, 0.1, "A", None, datetime(1997, 2, 1)), (4, 0.125, 2.0, 0.005, 0.02, "R", "O", None)]
    spark.createDataFrame(items, "l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, "
                                 "l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, f"S{i}", i % 5) for i in range(1, 9)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_inputs_come_from_one_read_of_the_line_items(spark, folder):
    st = Stages(spark, folder)
    for df in (st.raw_fundamentals, st.raw_prices, st.raw_spreads_wide, st.prices_clean):
        assert "lineitem.parquet" not in plan(df) and "firm_months" in plan(df)


def test_matrix_is_pivoted_by_one_aggregate(spark, folder):
    wide = Stages(spark, folder).raw_spreads_wide
    assert "pivotfirst" in plan(wide).lower() and dict(wide.dtypes)["01.01.11"] == "string"


def test_sums_of_a_month_are_those_of_decimals(spark, folder):
    li = fx.read_table(spark, folder, "lineitem")
    ep, qy, dc, tx = (F.col(f"l_{c}").cast(f"decimal({n},2)") for c, n in (("extendedprice", 12), ("quantity", 12), ("discount", 4), ("tax", 4)))
    of = lambda c, v: F.col(f"l_{c}") == v
    four, three, tenth, half = (F.lit(Decimal(x)) for x in ("0.4", "3", "0.1", "-0.5"))
    want = li.groupBy(F.col("l_suppkey").alias("gvkey"), F.add_months(F.trunc(F.to_date("l_shipdate"), "month"), fx.SHIFT_MONTHS).alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(of("returnflag", "R"), 1)).alias("n_r"), F.sum(ep).alias("s_ep"), F.sum(ep * (four + three * tx)).alias("s_lt"),
        F.sum(F.when(of("returnflag", "R"), half).otherwise(four) * ep * dc).alias("s_ni"), F.sum(F.when(~of("returnflag", "A"), ep)).alias("s_sale"),
        F.sum(F.when(of("linestatus", "O"), ep * tx)).alias("s_che"), F.sum(ep * dc).alias("s_epdc"), F.sum(ep * tx).alias("s_eptx"),
        F.sum(ep * (tenth + tx)).alias("s_lct"), F.sum(qy).alias("s_qy"), F.sum(dc * tx).alias("s_dctx"))
    got = fx.firm_months(spark, folder)
    a, b = (sorted((r.asDict() for r in d.select(*want.columns).collect()), key=lambda r: (str(r["gvkey"]), str(r["ms"]))) for d in (got, want))
    assert len(a) > 80 and a == b


def test_sketches_of_columns_meet_in_different_tasks(spark):
    from spreadwise.functions.stats import _sketches, quantiles
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b"), F.when(F.col("id") < 10, F.lit(float("nan"))).otherwise(-F.col("id")).alias("c"))
    s = _sketches(df, ["a", "b", "c"], [0.5], 100)
    assert "hashpartitioning(i" in plan(s) and {r.i: (r.n, r.least, r.most) for r in s.collect()} == {0: (1000, 0.0, 999.0), 2: (990, -999.0, -10.0)}
    assert [r["q"] for r in quantiles(df, ["a", "b", "c"], [0.5])] == [499.5, None, -504.5]


def test_sample_of_the_bins_leaves_other_rows_where_they_are(spark):
    from spreadwise.operators import boosting as B
    df = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(B.PRIME)).alias("draw"), F.col("id").cast("double").alias("a"))
    few = B.smallest_draws(df, 500)
    first = lambda d: [r.a for r in d.orderBy("draw", "a").limit(500).collect()]
    assert 500 <= few.count() < 520 and first(few) == first(df)
    assert B.smallest_draws(df, 30_000).count() == 20_000
    odd = df.withColumn("draw", F.when(F.col("a") < 3, None).otherwise(7))
    assert B.smallest_draws(odd, 2).count() == 3 and B.smallest_draws(odd, 5).count() == 20_000


def test_certificate_sums_rows_where_they_lie(spark):
    from spreadwise.operators import boosting as B
    from spreadwise.operators import certificates as K
    df = spark.range(400).select(F.pmod(F.xxhash64("id"), F.lit(B.PRIME)).alias("draw"), F.lit(0).alias("fold"), (F.col("id") % 3 == 0).cast("double").alias("label"),
                                 F.lit(1.0).alias("weight"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 6).cast("double").alias("b"))
    job = B.Job(B.Settings(trees=3, depth=2, columns=1.0))
    faults = K.split_faults(df, B.fit_many(df, ["a", "b"], [job])[0], job)
    assert "Generate" not in plan(faults) and [r.faults for r in faults.collect()] == [0, 0, 0]


def test_many_fits_of_few_rows_use_all_cores(spark, monkeypatch):
    from spreadwise.operators import boosting as B
    monkeypatch.setattr(B, "WORK_A_TASK", 100)
    seen, stage = [], B.stage_table
    monkeypatch.setattr(B, "stage_table", lambda df, name: seen.append(df.rdd.getNumPartitions()) or stage(df, name))
    df = spark.range(100).coalesce(1).selectExpr("id * 1000 AS draw", "0 AS fold", "double(id % 2) AS label", "1.0D AS weight", "double(id) AS a")
    B.fit_many(df, ["a"], [B.Job(B.Settings(trees=1, depth=1))] * 3)
    assert seen == [3]


def test_rounds_of_clusters_read_staged_rows(spark):
    from spreadwise.operators import unsupervised as U
    df = spark.range(60).repartition(3).selectExpr("id * 1000 AS draw", "double(id % 4) AS a")
    assert "Exchange" in plan(df) and "Exchange" not in plan(U.KMeans(df, ["a"], 2).x)
