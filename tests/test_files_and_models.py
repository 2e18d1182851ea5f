"""CSV dialects, stored models, random search and plan shapes on small inputs."""
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from spreadwise import schemas as S
from spreadwise.functions.exprs import draw_key
from spreadwise.operators import clean, features, merge, prep, target
from spreadwise.operators.model_store import load_models, prepare, save_bundle
from spreadwise.operators.search import draw_settings, random_search
from spreadwise.plans.q_ml import stratified_folds
from spreadwise.plans.pipeline import Stages
from spreadwise.plans.registry import refresh, stages_for
from spreadwise.sources import csv_files as C

SF = "/root/testdata/sf0.001"


def test_mapping_with_byte_order_mark_crlf_and_unquoted_commas(spark, tmp_path):
    (tmp_path / "map.csv").write_bytes("﻿11,Q1,First Co.,\r\n12,Q2,Second, Inc.\r\n13,,Third,\r\n".encode())
    rows = [tuple(r) for r in C.read_csv(spark, str(tmp_path / "map.csv"), "mapping").collect()]
    assert rows == [("11", "Q1", "First Co.", None), ("12", "Q2", "Second", " Inc."), ("13", None, "Third", None)]


def test_fundamentals_in_latin_1_with_semicolons(spark, tmp_path):
    names = ";".join(C.COLUMNS["fundamentals"])
    (tmp_path / "f.csv").write_bytes(f"{names}\n7;2010-03-31;1.5;;n/a{';' * 11}\xe9\n".encode("latin-1"))
    r = C.read_csv(spark, str(tmp_path / "f.csv"), "fundamentals").collect()[0]
    assert (r.gvkey, r.atq, r.ltq, r.niq, r.invtq) == ("7", "1.5", None, "n/a", "é")


def test_wide_matrix_takes_its_dates_from_the_header_and_keeps_file_order(spark, tmp_path):
    (tmp_path / "w.csv").write_text("iqt,01.02.10,01.01.10,notes\nA,5,0,x\nB,,7.5,\n")
    df = C.read_csv(spark, str(tmp_path / "w.csv"), "spreads")
    assert df.columns == ["iqt", "01.02.10", "01.01.10", "notes"]
    ordered = C.in_file_order(df).orderBy("ingest_id").collect()
    assert [r.iqt for r in ordered] == ["A", "B"]


def points(spark, n=300):
    df = spark.range(n).select(F.col("id").alias("gvkey"), F.lit("2010-01-01").alias("date"), (F.col("id") % 10).cast("double").alias("a"),
                               F.when(F.col("id") % 9 > 0, F.sin("id")).alias("b"), (F.col("id") % 10 > 6).cast("double").alias("label"))
    return df


def test_stored_models_score_alike_and_absent_ones_are_named(spark, tmp_path):
    raw, feats = points(spark), ["a", "b"]
    med = raw.agg(*[F.median(c).alias(f"{c}_med") for c in feats])
    filled = raw.crossJoin(med).withColumns({c: F.coalesce(c, f"{c}_med") for c in feats})
    mom = filled.agg(*[x for c in feats for x in (F.avg(c).alias(f"{c}_mu"), F.stddev_pop(c).alias(f"{c}_sd"))])
    scaled = VectorAssembler(inputCols=feats, outputCol="features").transform(
        filled.crossJoin(mom).withColumns({c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in feats}))
    model = LogisticRegression(maxIter=20).setThreshold(0.45).fit(scaled)
    save_bundle(str(tmp_path / "m"), med, mom, {"First Model": model}, {"First Model": 0.45})
    found, absent = load_models(spark, str(tmp_path / "m"), ["First Model", "Other, Model"])
    assert list(found) == ["First Model"] and absent == ["Other, Model"]
    again = found["First Model"].score(prepare(spark, str(tmp_path / "m"), raw, feats))
    want = {r.gvkey: (round(r.probability[1], 9), r.prediction) for r in model.transform(scaled).collect()}
    assert {r.gvkey: (round(r.p, 9), r.pred) for r in again.collect()} == want
    assert found["First Model"].threshold == 0.45 and found["First Model"].model.stages[0].getThreshold() == 0.45


def test_random_search_is_reproducible_and_ranks_by_exact_auc(spark):
    grid = {"maxDepth": [1, 2, 3], "stepSize": [0.1, 0.3], "minInstancesPerNode": [1, 5, 9]}
    assert draw_settings(grid, 15) == draw_settings(grid, 15)
    assert len({tuple(sorted(s.items())) for s in draw_settings(grid, 15)}) == 15
    assert len(draw_settings(grid, 99)) == 18
    df = stratified_folds(points(spark).na.fill(0.0), "label", draw_key("gvkey", "date"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    rows = random_search(data, GBTClassifier(maxIter=2, seed=1), grid, draws=2).collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0].mean_auc >= rows[1].mean_auc > 0.5
    assert {r.setting for r in rows} == {", ".join(f"{k}={v}" for k, v in sorted(s.items())) for s in draw_settings(grid, 2)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_on_stage_tables_do_not_shuffle(spark):
    st = stages_for(spark, SF)
    lagged = prep.add_lags(prep.forward_fill(st.merged))
    for df in (target.label_distress(lagged), features.market_features(features.accounting_features(st.preprocessed)),
               prep.add_lags(st.preprocessed.select(*st.merged.columns)), target.label_distress(st.ml_dataset.drop(*S.TARGET_NEW)),
               st.ml_dataset.select("gvkey", "date").join(st.preprocessed.select("gvkey", "date", "atq"), ["gvkey", "date"])):
        assert "Window" in plan(df) or "Join" in plan(df)
        assert plan(df).count("Exchange hashpartitioning(gvkey") == 0
    uncut = Stages(spark, SF, materialize=False)
    assert plan(target.label_distress(prep.add_lags(prep.forward_fill(uncut.merged)))).count("Exchange hashpartitioning(gvkey, ") <= 1


def test_filled_medians_read_what_the_merged_panel_reads(spark):
    uncut = Stages(spark, SF, materialize=False)
    scans = lambda df: plan(df).count("FileScan")
    assert 0 < scans(uncut.median_filled) == scans(uncut.merged)      # bounds and medians are values by then


def test_changed_input_is_read_again_without_refresh(spark, tmp_path):
    for t in ("lineitem", "supplier"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    firms = lambda: stages_for(spark, str(tmp_path)).merged.select("gvkey").distinct().count()
    first, st = firms(), stages_for(spark, str(tmp_path))
    assert stages_for(spark, str(tmp_path)) is st
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.filter("l_suppkey % 2 = 0").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < firms() < first and stages_for(spark, str(tmp_path)) is not st
    root = spark._jvm.org.apache.hadoop.fs.Path(st.folder)
    assert not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)      # its tables are gone
    refresh(spark, str(tmp_path))


def test_first_of_duplicates_by_file_block_and_row(spark, tmp_path):
    rows = [f"{g};2010-03-31;{v};{';' * 11}" for v in range(1, 400) for g in (7, 8, v + 100)]
    head = ";".join(C.COLUMNS["fundamentals"])
    for i in range(3):
        part = rows[i * 400:(i + 1) * 400]
        (tmp_path / f"part-{i}.csv").write_text("\n".join([head, *part]) + "\n", encoding="latin-1")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")                      # many blocks a file
    try:
        df = C.in_file_order(C.read_csv(spark, str(tmp_path), "fundamentals"))
        assert df.rdd.getNumPartitions() > 20
        got = {r.gvkey: r.atq for r in clean.dedupe_first(df, ["gvkey", "datadate"]).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 401 and all(got[str(g)] == str(v) for g, v in ((7, 1), (8, 1), (101, 1), (350, 250), (499, 399)))


def test_stage_tables_are_scanned_by_column(spark):
    st = stages_for(spark, SF)
    text = plan(st.ml_dataset.groupBy("year").agg(F.count("distress_flag")))
    scan = text[text.index("ReadSchema"):].split("\n")[0]
    assert "distress_flag" in scan and "atq" not in scan and "cds_spread" not in scan


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_panel_does_not_depend_on_partitions_or_order(spark, partitions):
    st = stages_for(spark, SF)
    shuffled = [x.orderBy(F.rand(partitions)).repartition(partitions) for x in (st.fundamentals_clean, st.prices_clean, st.spreads_long, st.raw_mapping)]
    cols = ["gvkey", "date", "atq", "price", "cds_spread"]
    rows = lambda df: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df.select(*cols).collect())
    assert rows(merge.merge_panel(*shuffled)) == rows(st.merged)
