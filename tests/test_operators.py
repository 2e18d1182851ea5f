"""Unit tests on small hand-made frames, one per trap / operator (expected values by hand)."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spreadwise.functions.exprs import clip, rnd, safe_div, to_double
from spreadwise.functions.stats import quantile_row, quantile_table
from spreadwise.operators import clean, features, merge, metrics, prep, target

D = dt.date


@pytest.mark.parametrize("n", [1, 2, 5, 4_999, 10_000, 60_000])     # below, at and above what the sketch holds
def test_quantiles_match_pandas(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"a": rng.lognormal(3, 2, n), "b": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
                        "c": np.where(rng.random(n) < 0.999, rng.normal(size=n), 1e300), "d": 3.0})
    pdf.loc[::13, "a"] = np.nan
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {(r.var, r.k): r.q for r in quantile_table(spark.createDataFrame(pdf).repartition(7), list("abcd"), probs).collect()}
    for c in "abcd":
        for k, p in enumerate(probs):
            want = pdf[c].quantile(p)
            assert got[(c, k)] == pytest.approx(want, rel=1e-12) if want == want else got[(c, k)] is None


def test_quantiles_read_their_input_twice(spark, tmp_path):
    spark.range(2_000).selectExpr("id % 97 * 1.0 as a", "id * 1.0 as b").write.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)
    df = spark.read.parquet(f"{tmp_path}/t").coalesce(1)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    row = quantile_row(df.mapInArrow(counted, df.schema), ["a", "b"], [0.1, 0.5, 0.9])
    assert seen.value == 2 * 2_000
    assert "Scan" not in row._jdf.queryExecution().executedPlan().toString() and row.count() == 1 and seen.value == 2 * 2_000


def test_quantile_of_empty_column_is_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    r = quantile_row(df, ["a", "b"], [0.5]).first()
    assert r["a_q0"] == 1.5 and r["b_q0"] is None


def test_coerce_and_nan_become_null(spark):                       # P5, T1
    df = spark.createDataFrame([("1.5",), ("n/a",), ("nan",), (None,)], "x string")
    assert [r.y for r in df.select(to_double("x").alias("y")).collect()] == [1.5, None, None, None]


def test_clip_keeps_missing(spark):                               # T3
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    out = [r.y for r in df.select(clip("x", F.lit(-1.0), F.lit(1.0)).alias("y")).collect()]
    assert out == [None, 1.0, -1.0]


def test_safe_div_zero_is_null(spark):                            # P14, T19
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (2.0, 4.0)], "a double, b double")
    assert [r.y for r in df.select(safe_div("a", "b").alias("y")).collect()] == [None, None, 0.5]


def test_rnd_has_no_negative_zero_and_no_tie_flip(spark):
    df = spark.createDataFrame([(-0.0000001,), (3944.92475,), (2.5,)], "x double")
    out = [r.y for r in df.select(rnd("x", 4).alias("y")).collect()]
    assert str(out[0]) == "0.0" and out[1] in (3944.9247, 3944.9248) and out[2] == 2.5


def test_dedupe_keeps_first_in_file_order(spark):                 # A12, T18
    df = spark.createDataFrame([(1, D(2020, 3, 31), 10.0, 2), (1, D(2020, 3, 31), 20.0, 1), (2, D(2020, 3, 31), 5.0, 3)],
                               "gvkey long, datadate date, atq double, ingest_id long")
    out = {r.gvkey: r.atq for r in clean.dedupe_first(df, ["gvkey", "datadate"]).collect()}
    assert out == {1: 20.0, 2: 5.0}


def test_clean_fundamentals_negatives_and_equity(spark):          # P6, P7
    df = spark.createDataFrame([("7", "2020-03-31", "-1", "5", "2", 1)],
                               "gvkey string, datadate string, atq string, ltq string, cheq string, ingest_id long")
    r = clean.clean_fundamentals(df).first()
    assert r.atq is None and r.seqq is None and r.cheq == 2.0


def test_wide_to_long_parses_and_caps(spark):                      # U1, F6, P9, P10
    wide = spark.createDataFrame([("A", "0", "12000", "50"), ("B", None, "7", "x")],
                                 "iqt string, `01.02.12` string, `01.01.12` string, notes string")
    rows = sorted(clean.spreads_long(wide).collect(), key=lambda r: (r.iqt, str(r.date)))
    assert [(r.iqt, r.date, r.cds_spread) for r in rows] == [
        ("A", D(2012, 1, 1), 10000.0), ("A", None, 50.0), ("B", D(2012, 1, 1), 7.0)]


def test_quarter_last_is_last_non_null_per_column(spark):          # A13
    df = spark.createDataFrame([(1, D(2020, 1, 1), 1.0, 5.0, 9.0), (1, D(2020, 2, 1), 2.0, None, 8.0),
                                (1, D(2020, 3, 1), None, None, 7.0)],
                               "gvkey long, datadate date, prccm double, trt1m double, cshom double")
    r = merge.quarter_last(df).first()
    assert (r.prccm, r.trt1m, r.cshom) == (2.0, 5.0, 7.0)


def test_forward_fill_and_fill_medians(spark):                     # W1, W2, W3
    df = spark.createDataFrame([(1, D(2020, 3, 31), 1.0), (1, D(2020, 6, 30), None), (2, D(2020, 3, 31), None),
                                (3, D(2020, 3, 31), 10.0)], "gvkey long, date date, niq double")
    ff = {(r.gvkey, r.date): r.niq for r in prep.forward_fill(df, ["niq"]).collect()}
    assert ff[(1, D(2020, 6, 30))] == 1.0 and ff[(2, D(2020, 3, 31))] is None
    fm = {(r.gvkey, r.date): r.niq for r in prep.fill_medians(df, ["niq"]).collect()}
    # firm 1 -> its own median 1.0; firm 2 -> overall median of firm-filled column [1, 1, 10] = 1
    assert fm[(1, D(2020, 6, 30))] == 1.0 and fm[(2, D(2020, 3, 31))] == 1.0


def _firm(spark, spreads):
    rows = [(1, D(2010 + i // 4, 3 * (i % 4) + 1, 1), s) for i, s in enumerate(spreads)]
    return spark.createDataFrame(rows, "gvkey long, date date, cds_spread double")


def test_label_lead_and_t4(spark):                                   # W12, P19, P20, T4
    out = target.label_distress(_firm(spark, [100.0, None, 100.0, 100.0, 160.0, 100.0, 130.0, 90.0, 1.0]))
    flags = [r.distress_flag for r in out.orderBy("date").collect()]
    # row0: 100 -> 160 (+60) = 1; row1: current missing, lead exists -> 0 (T4);
    # row2: 100 -> 130 (+30%) = 1; row3: 100 -> 90 = 0; row4: 160 -> 1 = 0; last 4 rows: no lead
    assert flags == [1, 0, 1, 0, 0, None, None, None, None]
    strict = [r.distress_flag for r in target.label_distress(_firm(spark, [100.0, None, 100.0, 100.0, 160.0, 101.0]),
                                                               strict=True).orderBy("date").collect()]
    assert strict[1] is None


def test_lead_lag_roundtrip_property(spark):
    df = _firm(spark, [float(i) for i in range(10)])
    out = prep.add_lags(df.withColumns({"return_1m": F.lit(1.0), "atq": F.lit(1.0), "saleq": F.lit(1.0)}))
    rows = out.orderBy("date").collect()
    assert [r.cds_spread_lag1 for r in rows][1:] == [r.cds_spread for r in rows][:-1]


def test_rolling_windows_min_periods(spark):                         # W8, W9, W10, W11, T8
    rows = [(1, D(2010, m, 1), r) for m, r in zip(range(1, 8), [1.0, -3.0, 2.0, 0.5, 1.0, 1.0, -0.5])]
    df = spark.createDataFrame(rows, "gvkey long, date date, return_1m double")
    out = features.drawdown_features(features.volatility_features(features.momentum_features(df))).orderBy("date").toPandas()
    s = pd.Series([r[2] for r in rows])
    assert np.allclose(out.momentum_3m, s.rolling(3, min_periods=1).sum())
    assert np.allclose(out.volatility_3m.astype(float), s.rolling(3, min_periods=2).std(), equal_nan=True)
    cum = (1 + s).cumprod()
    assert np.allclose(out.max_drawdown_3m, cum / cum.rolling(3, min_periods=1).max() - 1)


def test_auc_ap_sweep_against_brute_force(spark):                   # A36, A37, A40
    rng = np.random.default_rng(0)
    n = 3000
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 3)   # many ties
    df = spark.createDataFrame(pd.DataFrame({"label": y, "p": p}))
    auc = metrics.auc(df).first().auc
    pos, neg = p[y == 1], p[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute, rel=1e-12)
    flipped = metrics.auc(df.withColumn("p", -F.col("p"))).first().auc
    assert flipped == pytest.approx(1 - auc, rel=1e-12)            # AUC(-s) = 1 - AUC(s)
    ap = metrics.average_precision(df).first().average_precision
    order = np.argsort(-p, kind="stable")
    ths = np.unique(p)[::-1]
    brute_ap = sum(((p >= t) & (y == 1)).sum() / ((p >= t).sum()) * ((p == t) & (y == 1)).sum() / y.sum() for t in ths)
    assert ap == pytest.approx(brute_ap, rel=1e-9)
    sw = {r.i: r for r in metrics.threshold_sweep(df).collect()}
    for i, t in enumerate([0.1 + k * 0.05 for k in range(16)]):
        tp = ((p >= t) & (y == 1)).sum()
        assert sw[i].tp == tp and sw[i].fp == ((p >= t) & (y == 0)).sum()
    del order


def test_confusion_cells_sum_to_n(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0), (1, 1)], "label int, pred int")
    r = metrics.with_rates(metrics.confusion(df)).first()
    assert r.tn + r.fp + r.fn + r.tp == 5 and r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3)


def test_results_do_not_depend_on_partitioning(spark):
    df = _firm(spark, [100.0, 120.0, 90.0, 160.0, 200.0, 150.0, 140.0, 220.0])
    a = sorted(target.label_distress(df.repartition(1)).collect())
    b = sorted(target.label_distress(df.repartition(7)).collect())
    assert a == b
