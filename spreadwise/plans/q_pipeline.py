"""Queries over the pipeline stages: sources, cleaning, merge, preprocessing, features, label, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import count_if
from ..operators import clean, merge, prep, target
from ..operators import features as feat
from .pipeline import Stages, year_quarter_bigint
from .registry import query

# decimals kept per column in outputs (money 2, prices / spreads 4, everything else 6)
MONEY = {"atq", "ltq", "niq", "saleq", "cheq", "dlttq", "dlcq", "actq", "lctq", "seqq", "cshoq",
         "oibdpq", "rectq", "invtq", "total_debt", "market_cap", "shares_out", "cshom"}
PRICE = {"prccq", "price", "prccm", "cds_spread", "cds_spread_lead_4q", "future_cds_change_abs",
         "cds_change", "cds_spread_lag1", "cds_spread_lag2", "cds_spread_lag4"}


SIGNIFICANT = {"max_drawdown_3m", "max_drawdown_6m", "max_drawdown_12m"}


def dp(c: str):
    if c in SIGNIFICANT:
        return "g10"
    return 2 if c in MONEY else 4 if c in PRICE else 6


def spec_of(cols, keys=("gvkey", "year", "quarter", "ingest_id", "n", "k"),
            strings=("company_name", "iqt", "split", "tic", "cusip", "sic", "cusip6", "extra",
                     "date_str", "variable", "feature"),
            dates=("date", "datadate")):
    out = []
    for c in cols:
        if c in keys:
            out.append((c, "k"))
        elif c in strings:
            out.append((c, "s"))
        elif c in dates:
            out.append((c, "d"))
        else:
            out.append((c, dp(c)))
    return out


def sel(cols):
    return ", ".join(cols)


# ---------------------------------------------------------------- sources (S1-S5) ---------
FUND_RAW_COLS = ["gvkey", "datadate"] + S.FUND_NUMERIC + ["ingest_id"]


@query("src_fundamentals", spec_of(FUND_RAW_COLS), f"SELECT {sel(FUND_RAW_COLS)} FROM fund_raw")
def src_fundamentals(st: Stages) -> DataFrame:
    return clean.coerce_fundamentals(st.raw_fundamentals)


PRICE_RAW_COLS = ["gvkey", "datadate", "prccm", "trt1m", "cshom", "ingest_id"]


@query("src_prices", spec_of(PRICE_RAW_COLS), f"SELECT {sel(PRICE_RAW_COLS)} FROM price_raw")
def src_prices(st: Stages) -> DataFrame:
    return clean.coerce_prices(st.raw_prices)


MAP_COLS = ["gvkey", "iqt", "company_name", "extra", "ingest_id"]


@query("src_mapping", [("gvkey", "s"), ("iqt", "s"), ("company_name", "s"), ("extra", "s"),
                       ("ingest_id", "k")], f"SELECT {sel(MAP_COLS)} FROM map_raw")
def src_mapping(st: Stages) -> DataFrame:
    return st.raw_mapping


@query("link_cusip", [("gvkey", "s"), ("tic", "s"), ("cusip", "s"), ("sic", "s"), ("cusip6", "s")],
       "SELECT gvkey, tic, cusip, sic, cusip6 FROM link")
def link_cusip(st: Stages) -> DataFrame:
    return clean.link_cusip(st.raw_firm_master)


@query("cds_long", spec_of(["iqt", "date", "cds_spread"]), "SELECT iqt, date, cds_spread FROM spreads_long")
def cds_long(st: Stages) -> DataFrame:
    return st.spreads_long


@query("clean_numeric", spec_of(["gvkey", "datadate", "atq", "niq", "prccq"]),
       """SELECT gvkey, datadate, CASE WHEN gvkey % 4 = 0 THEN NULL ELSE atq END AS atq,
          CASE WHEN gvkey % 4 = 1 THEN NULL ELSE niq END AS niq, prccq FROM fund_raw""")
def clean_numeric(st: Stages) -> DataFrame:
    """P5 on text input: the fixture values as text, with bad tokens injected by key."""
    raw = st.raw_fundamentals
    txt = raw.select(
        F.col("gvkey").cast("string").alias("gvkey"), F.col("datadate").cast("string").alias("datadate"),
        F.when(F.col("gvkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("atq").cast("string")).alias("atq"),
        F.when(F.col("gvkey") % 4 == 1, F.lit("nan")).otherwise(F.col("niq").cast("string")).alias("niq"),
        F.col("prccq").cast("string").alias("prccq"))
    out = clean.coerce_fundamentals(txt)
    from ..functions.exprs import to_long
    return out.withColumn("gvkey", to_long("gvkey"))


# ---------------------------------------------------------------- cleaning ----------------
FUND_CLEAN_COLS = ["gvkey", "datadate"] + S.FUND_NUMERIC + ["seqq", "ingest_id"]


@query("clean_fundamentals", spec_of(FUND_CLEAN_COLS), f"SELECT {sel(FUND_CLEAN_COLS)} FROM fund_clean")
def clean_fundamentals(st: Stages) -> DataFrame:
    return st.fundamentals_clean


@query("dedupe_first", spec_of(["gvkey", "datadate", "ingest_id", "atq"]),
       "SELECT gvkey, datadate, ingest_id, atq FROM fund_clean")
def dedupe_first(st: Stages) -> DataFrame:
    return clean.dedupe_first(clean.coerce_fundamentals(st.raw_fundamentals), ["gvkey", "datadate"]) \
        .withColumn("atq", F.col("atq"))


@query("clean_prices", spec_of(PRICE_RAW_COLS), f"SELECT {sel(PRICE_RAW_COLS)} FROM price_clean")
def clean_prices(st: Stages) -> DataFrame:
    return st.prices_clean


LINEAGE = [("dataset", "s"), ("initial", "k"), ("removed_rule", "k"), ("removed_duplicate", "k"), ("final", "k")]


@query("clean_lineage", LINEAGE, """
    SELECT 'fundamentals' AS dataset, (SELECT count(*) FROM fund_raw) AS initial, 0 AS removed_rule,
           (SELECT count(*) FROM fund_raw) - (SELECT count(*) FROM fund_clean) AS removed_duplicate,
           (SELECT count(*) FROM fund_clean) AS final
    UNION ALL
    SELECT 'prices', (SELECT count(*) FROM price_raw),
           (SELECT count(*) FROM price_raw) - (SELECT count(*) FROM price_valid),
           (SELECT count(*) FROM price_valid) - (SELECT count(*) FROM price_clean),
           (SELECT count(*) FROM price_clean)
    UNION ALL
    SELECT 'spreads', (SELECT count(*) FROM wide_cells),
           (SELECT count(*) FROM wide_cells) - (SELECT count(*) FROM spreads_long), 0,
           (SELECT count(*) FROM spreads_long)""")
def clean_lineage(st: Stages) -> DataFrame:
    parts = [("fundamentals", clean.lineage_fundamentals(st.raw_fundamentals)),
             ("prices", clean.lineage_prices(st.raw_prices)),
             ("spreads", clean.lineage_spreads(st.raw_spreads_wide))]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("dataset"), "*")
        out = df if out is None else out.unionByName(df)
    return out


@query("clean_validation", [("dataset", "s"), ("rows", "k"), ("non_null", "k"), ("niq_non_null", 0), ("spread_min", 4),
                            ("spread_max", 4), ("spread_median", 4)], """
    SELECT 'fundamentals' AS dataset, count(*) AS rows, count(atq) AS non_null, count(niq) AS niq_non_null,
           NULL AS spread_min, NULL AS spread_max, NULL AS spread_median FROM fund_clean
    UNION ALL SELECT 'prices', count(*), count(prccm), NULL, NULL, NULL, NULL FROM price_clean
    UNION ALL SELECT 'spreads', count(*), count(cds_spread), NULL, min(cds_spread), max(cds_spread),
           median(cds_spread) FROM spreads_long""")
def clean_validation(st: Stages) -> DataFrame:
    from ..functions.stats import quantile_row
    nul = F.lit(None).cast("double")
    f = st.fundamentals_clean.agg(F.lit("fundamentals").alias("dataset"), F.count(F.lit(1)).alias("rows"),
                                  F.count("atq").alias("non_null"), F.count("niq").alias("niq_non_null"), nul.alias("spread_min"),
                                  nul.alias("spread_max"), nul.alias("spread_median"))
    p = st.prices_clean.agg(F.lit("prices").alias("dataset"), F.count(F.lit(1)).alias("rows"),
                            F.count("prccm").alias("non_null"), nul.cast("long").alias("niq_non_null"), nul.alias("spread_min"),
                            nul.alias("spread_max"), nul.alias("spread_median"))
    s = st.spreads_long
    med = quantile_row(s, ["cds_spread"], [0.5], names=["med"])
    sa = s.agg(F.lit("spreads").alias("dataset"), F.count(F.lit(1)).alias("rows"),
               F.count("cds_spread").alias("non_null"), nul.cast("long").alias("niq_non_null"), F.min("cds_spread").alias("spread_min"),
               F.max("cds_spread").alias("spread_max")).crossJoin(med) \
        .withColumnRenamed("cds_spread_med", "spread_median")
    return f.unionByName(p).unionByName(sa)


# ---------------------------------------------------------------- merge -------------------
@query("agg_quarter_last", spec_of(["gvkey", "year", "quarter", "price", "return_1m", "shares_out"]),
       "SELECT gvkey, year, quarter, price, return_1m, shares_out FROM q_price")
def agg_quarter_last(st: Stages) -> DataFrame:
    q = merge.quarter_last(st.prices_clean).withColumnsRenamed(S.PRICE_RENAME)
    return year_quarter_bigint(q)


@query("agg_quarter_mean", spec_of(["gvkey", "year", "quarter", "cds_spread"]),
       "SELECT gvkey, year, quarter, cds_spread FROM q_spread")
def agg_quarter_mean(st: Stages) -> DataFrame:
    return year_quarter_bigint(merge.quarter_mean_spread(st.spreads_long, st.raw_mapping))


@query("merge_spreads", spec_of(["iqt", "date", "cds_spread", "gvkey"]),
       "SELECT iqt, date, cds_spread, gvkey FROM spreads_mapped")
def merge_spreads(st: Stages) -> DataFrame:
    return merge.mapped_spreads(st.spreads_long, st.raw_mapping)


@query("merge_match_rate", [("rows", "k"), ("mapped", "k"), ("match_pct", 6)], """
    SELECT count(*) AS rows, count(m.gvkey) AS mapped, 100.0 * count(m.gvkey) / count(*) AS match_pct
    FROM spreads_long s LEFT JOIN map_iqt m ON m.iqt = s.iqt""")
def merge_match_rate(st: Stages) -> DataFrame:
    s = merge.mapped_spreads(st.spreads_long, st.raw_mapping, how="left")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count("gvkey").alias("mapped"),
                 (F.lit(100.0) * F.count("gvkey") / F.count(F.lit(1))).alias("match_pct"))


@query("merge_panel", spec_of(S.MERGED_COLS), f"SELECT {sel(S.MERGED_COLS)} FROM merged")
def merge_panel(st: Stages) -> DataFrame:
    return st.merged


@query("merge_coverage", [("rows", "k"), ("firms", "k"), ("rows_with_spread", "k"),
                          ("firms_with_spread", "k"), ("spread_coverage_pct", 6),
                          ("fundamentals_rows", "k"), ("join_coverage_pct", 6)], """
    SELECT count(*) AS rows, count(DISTINCT gvkey) AS firms, count(cds_spread) AS rows_with_spread,
           count(DISTINCT CASE WHEN cds_spread IS NOT NULL THEN gvkey END) AS firms_with_spread,
           100.0 * count(cds_spread) / count(*) AS spread_coverage_pct,
           (SELECT count(*) FROM fund_clean) AS fundamentals_rows,
           100.0 * count(*) / (SELECT count(*) FROM fund_clean) AS join_coverage_pct
    FROM merged""")
def merge_coverage(st: Stages) -> DataFrame:
    m = st.merged
    n_f = st.fundamentals_clean.agg(F.count(F.lit(1)).alias("fundamentals_rows"))
    a = m.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("gvkey").alias("firms"),
              F.count("cds_spread").alias("rows_with_spread"),
              F.countDistinct(F.when(F.col("cds_spread").isNotNull(), F.col("gvkey"))).alias("firms_with_spread"),
              (F.lit(100.0) * F.count("cds_spread") / F.count(F.lit(1))).alias("spread_coverage_pct"))
    return a.crossJoin(n_f).withColumn("join_coverage_pct",
                                       F.lit(100.0) * F.col("rows") / F.col("fundamentals_rows"))


# ---------------------------------------------------------------- step 5 ------------------
@query("pre_ffill", spec_of(S.MERGED_COLS), f"SELECT {sel(S.MERGED_COLS)} FROM ffilled")
def pre_ffill(st: Stages) -> DataFrame:
    return st.ffilled


@query("pre_winsorize", spec_of(S.MERGED_COLS), f"SELECT {sel(S.MERGED_COLS)} FROM winsorized")
def pre_winsorize(st: Stages) -> DataFrame:
    return st.winsorized


_WR = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c}_p1 AS p1, {c}_p99 AS p99, "
    f"(SELECT count(*) FROM ffilled WHERE {c} < {c}_p1) AS n_low, "
    f"(SELECT count(*) FROM ffilled WHERE {c} > {c}_p99) AS n_high FROM winsor_b" for c in S.WINSOR_COLS)


@query("pre_winsorize_report", [("variable", "s"), ("p1", 4), ("p99", 4), ("n_low", "k"), ("n_high", "k")], _WR)
def pre_winsorize_report(st: Stages) -> DataFrame:
    return prep.winsor_report(st.ffilled)


@query("pre_required", spec_of(S.MERGED_COLS), f"SELECT {sel(S.MERGED_COLS)} FROM required")
def pre_required(st: Stages) -> DataFrame:
    return st.required


@query("pre_required_report", [("step", "k"), ("variable", "s"), ("dropped", "k"), ("initial_rows", "k")], """
    SELECT 1 AS step, 'atq' AS variable, count_if(atq IS NULL) AS dropped, count(*) AS initial_rows FROM winsorized
    UNION ALL SELECT 2, 'ltq', count_if(atq IS NOT NULL AND ltq IS NULL), count(*) FROM winsorized
    UNION ALL SELECT 3, 'price', count_if(atq IS NOT NULL AND ltq IS NOT NULL AND price IS NULL), count(*)
    FROM winsorized""")
def pre_required_report(st: Stages) -> DataFrame:
    return prep.required_report(st.winsorized)


@query("pre_fill_median", spec_of(S.MERGED_COLS), f"SELECT {sel(S.MERGED_COLS)} FROM median_filled")
def pre_fill_median(st: Stages) -> DataFrame:
    return st.median_filled


_FR = " UNION ALL ".join(
    [f"SELECT 'ffill' AS stage, '{c}' AS variable, (SELECT count(*) FROM merged WHERE {c} IS NULL) AS missing_before, "
     f"(SELECT count(*) FROM ffilled WHERE {c} IS NULL) AS missing_after" for c in S.FFILL_COLS]
    + [f"SELECT 'median', '{c}', (SELECT count(*) FROM required WHERE {c} IS NULL), "
       f"(SELECT count(*) FROM median_filled WHERE {c} IS NULL)" for c in S.MEDIAN_FILL_COLS])


@query("pre_fill_report", [("stage", "s"), ("variable", "s"), ("missing_before", "k"),
                           ("missing_after", "k"), ("filled", "k")],
       f"SELECT stage, variable, missing_before, missing_after, missing_before - missing_after AS filled FROM ({_FR})")
def pre_fill_report(st: Stages) -> DataFrame:
    a = prep.fill_report(st.merged, S.FFILL_COLS, prep.forward_fill).select(F.lit("ffill").alias("stage"), "*")
    b = prep.fill_report(st.required, S.MEDIAN_FILL_COLS, prep.fill_medians).select(F.lit("median").alias("stage"), "*")
    return a.unionByName(b)


LAG_COLS = ["gvkey", "date"] + [f"cds_spread_lag{k}" for k in S.LAGS] + [f"return_lag{k}" for k in S.LAGS]


@query("pre_lags", spec_of(LAG_COLS), f"SELECT {sel(LAG_COLS)} FROM preprocessed")
def pre_lags(st: Stages) -> DataFrame:
    return st.preprocessed.select(*LAG_COLS)


CHG_COLS = ["gvkey", "date", "atq_change", "saleq_change", "cds_change"]


@query("pre_changes", spec_of(CHG_COLS), f"SELECT {sel(CHG_COLS)} FROM preprocessed")
def pre_changes(st: Stages) -> DataFrame:
    return st.preprocessed.select(*CHG_COLS)


# ---------------------------------------------------------------- steps 6-7 ---------------
def _feat_query(name: str, cols: list[str]):
    full = ["gvkey", "date"] + cols

    @query(name, spec_of(full), f"SELECT {sel(full)} FROM features_complete")
    def _q(st: Stages) -> DataFrame:
        return st.features_complete.select(*full)
    return _q


_feat_query("feat_leverage", ["total_debt", "debt_to_equity", "debt_to_assets", "leverage", "lt_debt_ratio"])
_feat_query("feat_liquidity", ["current_ratio", "quick_ratio", "cash_ratio", "working_capital_ratio"])
_feat_query("feat_profitability", ["roa", "roe", "profit_margin", "asset_turnover"])
_feat_query("feat_size", ["market_cap", "log_market_cap"])
_feat_query("feat_momentum", [f"momentum_{w}m" for w in S.WINDOWS])
_feat_query("feat_volatility", [f"volatility_{w}m" for w in S.WINDOWS])
_feat_query("feat_drawdown", [f"max_drawdown_{w}m" for w in S.WINDOWS])


@query("feat_extremes", [("variable", "s"), ("below_minus_10", "k"), ("above_10", "k")],
       " UNION ALL ".join(f"SELECT '{c}' AS variable, count_if({c} < -10) AS below_minus_10, "
                          f"count_if({c} > 10) AS above_10 FROM features_accounting" for c in S.RATIO_COLS))
def feat_extremes(st: Stages) -> DataFrame:
    fa = st.features_accounting
    row = fa.agg(*[x for c in S.RATIO_COLS for x in (count_if(F.col(c) < -10).alias(f"{c}__lo"),
                                                     count_if(F.col(c) > 10).alias(f"{c}__hi"))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__lo").alias("below_minus_10"),
                 F.col(f"{c}__hi").alias("above_10")) for c in S.RATIO_COLS])).alias("r")).select("r.*")


SUMMARY_FEATS = S.ACCOUNTING_NEW + S.MARKET_NEW


@query("feat_summary", [("variable", "s"), ("mean", "g10"), ("median", "g10")],
       " UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS mean, median({c}) AS median "
                          f"FROM features_complete" for c in SUMMARY_FEATS))
def feat_summary(st: Stages) -> DataFrame:
    from ..functions.stats import quantile_table
    fc = st.features_complete
    means = fc.agg(*[F.avg(c).alias(c) for c in SUMMARY_FEATS])
    m = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("mean"))
                                         for c in SUMMARY_FEATS])).alias("r")).select("r.*")
    med = quantile_table(fc, SUMMARY_FEATS, [0.5]).select(F.col("var").alias("variable"), F.col("q").alias("median"))
    return m.join(med, "variable")


# ---------------------------------------------------------------- steps 9-10 --------------
@query("target_by_year", [("year", "k"), ("distress_events", "k"), ("total_obs", "k"), ("distress_rate", 6)], """
    SELECT year(date) AS year, sum(distress_flag) AS distress_events, count(*) AS total_obs,
           avg(distress_flag) * 100 AS distress_rate
    FROM m_target WHERE distress_flag IS NOT NULL GROUP BY 1""")
def target_by_year(st: Stages) -> DataFrame:
    """Flagship: merged panel -> 4-quarter lead -> label (T4) -> per-year events / rate."""
    return target.by_year(target.label_distress(st.merged))


TARGET_SPEC = spec_of(S.TARGET_COLS)


@query("target_flag", TARGET_SPEC, f"SELECT {sel(S.TARGET_COLS)} FROM ml_dataset")
def target_flag(st: Stages) -> DataFrame:
    return year_quarter_bigint(st.target_table)


@query("target_summary", [("total_rows", "k"), ("labelled", "k"), ("events", "k"), ("non_events", "k"),
                          ("unlabelled", "k"), ("rate", 6), ("firms", "k"), ("balance", "s")], """
    SELECT count(*) AS total_rows, count(distress_flag) AS labelled, count_if(distress_flag = 1) AS events,
           count_if(distress_flag = 0) AS non_events, count_if(distress_flag IS NULL) AS unlabelled,
           avg(distress_flag) AS rate,
           count(DISTINCT CASE WHEN distress_flag IS NOT NULL THEN gvkey END) AS firms,
           CASE WHEN avg(distress_flag) < 0.1 THEN 'Severe imbalance'
                WHEN avg(distress_flag) < 0.3 THEN 'Moderate imbalance' ELSE 'Good balance' END AS balance
    FROM ml_dataset""")
def target_summary(st: Stages) -> DataFrame:
    return target.summary(st.ml_dataset)


@query("target_breakdown", [("abs_only", "k"), ("pct_only", "k"), ("abs_and_pct", "k")], f"""
    SELECT count_if(future_cds_change_abs >= {S.ABS_THRESHOLD} AND future_cds_change_pct < {S.PCT_THRESHOLD}) AS abs_only,
           count_if(future_cds_change_abs < {S.ABS_THRESHOLD} AND future_cds_change_pct >= {S.PCT_THRESHOLD}) AS pct_only,
           count_if(future_cds_change_abs >= {S.ABS_THRESHOLD} AND future_cds_change_pct >= {S.PCT_THRESHOLD}) AS abs_and_pct
    FROM ml_dataset""")
def target_breakdown(st: Stages) -> DataFrame:
    return target.breakdown(st.ml_dataset)


@query("target_change_stats", [("abs_mean", 4), ("abs_median", 4), ("abs_max", 4), ("abs_min", 4),
                               ("pct_mean", 6), ("pct_median", 6), ("pct_max", 6), ("lost", "k")], """
    SELECT avg(future_cds_change_abs) FILTER (WHERE distress_flag IS NOT NULL) AS abs_mean,
           median(future_cds_change_abs) FILTER (WHERE distress_flag IS NOT NULL) AS abs_median,
           max(future_cds_change_abs) FILTER (WHERE distress_flag IS NOT NULL) AS abs_max,
           min(future_cds_change_abs) FILTER (WHERE distress_flag IS NOT NULL) AS abs_min,
           avg(future_cds_change_pct) FILTER (WHERE distress_flag IS NOT NULL) AS pct_mean,
           median(future_cds_change_pct) FILTER (WHERE distress_flag IS NOT NULL) AS pct_median,
           max(future_cds_change_pct) FILTER (WHERE distress_flag IS NOT NULL) AS pct_max,
           count(cds_spread) - count(cds_spread_lead_4q) AS lost
    FROM ml_dataset""")
def target_change_stats(st: Stages) -> DataFrame:
    from ..functions.stats import quantile_row
    ds = st.ml_dataset
    lab = target.labelled(ds)
    a, p = F.col("future_cds_change_abs"), F.col("future_cds_change_pct")
    base = lab.agg(F.avg(a).alias("abs_mean"), F.max(a).alias("abs_max"), F.min(a).alias("abs_min"),
                   F.avg(p).alias("pct_mean"), F.max(p).alias("pct_max"))
    med = quantile_row(lab, ["future_cds_change_abs", "future_cds_change_pct"], [0.5], names=["med"]) \
        .select(F.col("future_cds_change_abs_med").alias("abs_median"),
                F.col("future_cds_change_pct_med").alias("pct_median"))
    return base.crossJoin(med).crossJoin(target.lost_at_end(ds))


SPLIT_COLS = S.ML_DATASET_COLS + ["split"]


@query("split_temporal", spec_of(SPLIT_COLS), f"SELECT {sel(SPLIT_COLS)} FROM split_tbl")
def split_temporal(st: Stages) -> DataFrame:
    return year_quarter_bigint(st.split)


@query("split_summary", [("split", "s"), ("rows", "k"), ("pct", 6), ("events", "k"), ("rate", 6),
                         ("firms", "k"), ("date_min", "s"), ("date_max", "s")], """
    SELECT split, count(*) AS rows, 100.0 * count(*) / sum(count(*)) OVER () AS pct,
           sum(distress_flag) AS events, avg(distress_flag) AS rate, count(DISTINCT gvkey) AS firms,
           strftime(min(date), '%Y-%m') AS date_min, strftime(max(date), '%Y-%m') AS date_max
    FROM split_tbl GROUP BY split""")
def split_summary(st: Stages) -> DataFrame:
    s = st.split
    g = s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum(S.LABEL).alias("events"),
                               F.avg(S.LABEL).alias("rate"), F.countDistinct("gvkey").alias("firms"),
                               F.date_format(F.min("date"), "yyyy-MM").alias("date_min"),
                               F.date_format(F.max("date"), "yyyy-MM").alias("date_max"))
    tot = s.agg(F.count(F.lit(1)).alias("_tot"))
    return g.crossJoin(tot).withColumn("pct", F.lit(100.0) * F.col("rows") / F.col("_tot"))


@query("split_overlap", [("train_firms", "k"), ("test_firms", "k"), ("overlap", "k"), ("overlap_pct_of_test", 6)], """
    SELECT count_if(tr) AS train_firms, count_if(te) AS test_firms, count_if(tr AND te) AS overlap,
           100.0 * count_if(tr AND te) / count_if(te) AS overlap_pct_of_test
    FROM (SELECT gvkey, bool_or(split = 'train') AS tr, bool_or(split = 'test') AS te FROM split_tbl GROUP BY gvkey)""")
def split_overlap(st: Stages) -> DataFrame:
    f = st.split.groupBy("gvkey").agg(F.bool_or(F.col("split") == "train").alias("tr"),
                                      F.bool_or(F.col("split") == "test").alias("te"))
    return f.agg(count_if(F.col("tr")).alias("train_firms"), count_if(F.col("te")).alias("test_firms"),
                 count_if(F.col("tr") & F.col("te")).alias("overlap"),
                 (F.lit(100.0) * count_if(F.col("tr") & F.col("te")) / count_if(F.col("te"))).alias("overlap_pct_of_test"))


def _ml_feats():
    from .pipeline import ml_feature_columns  # noqa: F401
    return (S.ACCOUNTING_FEATURES + S.MARKET_FEATURES + S.LAGGED_FEATURES)


@query("split_missing", [("feature", "s"), ("train_missing", "k"), ("test_missing", "k")],
       "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, count_if(split = 'train' AND {c} IS NULL) AS train_missing, "
           f"count_if(split = 'test' AND {c} IS NULL) AS test_missing FROM split_tbl" for c in _ml_feats())
       + ") WHERE train_missing > 0 OR test_missing > 0")
def split_missing(st: Stages) -> DataFrame:
    feats = st.feature_cols
    row = st.split.agg(*[x for c in feats for x in (
        count_if((F.col("split") == "train") & F.col(c).isNull()).alias(f"{c}__tr"),
        count_if((F.col("split") == "test") & F.col(c).isNull()).alias(f"{c}__te"))])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__tr").alias("train_missing"),
                 F.col(f"{c}__te").alias("test_missing")) for c in feats])).alias("r")).select("r.*")
    return long.filter((F.col("train_missing") > 0) | (F.col("test_missing") > 0))


@query("feat_selected", spec_of(S.SELECTED_COLS), f"SELECT {sel(S.SELECTED_COLS)} FROM ml_ready")
def feat_selected(st: Stages) -> DataFrame:
    return year_quarter_bigint(st.ml_ready)


@query("feat_missing", [("feature", "s"), ("missing", "k"), ("missing_pct", 6)],
       "SELECT * FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, count_if({c} IS NULL) AS missing, 100.0 * count_if({c} IS NULL) / count(*) "
           f"AS missing_pct FROM ml_ready" for c in S.SELECTED_COLS) + ") WHERE missing > 0")
def feat_missing(st: Stages) -> DataFrame:
    mr = st.ml_ready
    cols = mr.columns
    row = mr.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(f"{c}__m") for c in cols])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("missing"),
                 (F.lit(100.0) * F.col(f"{c}__m") / F.col("_n")).alias("missing_pct")) for c in cols])).alias("r")) \
        .select("r.*")
    return long.filter(F.col("missing") > 0)
