"""Profile, quality and coverage reports (steps 1, 2 and the printed checks of steps 3-10)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import count_if
from ..functions.stats import quantile_row
from ..operators import clean
from ..operators import profile as P
from ..session import scratch_dir
from ..sources import csv_files as C
from .pipeline import Stages
from .q_pipeline import FUND_CLEAN_COLS, spec_of
from .registry import REGISTRY as _R
from .registry import query, sql_rnd

COMP_VARS = ["atq", "ltq", "niq", "saleq", "cheq", "dlttq"]
CRSP_VARS = ["prccm", "trt1m"]


def _txt(expr: str, d: int) -> str:
    return f"printf('%.{d}f', {sql_rnd(expr, d)})"


def _summary_sql(table: str, dataset: str, cols, d: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{dataset}' AS Dataset, '{c.upper()}' AS Variable, count({c}) AS Count, "
        f"{_txt(f'100.0 * (count(*) - count({c})) / count(*)', 1)} || '%' AS Missing_Pct, "
        f"{_txt(f'avg({c})', d)} AS Mean, {_txt(f'median({c})', d)} AS Median FROM {table}" for c in cols)


@query("profile_summary", [("Dataset", "s"), ("Variable", "s"), ("Count", "k"), ("Missing_Pct", "s"),
                           ("Mean", "s"), ("Median", "s")],
       _summary_sql("fund_raw", "Compustat", COMP_VARS, 0) + " UNION ALL "
       + _summary_sql("price_raw", "CRSP", CRSP_VARS, 2) + " UNION ALL "
       + f"""SELECT 'CDS', 'SPREAD', count_if(spread > 0),
             {_txt('100.0 * count_if(spread = 0) / count(*)', 1)} || '%',
             {_txt('avg(spread) FILTER (WHERE spread > 0)', 0)},
             {_txt('median(spread) FILTER (WHERE spread > 0)', 0)} FROM wide_cells""")
def profile_summary(st: Stages) -> DataFrame:
    comp = P.summary_table(clean.coerce_fundamentals(st.raw_fundamentals), "Compustat", COMP_VARS, 0)
    crsp = P.summary_table(clean.coerce_prices(st.raw_prices), "CRSP", CRSP_VARS, 2)
    sp = P.spread_profile(P.spread_cells(st.raw_spreads_wide))
    cds = sp.select(F.lit("CDS").alias("Dataset"), F.lit("SPREAD").alias("Variable"),
                    F.col("positive").alias("Count"),
                    F.concat(P.pct_text(F.col("zero_pct"), 1), F.lit("%")).alias("Missing_Pct"),
                    P.pct_text(F.col("mean"), 0).alias("Mean"), P.pct_text(F.col("median"), 0).alias("Median"))
    return comp.unionByName(crsp).unionByName(cds)


@query("profile_spreads", [("cells", "k"), ("zeros", "k"), ("positive", "k"), ("mean", 4), ("median", 4),
                           ("zero_pct", 6)], """
    SELECT count(*) AS cells, count_if(spread = 0) AS zeros, count_if(spread > 0) AS positive,
           avg(spread) FILTER (WHERE spread > 0) AS mean, median(spread) FILTER (WHERE spread > 0) AS median,
           100.0 * count_if(spread = 0) / count(*) AS zero_pct FROM wide_cells""")
def profile_spreads(st: Stages) -> DataFrame:
    return P.spread_profile(P.spread_cells(st.raw_spreads_wide))


QUALITY_F = [("Variable", "s"), ("Total", "k"), ("Missing", "k"), ("Missing_Pct", 2), ("Negative", "k"),
             ("Zero", "k"), ("Valid", "k"), ("Quality", "s"), ("Dataset", "s")]


def _tier_sql(rate: str, cuts, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {rate} < {c} THEN '{lab}'" for c, lab in cuts) + f" ELSE '{other}' END"


@query("quality_fundamentals", QUALITY_F, " UNION ALL ".join(
    f"SELECT '{c.upper()}' AS Variable, count(*) AS Total, count_if({c} IS NULL) AS Missing, "
    f"100.0 * count_if({c} IS NULL) / count(*) AS Missing_Pct, count_if({c} < 0) AS Negative, "
    f"count_if({c} = 0) AS Zero, count(*) - count_if({c} IS NULL) - count_if({c} < 0) AS Valid, "
    f"{_tier_sql(f'count_if({c} IS NULL) / count(*)', [(0.1, 'Good'), (0.2, 'Fair')], 'Poor')} AS Quality, "
    f"'Compustat' AS Dataset FROM fund_raw" for c in S.FUND_NUMERIC))
def quality_fundamentals(st: Stages) -> DataFrame:
    q = P.quality_numeric(clean.coerce_fundamentals(st.raw_fundamentals), S.FUND_NUMERIC)
    return q.withColumn("Dataset", F.lit("Compustat"))


QUALITY_P = [("Variable", "s"), ("Total", "k"), ("Missing", "k"), ("Missing_Pct", 2), ("Outliers", "k"),
             ("Valid", "k"), ("Quality", "s"), ("Dataset", "s")]
OUTLIER_COLS = ["prccm", "cshom"]


def _quality_p_sql(c: str) -> str:
    out = (f"count_if({c} < (SELECT mu_{c} FROM mom) - 3 * (SELECT sd_{c} FROM mom) "
           f"OR {c} > (SELECT mu_{c} FROM mom) + 3 * (SELECT sd_{c} FROM mom))") if c in OUTLIER_COLS else "0"
    return (f"SELECT '{c.upper()}' AS Variable, count(*) AS Total, count_if({c} IS NULL) AS Missing, "
            f"100.0 * count_if({c} IS NULL) / count(*) AS Missing_Pct, {out} AS Outliers, "
            f"count(*) - count_if({c} IS NULL) AS Valid, "
            f"{_tier_sql(f'count_if({c} IS NULL) / count(*)', [(0.05, 'Good')], 'Fair')} AS Quality, "
            f"'CRSP' AS Dataset FROM price_raw")


_MOM = "mom AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, stddev_samp({c}) AS sd_{c}" for c in OUTLIER_COLS) \
    + " FROM price_raw)"


@query("quality_prices", QUALITY_P, " UNION ALL ".join(_quality_p_sql(c) for c in S.PRICE_NUMERIC), extra_ctes=_MOM)
def quality_prices(st: Stages) -> DataFrame:
    q = P.quality_with_outliers(clean.coerce_prices(st.raw_prices), S.PRICE_NUMERIC, OUTLIER_COLS)
    return q.withColumn("Dataset", F.lit("CRSP"))


@query("quality_overall", [("Dataset", "s"), ("variables", "k"), ("good", "k"), ("good_share", 6),
                           ("mean_missing_pct", 6)],
       "SELECT Dataset, count(*) AS variables, count_if(Quality = 'Good') AS good, "
       "count_if(Quality = 'Good') / count(*) AS good_share, avg(Missing_Pct) AS mean_missing_pct FROM ("
       + " UNION ALL ".join(
           f"SELECT 'Compustat' AS Dataset, 100.0 * count_if({c} IS NULL) / count(*) AS Missing_Pct, "
           f"{_tier_sql(f'count_if({c} IS NULL) / count(*)', [(0.1, 'Good'), (0.2, 'Fair')], 'Poor')} AS Quality "
           f"FROM fund_raw" for c in S.FUND_NUMERIC) + " UNION ALL " + " UNION ALL ".join(
           f"SELECT 'CRSP', 100.0 * count_if({c} IS NULL) / count(*), "
           f"{_tier_sql(f'count_if({c} IS NULL) / count(*)', [(0.05, 'Good')], 'Fair')} FROM price_raw"
           for c in S.PRICE_NUMERIC) + ") GROUP BY Dataset")
def quality_overall(st: Stages) -> DataFrame:
    f = quality_fundamentals(st).select("Dataset", "Missing_Pct", "Quality")
    p = quality_prices(st).select("Dataset", "Missing_Pct", "Quality")
    return f.unionByName(p).groupBy("Dataset").agg(
        F.count(F.lit(1)).alias("variables"), count_if(F.col("Quality") == "Good").alias("good"),
        (count_if(F.col("Quality") == "Good") / F.count(F.lit(1))).alias("good_share"),
        F.avg("Missing_Pct").alias("mean_missing_pct"))


@query("quality_spreads", [("Metric", "s"), ("Value", 6)], """
    SELECT 'Total_Points' AS Metric, CAST(count(*) AS DOUBLE) AS Value FROM wide_cells
    UNION ALL SELECT 'Valid_Pct', 100.0 * count_if(spread > 0) / count(*) FROM wide_cells
    UNION ALL SELECT 'Missing_Pct', 100.0 * count_if(spread = 0 OR spread IS NULL) / count(*) FROM wide_cells
    UNION ALL SELECT 'Extreme_Values_Pct', 100.0 * (count_if(spread > 5000) + count_if(spread > 0 AND spread < 10))
              / count_if(spread > 0) FROM wide_cells
    UNION ALL SELECT 'Extreme_High', CAST(count_if(spread > 5000) AS DOUBLE) FROM wide_cells
    UNION ALL SELECT 'Extreme_Low', CAST(count_if(spread > 0 AND spread < 10) AS DOUBLE) FROM wide_cells
    UNION ALL SELECT 'Median', quantile_cont(spread, 0.5) FROM wide_cells WHERE spread > 0
    UNION ALL SELECT 'P95', quantile_cont(spread, 0.95) FROM wide_cells WHERE spread > 0""")
def quality_spreads(st: Stages) -> DataFrame:
    return P.spread_quality(P.spread_cells(st.raw_spreads_wide))


@query("quality_spread_coverage", [("instruments", "k"), ("mean_coverage_pct", 6), ("over_90", "k"),
                                   ("under_50", "k")], """
    SELECT count(*) AS instruments, 100.0 * avg(cov) AS mean_coverage_pct, count_if(cov > 0.9) AS over_90,
           count_if(cov < 0.5) AS under_50
    FROM (SELECT iqt, count_if(spread > 0) / count(*) AS cov FROM wide_cells GROUP BY iqt)""")
def quality_spread_coverage(st: Stages) -> DataFrame:
    return P.spread_coverage(P.spread_cells(st.raw_spreads_wide))


MISS_F = ["atq", "ltq", "niq", "saleq"]
MISS_P = ["prccm", "trt1m"]
_MBY = (" UNION ALL ".join(f"SELECT 'Compustat' AS dataset, year(datadate) AS year, '{c}' AS variable, "
                           f"100.0 * count_if({c} IS NULL) / count(*) AS missing_pct FROM fund_raw GROUP BY 2"
                           for c in MISS_F) + " UNION ALL " +
        " UNION ALL ".join(f"SELECT 'CRSP', year(datadate), '{c}', 100.0 * count_if({c} IS NULL) / count(*) "
                           f"FROM price_raw GROUP BY 2" for c in MISS_P))


def _missing_by_year(st: Stages) -> DataFrame:
    f = P.missing_by_year(clean.coerce_fundamentals(st.raw_fundamentals), "datadate", MISS_F, "Compustat")
    p = P.missing_by_year(clean.coerce_prices(st.raw_prices), "datadate", MISS_P, "CRSP")
    return f.unionByName(p)


@query("quality_missing_by_year", [("dataset", "s"), ("year", "k"), ("variable", "s"), ("missing_pct", 6)], _MBY)
def quality_missing_by_year(st: Stages) -> DataFrame:
    return _missing_by_year(st)


@query("quality_missing_years_summary", [("dataset", "s"), ("variable", "s"), ("mean_pct", 6), ("min_pct", 6),
                                         ("max_pct", 6), ("years", "k")],
       f"SELECT dataset, variable, avg(missing_pct) AS mean_pct, min(missing_pct) AS min_pct, "
       f"max(missing_pct) AS max_pct, count(*) AS years FROM ({_MBY}) GROUP BY 1, 2")
def quality_missing_years_summary(st: Stages) -> DataFrame:
    return _missing_by_year(st).groupBy("dataset", "variable").agg(
        F.avg("missing_pct").alias("mean_pct"), F.min("missing_pct").alias("min_pct"),
        F.max("missing_pct").alias("max_pct"), F.count(F.lit(1)).alias("years"))


@query("coverage_counts", [("dataset", "s"), ("rows", "k"), ("firms", "k")], """
    SELECT 'Compustat' AS dataset, count(*) AS rows, count(DISTINCT gvkey) AS firms FROM fund_raw
    UNION ALL SELECT 'CRSP', count(*), count(DISTINCT gvkey) FROM price_raw
    UNION ALL SELECT 'CDS', count(DISTINCT iqt), count(DISTINCT iqt) FROM wide_cells
    UNION ALL SELECT 'Mapping', count(*), count(DISTINCT gvkey) FROM map_raw""")
def coverage_counts(st: Stages) -> DataFrame:
    def cnt(df, name, key, rows=None):
        return df.agg(F.lit(name).alias("dataset"),
                      (F.count(F.lit(1)) if rows is None else rows).alias("rows"),
                      F.countDistinct(key).alias("firms"))
    w = st.raw_spreads_wide
    return (cnt(st.raw_fundamentals, "Compustat", "gvkey").unionByName(cnt(st.raw_prices, "CRSP", "gvkey"))
            .unionByName(cnt(w, "CDS", w.columns[0])).unionByName(cnt(st.raw_mapping, "Mapping", "gvkey")))


def _firm_sets(st: Stages):
    from ..functions.exprs import to_long
    f = st.raw_fundamentals.select(to_long("gvkey", st.raw_fundamentals.schema["gvkey"].dataType).alias("gvkey"))
    p = st.raw_prices.select(to_long("gvkey", st.raw_prices.schema["gvkey"].dataType).alias("gvkey"))
    m = st.raw_mapping.select(to_long("gvkey", st.raw_mapping.schema["gvkey"].dataType).alias("gvkey"))
    return [x.filter(F.col("gvkey").isNotNull()).distinct() for x in (f, p, m)]


@query("coverage_overlap", [("fundamentals_firms", "k"), ("complete_firms", "k"), ("coverage_rate_pct", 6)], """
    SELECT (SELECT count(DISTINCT gvkey) FROM fund_raw) AS fundamentals_firms, count(*) AS complete_firms,
           100.0 * count(*) / (SELECT count(DISTINCT gvkey) FROM fund_raw) AS coverage_rate_pct
    FROM (SELECT gvkey FROM fund_raw INTERSECT SELECT gvkey FROM price_raw
          INTERSECT SELECT TRY_CAST(gvkey AS BIGINT) FROM map_raw)""")
def coverage_overlap(st: Stages) -> DataFrame:
    f, p, m = _firm_sets(st)
    both = f.intersect(p).intersect(m)
    nf = f.agg(F.count(F.lit(1)).alias("fundamentals_firms"))
    return both.agg(F.count(F.lit(1)).alias("complete_firms")).crossJoin(nf).withColumn(
        "coverage_rate_pct", F.lit(100.0) * F.col("complete_firms") / F.col("fundamentals_firms"))


@query("profile_metadata", [("Metric", "s"), ("Value", "s")], """
    SELECT 'Complete_Firms' AS Metric, CAST(count(*) AS VARCHAR) AS Value
    FROM (SELECT gvkey FROM fund_raw INTERSECT SELECT gvkey FROM price_raw
          INTERSECT SELECT TRY_CAST(gvkey AS BIGINT) FROM map_raw)
    UNION ALL SELECT 'Date_Range', CAST(min(year(datadate)) AS VARCHAR) || '-' || CAST(max(year(datadate)) AS VARCHAR)
    FROM fund_raw
    UNION ALL SELECT 'Datasets', 'Compustat, CRSP, CDS, Mapping'
    UNION ALL SELECT 'Status', 'Ready'""")
def profile_metadata(st: Stages) -> DataFrame:
    f, p, m = _firm_sets(st)
    n = f.intersect(p).intersect(m).agg(F.count(F.lit(1)).cast("string").alias("v"))
    yr = st.raw_fundamentals.agg(F.concat(F.min(F.year("datadate")).cast("string"), F.lit("-"),
                                          F.max(F.year("datadate")).cast("string")).alias("dr"))
    row = n.crossJoin(yr)
    items = [("Complete_Firms", F.col("v")), ("Date_Range", F.col("dr")),
             ("Datasets", F.lit("Compustat, CRSP, CDS, Mapping")), ("Status", F.lit("Ready"))]
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("Metric"), v.alias("Value"))
                                          for k, v in items])).alias("r")).select("r.*")


@query("panel_date_range", [("dataset", "s"), ("date_from", "s"), ("date_to", "s"), ("years", "k")], """
    SELECT 'Compustat' AS dataset, strftime(min(datadate), '%Y-%m') AS date_from,
           strftime(max(datadate), '%Y-%m') AS date_to, count(DISTINCT year(datadate)) AS years FROM fund_raw
    UNION ALL SELECT 'CRSP', strftime(min(datadate), '%Y-%m'), strftime(max(datadate), '%Y-%m'),
           count(DISTINCT year(datadate)) FROM price_raw
    UNION ALL SELECT 'CDS', strftime(min(date), '%Y-%m'), strftime(max(date), '%Y-%m'),
           count(DISTINCT year(date)) FROM wide_cells
    UNION ALL SELECT 'Panel', strftime(min(date), '%Y-%m'), strftime(max(date), '%Y-%m'),
           count(DISTINCT year(date)) FROM merged""")
def panel_date_range(st: Stages) -> DataFrame:
    def rng(df, name, c):
        return df.agg(F.lit(name).alias("dataset"), F.date_format(F.min(c), "yyyy-MM").alias("date_from"),
                      F.date_format(F.max(c), "yyyy-MM").alias("date_to"),
                      F.countDistinct(F.year(c)).alias("years"))
    cells = P.spread_cells(st.raw_spreads_wide)
    return (rng(st.raw_fundamentals, "Compustat", "datadate").unionByName(rng(st.raw_prices, "CRSP", "datadate"))
            .unionByName(rng(cells, "CDS", "date")).unionByName(rng(st.merged, "Panel", "date")))


@query("panel_obs_per_firm", [("firms", "k"), ("mean_obs", 6), ("median_obs", 6), ("min_obs", "k"),
                              ("max_obs", "k")], """
    SELECT count(*) AS firms, avg(n) AS mean_obs, median(n) AS median_obs, min(n) AS min_obs, max(n) AS max_obs
    FROM (SELECT gvkey, count(*) AS n FROM merged GROUP BY gvkey)""")
def panel_obs_per_firm(st: Stages) -> DataFrame:
    per = st.merged.groupBy("gvkey").agg(F.count(F.lit(1)).alias("n"))
    med = quantile_row(per, ["n"], [0.5], names=["med"]).withColumnRenamed("n_med", "median_obs")
    return per.agg(F.count(F.lit(1)).alias("firms"), F.avg("n").alias("mean_obs"),
                   F.min("n").alias("min_obs"), F.max("n").alias("max_obs")).crossJoin(med)


PANEL_VARS = [c for c in S.MERGED_COLS if c not in ("gvkey", "company_name", "date", "year", "quarter")]


@query("panel_coverage", [("variable", "s"), ("non_null", "k"), ("coverage_pct", 6)], " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS non_null, 100.0 * count({c}) / count(*) AS coverage_pct FROM merged"
    for c in PANEL_VARS))
def panel_coverage(st: Stages) -> DataFrame:
    return P.coverage(st.merged, PANEL_VARS)


ML_FEATS = S.ACCOUNTING_FEATURES + S.MARKET_FEATURES + S.LAGGED_FEATURES


@query("panel_complete_cases", [("split", "s"), ("rows", "k"), ("complete", "k"), ("complete_pct", 6)],
       "SELECT split, count(*) AS rows, count_if(" + " AND ".join(f"{c} IS NOT NULL" for c in ML_FEATS)
       + ") AS complete, 100.0 * count_if(" + " AND ".join(f"{c} IS NOT NULL" for c in ML_FEATS)
       + ") / count(*) AS complete_pct FROM split_tbl GROUP BY split")
def panel_complete_cases(st: Stages) -> DataFrame:
    feats = st.feature_cols
    allp = F.lit(True)
    for c in feats:
        allp = allp & F.col(c).isNotNull()
    return st.split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), count_if(allp).alias("complete"),
                                         (F.lit(100.0) * count_if(allp) / F.count(F.lit(1))).alias("complete_pct"))


@query("panel_mean_non_null", [("split", "s"), ("mean_non_null", 6), ("features", "k")],
       "SELECT split, avg(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in ML_FEATS)
       + f") AS mean_non_null, {len(ML_FEATS)} AS features FROM split_tbl GROUP BY split")
def panel_mean_non_null(st: Stages) -> DataFrame:
    feats = st.feature_cols
    nn = sum((F.col(c).isNotNull().cast("int") for c in feats), F.lit(0))
    return st.split.groupBy("split").agg(F.avg(nn).alias("mean_non_null"), F.lit(len(feats)).alias("features"))


def _group(c: str) -> str:
    if c in S.ACCOUNTING_FEATURES:
        return "accounting"
    if c in S.MARKET_FEATURES:
        return "market"
    return "lagged"


@query("feature_list", [("position", "k"), ("feature", "s"), ("grp", "s"), ("non_null", "k")], " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS feature, '{_group(c)}' AS grp, count({c}) AS non_null FROM ml_dataset"
    for i, c in enumerate(ML_FEATS)))
def feature_list(st: Stages) -> DataFrame:
    """The model's feature columns picked from the schema, with their coverage."""
    feats = st.feature_cols
    row = st.ml_dataset.agg(*[F.count(c).alias(c) for c in feats])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("feature"), F.lit(_group(c)).alias("grp"),
                 F.col(c).alias("non_null")) for i, c in enumerate(feats)])).alias("r")).select("r.*")


GROUPS = [("ids", S.ID_COLS), ("accounting", S.ACCOUNTING_FEATURES), ("market", S.MARKET_FEATURES), ("lagged", S.LAGGED_FEATURES),
          ("target source", S.TARGET_SOURCE), ("removed", [c for c in S.FEATURES_COMPLETE_COLS if c not in S.SELECTED_COLS])]


@query("feature_groups", [("grp", "s"), ("columns", "k"), ("non_null", "k")], " UNION ALL ".join(
    f"SELECT '{g}' AS grp, {len(cols)} AS columns, {' + '.join(f'count({c})' for c in cols)} AS non_null FROM features_complete"
    for g, cols in GROUPS))
def feature_groups(st: Stages) -> DataFrame:
    """Columns of each group, the ones that the selection removes among them, and their values."""
    have = st.features_complete.columns
    row = st.features_complete.agg(*[F.count(c).alias(c) for c in have])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(len([c for c in cols if c in have])).alias("columns"),
                 sum((F.col(c) for c in cols if c in have), F.lit(0)).alias("non_null")) for g, cols in GROUPS])).alias("r")).select("r.*")



SINK_COLS = [*S.ML_DATASET_COLS, "split"]


@query("sink_roundtrip", [(c, 1) if c == "distress_flag" else (c, k) for c, k in spec_of(SINK_COLS)],
       f"SELECT {', '.join(SINK_COLS)} FROM split_tbl")
def sink_roundtrip(st: Stages) -> DataFrame:
    """The whole split table written as Parquet partitioned by ``year`` into the shared folder, read back."""
    path = f"{scratch_dir(st.spark).rstrip('/')}/tables/split-{uuid.uuid4().hex}"
    st.split.select(*SINK_COLS).write.partitionBy("year").parquet(path)
    return st.spark.read.parquet(path)


# ---------------------------------------------------------------- CSV (S1-S5, S10) --------------
def _through_csv(st: Stages, df: DataFrame, kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A table written in the dialect of a raw file into the shared folder and read back as text."""
    path = f"{scratch_dir(st.spark).rstrip('/')}/csv/{kind}-{uuid.uuid4().hex}"
    C.write_csv(df, path, kind)
    return C.read_csv(st.spark, path, kind, extra)


def _same_as(name: str, csv_name: str):
    return query(csv_name, _R[name].spec, _R[name].sql, _R[name].extra_ctes)


@_same_as("src_fundamentals", "csv_fundamentals")
def csv_fundamentals(st: Stages) -> DataFrame:
    """Semicolons, Latin-1."""
    df = st.raw_fundamentals.select(*C.COLUMNS["fundamentals"], "ingest_id")
    return clean.coerce_fundamentals(_through_csv(st, df, "fundamentals", ("ingest_id",)))


@_same_as("src_prices", "csv_prices")
def csv_prices(st: Stages) -> DataFrame:
    """Commas, header."""
    return clean.coerce_prices(_through_csv(st, st.raw_prices.select(*C.COLUMNS["prices"], "ingest_id"), "prices", ("ingest_id",)))


@_same_as("cds_long", "csv_spreads")
def csv_spreads(st: Stages) -> DataFrame:
    """S3: the wide matrix, whose header line holds the dates."""
    return clean.spreads_long(_through_csv(st, st.raw_spreads_wide, "spreads"))


@_same_as("src_mapping", "csv_mapping")
def csv_mapping(st: Stages) -> DataFrame:
    """No header."""
    return _through_csv(st, st.raw_mapping.select(*C.COLUMNS["mapping"], "ingest_id"), "mapping", ("ingest_id",))


@_same_as("link_cusip", "csv_firm_master")
def csv_firm_master(st: Stages) -> DataFrame:
    """Semicolons; blanks around values stay for the link step to trim."""
    df = _through_csv(st, st.raw_firm_master.select(*C.COLUMNS["firm_master"], "ingest_id"), "firm_master", ("ingest_id",))
    return clean.link_cusip(df.withColumn("ingest_id", F.col("ingest_id").cast("long")))


@_same_as("profile_metadata", "csv_metadata")
def csv_metadata(st: Stages) -> DataFrame:
    """The key / value sink."""
    return _through_csv(st, profile_metadata(st), "report")


# ---------------------------------------------------------------- correlations (A22-A24, O3) ----
def _corr_sql(a: str, b: str) -> str:
    """Pearson r over the rows where both are present; NULL where one of them does not vary."""
    return (f"CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) <> 0 "
            f"THEN covar_pop({a}, {b}) / (stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END)) END")


CORR_COLS = [c for c in S.FEATURES_COMPLETE_COLS if c not in S.ID_COLS]
_CORR_PAIRS = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
_CORR_CTES = ("corr_row AS (SELECT " + ", ".join(f"{_corr_sql(a, b)} AS c{i}" for i, (a, b) in enumerate(_CORR_PAIRS)) + " FROM features_complete),\n"
              "corr_all AS (" + " UNION ALL ".join(f"SELECT {i} AS pair, '{a}' AS feature1, '{b}' AS feature2, c{i} AS corr FROM corr_row"
                                                   for i, (a, b) in enumerate(_CORR_PAIRS)) + ")")
HIGH_CORR = 0.9


def correlations(st: Stages) -> DataFrame:
    """A22 over the numeric columns after step 7, staged: one row a pair."""
    table = st.__dict__.get("_correlations")
    if table is None:
        rows = st.cut(st.features_complete.select(*CORR_COLS), "features_complete")
        st._correlations = table = st.cut(P.corr_matrix(rows, CORR_COLS), "correlations")
    return table


@query("feat_corr_matrix", [("pair", "k"), ("feature1", "s"), ("feature2", "s"), ("corr", 6)],
       "SELECT pair, feature1, feature2, corr FROM corr_all", extra_ctes=_CORR_CTES)
def feat_corr_matrix(st: Stages) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair of columns."""
    return correlations(st)


@query("feat_corr_high", [("feature1", "s"), ("feature2", "s"), ("corr", 6)],
       f"SELECT feature1, feature2, corr FROM corr_all WHERE abs(corr) > {HIGH_CORR}", extra_ctes=_CORR_CTES)
def feat_corr_high(st: Stages) -> DataFrame:
    """The pairs whose correlation exceeds 0.9 in size."""
    return correlations(st).filter(F.abs("corr") > HIGH_CORR).drop("pair")


@query("feat_corr_target", [("rank", "k"), ("feature", "s"), ("abs_corr", 6)],
       """SELECT rank, feature, abs_corr FROM (SELECT row_number() OVER (ORDER BY abs_corr DESC, feature) AS rank, feature, abs_corr FROM (
    SELECT CASE WHEN feature1 = 'cds_spread' THEN feature2 ELSE feature1 END AS feature, abs(corr) AS abs_corr FROM corr_all
    WHERE corr IS NOT NULL AND 'cds_spread' IN (feature1, feature2))) WHERE rank <= 9""", extra_ctes=_CORR_CTES)
def feat_corr_target(st: Stages) -> DataFrame:
    """The 9 columns most correlated with the spread; the reference's top 10 starts with
    the spread itself, which it skips."""
    name = F.when(F.col("feature1") == "cds_spread", F.col("feature2")).otherwise(F.col("feature1"))
    c = (correlations(st).filter(F.col("corr").isNotNull() & F.lit("cds_spread").isin(F.col("feature1"), F.col("feature2")))
         .select(name.alias("feature"), F.abs("corr").alias("abs_corr")))
    w = Window.orderBy(F.desc("abs_corr"), "feature")          # one row a column
    return c.withColumn("rank", F.row_number().over(w)).filter("rank <= 9")


_FILE_ORDER = [c for c in FUND_CLEAN_COLS if c != "ingest_id"]


@query("csv_first_kept", spec_of(_FILE_ORDER), f"SELECT {', '.join(_FILE_ORDER)} FROM fund_clean")
def csv_first_kept(st: Stages) -> DataFrame:
    """Duplicates by the order of rows in files that have no key: several files, read in blocks."""
    path = f"{scratch_dir(st.spark).rstrip('/')}/csv/ordered-{uuid.uuid4().hex}"
    rows = st.raw_fundamentals.repartitionByRange(6, "ingest_id").sortWithinPartitions("ingest_id").select(*C.COLUMNS["fundamentals"])
    C.write_csv(rows, path, "fundamentals")
    return clean.clean_fundamentals(C.in_file_order(C.read_csv(st.spark, path, "fundamentals")))
