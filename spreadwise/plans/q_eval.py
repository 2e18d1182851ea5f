"""Evaluation queries on the spread-only baseline score (closed form, so value-checkable)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.exprs import draw_key, rnd, uniform
from ..operators import metrics as M
from .pipeline import Stages
from .registry import REGISTRY as _R
from .registry import query, sql_rnd

# ---- score table: test rows, baseline fitted on test (as the reference does, T16) --------
SCORE_CTES = f"""sc_test AS (SELECT * FROM split_tbl WHERE split = 'test'),
sc_stats AS (SELECT quantile_cont(cds_spread, 0.5) AS med, stddev_pop(cds_spread) AS sd FROM sc_test),
sc_all AS (SELECT t.*, CASE WHEN cds_spread > med THEN 1 ELSE 0 END AS pred,
    {sql_rnd("coalesce(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-((cds_spread - med) / (sd + CAST(1e-6 AS DOUBLE))))), CAST(0.5 AS DOUBLE))", 6)} AS p
    FROM split_tbl t, sc_stats),
scores AS (SELECT gvkey, date, year(date) AS year, CAST(distress_flag AS BIGINT) AS label, pred, p,
    CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred05 FROM sc_all WHERE split = 'test'),
cnt AS (SELECT p AS s, sum(label) AS pos, count(*) - sum(label) AS neg FROM scores GROUP BY p),
cum_desc AS (SELECT s, pos, neg,
    sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM cnt),
grid AS (SELECT i, CAST(0.1 AS DOUBLE) + CAST(i AS DOUBLE) * CAST(0.05 AS DOUBLE) AS threshold FROM range(16) r(i)),
sweep AS (SELECT g.i, g.threshold, count_if(s.label = 1 AND s.p >= g.threshold) AS tp,
    count_if(s.label = 0 AND s.p >= g.threshold) AS fp, sum(s.label) AS P
    FROM grid g, scores s GROUP BY g.i, g.threshold),
sweep_m AS (SELECT i, threshold, tp, fp,
    coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision, coalesce(tp / NULLIF(P, 0), 0) AS recall,
    coalesce(2 * tp / NULLIF(tp + fp + P, 0), 0) AS f1 FROM sweep)"""


def _auc_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    grp = f"{by}, " if by else ""
    return f"""SELECT {grp}sum(pos * (neg_before + neg / 2.0)) / NULLIF(sum(pos) * sum(neg), 0) AS auc,
        sum(pos) AS positives, sum(neg) AS negatives FROM (
        SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_before FROM (SELECT {grp}p AS s, sum(label) AS pos, count(*) - sum(label) AS neg
        FROM {src} GROUP BY {grp}p)) {"GROUP BY " + by if by else ""}"""


def scored(st: Stages) -> DataFrame:
    """All labelled rows scored by the baseline fitted on the test rows, staged once. The score is
    rounded here, for the comparison of engines, not in the operator."""
    table = st.__dict__.get("_scored")
    if table is None:
        test = st.split.filter(F.col("split") == "test")
        rows = M.spread_baseline(st.split, fit=test)
        st._scored = table = st.cut(rows.select("gvkey", "company_name", "date", "split", F.col(S.LABEL).cast("long").alias("label"),
                                                "pred", rnd(F.col("p"), 6).alias("p")), "scores")
    return table


def test_scores(st: Stages) -> DataFrame:
    s = scored(st).filter(F.col("split") == "test")
    return s.select("gvkey", "company_name", "date", F.year("date").cast("long").alias("year"), "label", "pred", "p",
                    F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("pred05"))


@query("baseline_spread", [("gvkey", "k"), ("date", "d"), ("year", "k"), ("label", "k"), ("pred", "k"), ("p", 6)],
       "SELECT gvkey, date, year, label, pred, p FROM scores", extra_ctes=SCORE_CTES)
def baseline_spread(st: Stages) -> DataFrame:
    return test_scores(st)


CONF = [("tn", "k"), ("fp", "k"), ("fn", "k"), ("tp", "k"), ("tn_share", 6), ("fp_share", 6), ("fn_share", 6),
        ("tp_share", 6), ("specificity", 6), ("sensitivity", 6)]


@query("eval_confusion", CONF, """SELECT tn, fp, fn, tp, tn / n AS tn_share, fp / n AS fp_share, fn / n AS fn_share,
    tp / n AS tp_share, coalesce(tn / NULLIF(tn + fp, 0), 0) AS specificity, coalesce(tp / NULLIF(tp + fn, 0), 0) AS sensitivity
    FROM (SELECT count_if(label = 0 AND pred05 = 0) AS tn, count_if(label = 0 AND pred05 = 1) AS fp,
          count_if(label = 1 AND pred05 = 0) AS fn, count_if(label = 1 AND pred05 = 1) AS tp,
          CAST(count(*) AS DOUBLE) AS n FROM scores)""", extra_ctes=SCORE_CTES)
def eval_confusion(st: Stages) -> DataFrame:
    c = M.with_rates(M.confusion(test_scores(st), pred="pred05"))
    return c.select("tn", "fp", "fn", "tp", *[(F.col(x) / F.col("n")).alias(f"{x}_share") for x in ("tn", "fp", "fn", "tp")],
                    "specificity", F.col("recall").alias("sensitivity"))


METRICS = [("model", "s"), ("accuracy", 6), ("precision", 6), ("recall", 6), ("f1", 6), ("auc", 6)]


@query("eval_metrics", METRICS, f"""SELECT 'CDS-Only' AS model, (tp + tn) / n AS accuracy,
    coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, (SELECT auc FROM ({_auc_sql('scores')})) AS auc
    FROM (SELECT count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp,
          count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp,
          CAST(count(*) AS DOUBLE) AS n FROM scores)""", extra_ctes=SCORE_CTES)
def eval_metrics(st: Stages) -> DataFrame:
    s = test_scores(st)
    c = M.with_rates(M.confusion(s, pred="pred"))
    return c.crossJoin(M.auc(s).select("auc")).select(F.lit("CDS-Only").alias("model"), "accuracy", "precision",
                                                      "recall", "f1", "auc")


@query("eval_auc", [("auc", 6), ("positives", "k"), ("negatives", "k")], _auc_sql("scores"), extra_ctes=SCORE_CTES)
def eval_auc(st: Stages) -> DataFrame:
    return M.auc(test_scores(st))


@query("eval_average_precision", [("average_precision", 6), ("prevalence", 6)],
       "SELECT sum(pos / P * (tp / (tp + fp))) AS average_precision, max(P / (P + N)) AS prevalence FROM cum_desc",
       extra_ctes=SCORE_CTES)
def eval_average_precision(st: Stages) -> DataFrame:
    return M.average_precision(test_scores(st))


@query("eval_roc_points", [("threshold", 6), ("fpr", 6), ("tpr", 6)],
       "SELECT s AS threshold, fp / N AS fpr, tp / P AS tpr FROM cum_desc", extra_ctes=SCORE_CTES)
def eval_roc_points(st: Stages) -> DataFrame:
    return M.curve_points(test_scores(st)).select("threshold", "fpr", "tpr")


@query("eval_pr_points", [("threshold", 6), ("precision", 6), ("recall", 6), ("prevalence", 6)],
       "SELECT s AS threshold, tp / (tp + fp) AS precision, tp / P AS recall, P / (P + N) AS prevalence FROM cum_desc",
       extra_ctes=SCORE_CTES)
def eval_pr_points(st: Stages) -> DataFrame:
    return M.curve_points(test_scores(st)).select("threshold", "precision", "recall", "prevalence")


BY_YEAR = [("year", "k"), ("n_obs", "k"), ("n_distress", "k"), ("distress_rate", 6), ("accuracy", 6),
           ("precision", 6), ("recall", 6), ("f1", 6), ("auc", 6)]
_BY_YEAR_SQL = f"""SELECT c.year, n AS n_obs, tp + fn AS n_distress, (tp + fn) / n AS distress_rate, (tp + tn) / n AS accuracy,
    coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, a.auc
    FROM (SELECT year, count_if(label = 0 AND pred05 = 0) AS tn, count_if(label = 0 AND pred05 = 1) AS fp,
          count_if(label = 1 AND pred05 = 0) AS fn, count_if(label = 1 AND pred05 = 1) AS tp,
          CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY year) c
    JOIN ({_auc_sql('scores', 'year')}) a ON a.year = c.year WHERE tp + fn > 0"""


def _by_year(st: Stages) -> DataFrame:
    return by_year(test_scores(st))


def by_year(s: DataFrame) -> DataFrame:
    """Metrics of ``(year, label, p, pred05)`` by year, for years with a positive row."""
    c = M.with_rates(M.confusion(s, pred="pred05", by=["year"]))
    a = M.auc(s, by=["year"]).select("year", "auc")
    return c.join(a, "year").filter(F.col("tp") + F.col("fn") > 0).select(
        "year", F.col("n").alias("n_obs"), (F.col("tp") + F.col("fn")).alias("n_distress"),
        ((F.col("tp") + F.col("fn")) / F.col("n")).alias("distress_rate"), "accuracy", "precision", "recall", "f1", "auc")


@query("eval_by_year", BY_YEAR, _BY_YEAR_SQL, extra_ctes=SCORE_CTES)
def eval_by_year(st: Stages) -> DataFrame:
    return _by_year(st)


SWEEP = [("i", "k"), ("threshold", 2), ("tp", "k"), ("fp", "k"), ("precision", 6), ("recall", 6), ("f1", 6)]


@query("eval_threshold_sweep", SWEEP, "SELECT * FROM sweep_m", extra_ctes=SCORE_CTES)
def eval_threshold_sweep(st: Stages) -> DataFrame:
    return M.threshold_sweep(test_scores(st))


@query("eval_threshold_best", [("best_threshold", 2), ("best_f1", 6), ("best_precision", 6), ("best_recall", 6),
                               ("f1_default", 6), ("f1_improvement", 6)], """
    SELECT b.threshold AS best_threshold, b.f1 AS best_f1, b.precision AS best_precision, b.recall AS best_recall,
           d.f1 AS f1_default, b.f1 - d.f1 AS f1_improvement
    FROM (SELECT * FROM sweep_m ORDER BY f1 DESC, i ASC LIMIT 1) b,
         (SELECT * FROM sweep_m ORDER BY abs(threshold - 0.5), i LIMIT 1) d""", extra_ctes=SCORE_CTES)
def eval_threshold_best(st: Stages) -> DataFrame:
    return M.best_threshold(M.threshold_sweep(test_scores(st)))


@query("eval_gap", [("auc_train", 6), ("auc_test", 6), ("gap", 6), ("overfit", "s")], f"""
    SELECT tr.auc AS auc_train, te.auc AS auc_test, tr.auc - te.auc AS gap,
           CASE WHEN tr.auc - te.auc > 0.15 THEN 'High' WHEN tr.auc - te.auc > 0.10 THEN 'Moderate' ELSE 'Low' END AS overfit
    FROM ({_auc_sql("(SELECT CAST(distress_flag AS BIGINT) AS label, p FROM sc_all WHERE split = 'train')")}) tr,
         ({_auc_sql("(SELECT CAST(distress_flag AS BIGINT) AS label, p FROM sc_all WHERE split = 'test')")}) te""",
       extra_ctes=SCORE_CTES)
def eval_gap(st: Stages) -> DataFrame:
    s = scored(st)
    a = M.auc(s, by=["split"]).groupBy().agg(
        F.max(F.when(F.col("split") == "train", F.col("auc"))).alias("auc_train"),
        F.max(F.when(F.col("split") == "test", F.col("auc"))).alias("auc_test"))
    gap = F.col("auc_train") - F.col("auc_test")
    return a.withColumn("gap", gap).withColumn(
        "overfit", F.when(gap > 0.15, "High").when(gap > 0.10, "Moderate").otherwise("Low"))


@query("eval_report", [("overall_auc", 6), ("best_year", "k"), ("best_year_auc", 6), ("worst_year", "k"),
                       ("worst_year_auc", 6), ("yearly_auc_std", 6), ("average_precision", 6)], f"""
    SELECT (SELECT sum(pos / P * (tp / (tp + fp))) FROM cum_desc) AS average_precision, (SELECT auc FROM ({_auc_sql('scores')})) AS overall_auc, arg_max(year, auc) AS best_year, max(auc) AS best_year_auc,
           arg_min(year, auc) AS worst_year, min(auc) AS worst_year_auc, stddev_samp(auc) AS yearly_auc_std
    FROM ({_BY_YEAR_SQL})""", extra_ctes=SCORE_CTES)
def eval_report(st: Stages) -> DataFrame:
    y = _by_year(st)
    r = y.agg(F.max_by("year", F.struct("auc", F.col("year"))).alias("best_year"), F.max("auc").alias("best_year_auc"),
              F.min_by("year", F.struct("auc", F.col("year"))).alias("worst_year"), F.min("auc").alias("worst_year_auc"),
              F.stddev_samp("auc").alias("yearly_auc_std"))
    t = test_scores(st)
    return (M.auc(t).select(F.col("auc").alias("overall_auc")).crossJoin(r)
            .crossJoin(M.average_precision(t).select("average_precision")))


@query("baseline_majority", [("model", "s"), ("majority_label", "k"), ("accuracy", 6), ("precision", 6),
                             ("recall", 6), ("f1", 6), ("auc", 6)], """
    SELECT 'Majority Class' AS model, m AS majority_label,
           count_if(label = m) / CAST(count(*) AS DOUBLE) AS accuracy,
           coalesce(count_if(label = 1 AND m = 1) / NULLIF(count_if(m = 1), 0), 0) AS precision,
           coalesce(count_if(label = 1 AND m = 1) / NULLIF(count_if(label = 1), 0), 0) AS recall,
           coalesce(2 * count_if(label = 1 AND m = 1) / NULLIF(count_if(m = 1) + count_if(label = 1), 0), 0) AS f1,
           0.5 AS auc
    FROM scores, (SELECT CASE WHEN 2 * sum(label) > count(*) THEN 1 ELSE 0 END AS m FROM scores)
    GROUP BY m""", extra_ctes=SCORE_CTES)
def baseline_majority(st: Stages) -> DataFrame:
    """The most frequent test label for every row (ties -> 0); a constant score has AUC 0.5."""
    s = test_scores(st)
    m = s.agg(F.when(2 * F.sum("label") > F.count(F.lit(1)), 1).otherwise(0).alias("m"))
    j = s.crossJoin(F.broadcast(m)).withColumn("pred_m", F.col("m"))
    c = M.with_rates(M.confusion(j, pred="pred_m")).crossJoin(m)
    return c.select(F.lit("Majority Class").alias("model"), F.col("m").alias("majority_label"), "accuracy",
                    "precision", "recall", "f1", F.lit(0.5).alias("auc"))


DRAW_CTES = SCORE_CTES + """,
draws AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', CAST(gvkey AS VARCHAR), CAST(date AS VARCHAR), '42')), 1, 8) AS BIGINT)
    / CAST(4294967296 AS DOUBLE) AS u FROM scores)"""


def _draw_sql(model: str, pred: str, auc: str) -> str:
    return f"""SELECT '{model}' AS model, (tp + tn) / n AS accuracy, coalesce(tp / NULLIF(tp + fp, 0), 0) AS precision,
    coalesce(tp / NULLIF(tp + fn, 0), 0) AS recall, coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0) AS f1, {auc} AS auc
    FROM (SELECT count_if(label = 0 AND NOT {pred}) AS tn, count_if(label = 0 AND {pred}) AS fp,
          count_if(label = 1 AND NOT {pred}) AS fn, count_if(label = 1 AND {pred}) AS tp,
          CAST(count(*) AS DOUBLE) AS n FROM draws)"""


_BASE = [("model", "s"), ("accuracy", 6), ("precision", 6), ("recall", 6), ("f1", 6), ("auc", 6)]
_DRAWN = "(u < (SELECT avg(label) FROM scores))"
_STRATIFIED_AUC = f"(SELECT auc FROM ({_auc_sql(f'(SELECT label, CASE WHEN {_DRAWN} THEN 1 ELSE 0 END AS p FROM draws)')}))"


@query("baseline_random", _BASE, _draw_sql("Random", "(u < 0.5)", "0.5"), extra_ctes=DRAW_CTES)
def baseline_random(st: Stages) -> DataFrame:
    """M10 coin flip: draw < 0.5 -> 1; its probability is the constant 0.5 (AUC 0.5)."""
    s = test_scores(st).withColumn("pred_r", (uniform(draw_key("gvkey", "date")) < 0.5).cast("int"))
    c = M.with_rates(M.confusion(s, pred="pred_r"))
    return c.select(F.lit("Random").alias("model"), "accuracy", "precision", "recall", "f1", F.lit(0.5).alias("auc"))


@query("baseline_stratified", _BASE, _draw_sql("Stratified", _DRAWN, _STRATIFIED_AUC), extra_ctes=DRAW_CTES)
def baseline_stratified(st: Stages) -> DataFrame:
    """M10 stratified: draw < prevalence -> 1; the 0/1 draw is also the score."""
    s = test_scores(st)
    prev = s.agg(F.avg("label").alias("prev"))
    d = s.crossJoin(F.broadcast(prev)).withColumn("pred_s", (uniform(draw_key("gvkey", "date")) < F.col("prev")).cast("int"))
    c = M.with_rates(M.confusion(d, pred="pred_s"))
    a = M.auc(d.withColumn("ps", F.col("pred_s").cast("double")), score="ps").select("auc")
    return c.crossJoin(a).select(F.lit("Stratified").alias("model"), "accuracy", "precision", "recall", "f1", "auc")


def _baselines(st: Stages) -> DataFrame:
    """A43 rows of the four baselines."""
    out = None
    for p in (baseline_random(st), baseline_majority(st).drop("majority_label"), baseline_stratified(st), eval_metrics(st)):
        p = p.select(F.col("model").alias("Model"), F.lit("Baseline").alias("Type"),
                     F.col("accuracy").alias("Accuracy"), F.col("precision").alias("Precision"),
                     F.col("recall").alias("Recall"), F.col("f1").alias("F1"), F.col("auc").alias("AUC"))
        out = p if out is None else out.unionByName(p)
    return out


def improvement(rows: DataFrame, names: tuple[str, ...] = ("AUC", "F1", "Precision", "Recall", "Accuracy")) -> DataFrame:
    """The model of the largest AUC against the baseline of the largest AUC (ties: first by
    name), by metric: both values, their difference, and it in percent of the baseline's (0 where
    that is not positive). ``rows``: ``(Model, Type, metrics)``."""
    pick = lambda kind: F.min_by(F.struct("Model", *names), F.when(F.col("Type") == kind, F.struct(-F.col("AUC"), F.col("Model"))))
    row = rows.agg(pick("ML Model").alias("m"), pick("Baseline").alias("b"))
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("Metric"), F.col("m.Model").alias("Model"), F.col("b.Model").alias("Baseline"),
                 F.col(f"m.{x}").alias("Model_Value"), F.col(f"b.{x}").alias("Baseline_Value")) for x in names])).alias("r")).select("r.*")
    gain = F.col("Model_Value") - F.col("Baseline_Value")
    return long.withColumn("Improvement", gain).withColumn(
        "Improvement_Pct", F.when(F.col("Baseline_Value") > 0, F.lit(100.0) * gain / F.col("Baseline_Value")).otherwise(F.lit(0.0)))


IMPROVEMENT = [("Metric", "s"), ("Model", "s"), ("Baseline", "s"), ("Model_Value", 6), ("Baseline_Value", 6), ("Improvement", 6),
               ("Improvement_Pct", 4)]
_ALL_BASE = " UNION ALL ".join(f"SELECT model, accuracy, precision, recall, f1, auc FROM ({x})" for x in (
    _R["baseline_random"].sql, _R["baseline_majority"].sql, _R["baseline_stratified"].sql, _R["eval_metrics"].sql))


@query("eval_improvement_spread", IMPROVEMENT, " UNION ALL ".join(
    f"""SELECT '{m}' AS Metric, a.model AS Model, b.model AS Baseline, a.{c} AS Model_Value, b.{c} AS Baseline_Value,
    a.{c} - b.{c} AS Improvement, CASE WHEN b.{c} > 0 THEN 100.0 * (a.{c} - b.{c}) / b.{c} ELSE 0 END AS Improvement_Pct
    FROM (SELECT * FROM bench WHERE model = 'CDS-Only') a, (SELECT * FROM bench WHERE model <> 'CDS-Only' ORDER BY auc DESC, model LIMIT 1) b"""
    for m, c in (("AUC", "auc"), ("F1", "f1"), ("Precision", "precision"), ("Recall", "recall"), ("Accuracy", "accuracy"))),
       extra_ctes=DRAW_CTES + f",\nbench AS ({_ALL_BASE})")
def eval_improvement_spread(st: Stages) -> DataFrame:
    """A44 on closed-form scores: the spread score against the three naive baselines."""
    rows = _baselines(st)
    return improvement(rows.withColumn("Type", F.when(F.col("Model") == "CDS-Only", "ML Model").otherwise(F.col("Type"))))


@query("eval_improvement", IMPROVEMENT)
def eval_improvement(st: Stages) -> DataFrame:
    """The best fitted model against the best baseline, by metric."""
    return improvement(eval_benchmark(st))


@query("eval_compare", [("Model", "s"), ("rank", "k"), ("Accuracy", 6), ("Precision", 6), ("Recall", 6), ("F1", 6), ("AUC", 6)])
def eval_compare(st: Stages) -> DataFrame:
    """The fitted models ranked by AUC (name breaks ties); one row a model."""
    from .q_ml import model_rows
    return ranked_models(model_rows(st))


@query("eval_benchmark", [("Model", "s"), ("Type", "s"), ("Accuracy", 6), ("Precision", 6), ("Recall", 6),
                          ("F1", 6), ("AUC", 6)])
def eval_benchmark(st: Stages) -> DataFrame:
    """The baselines and the four fitted models in one table, sorted by AUC; models are
    scored at their default cut-off, as the reference does."""
    from .q_ml import model_rows
    return _baselines(st).unionByName(model_rows(st)).orderBy(F.desc("AUC"), "Model")


def ranked_models(rows: DataFrame) -> DataFrame:
    """O2: models ranked by AUC, names breaking ties."""
    w = Window.orderBy(F.desc("AUC"), "Model")          # as many rows as there are models
    return rows.withColumn("rank", F.row_number().over(w)).drop("Type")


@query("eval_compare_baselines", _R["eval_compare"].spec, """SELECT model AS Model, row_number() OVER (ORDER BY auc DESC, model) AS rank, accuracy AS Accuracy,
    precision AS Precision, recall AS Recall, f1 AS F1, auc AS AUC FROM (SELECT * REPLACE (round(auc, 9) AS auc) FROM bench)""", extra_ctes=DRAW_CTES + f",\nbench AS ({_ALL_BASE})")
def eval_compare_baselines(st: Stages) -> DataFrame:
    """A42 / O2 on closed-form scores."""
    return ranked_models(_baselines(st).withColumn("AUC", F.round("AUC", 9)))
