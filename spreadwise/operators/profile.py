"""Steps 1, 2 and the printed checks of later steps as report tables.

One aggregation per table and report (never one job per column): the per-column statistics
are computed side by side in a single ``agg`` and turned into rows with ``explode`` of a
struct array (an unpivot of a one-row result).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, rnd, tier
from ..functions.stats import quantile_row


def rows_of(row: DataFrame, items: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Unpivot a one-row frame whose columns are ``{item}__{field}`` into one row per item."""
    structs = [F.struct(F.lit(i).alias("variable"),
                        *[F.col(f"{i}__{f}").alias(out) for f, out in fields.items()]) for i in items]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def pct_text(x: Column, digits: int) -> Column:
    """``f"{x:.{d}f}"`` of a value first rounded with the shared rule (no tie ambiguity)."""
    return F.format_string(f"%.{digits}f", rnd(x, digits))


def summary_table(df: DataFrame, dataset: str, cols: Sequence[str], digits: int) -> DataFrame:
    """A2: count, missing % (text), mean and median (text) per variable."""
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[x for c in cols for x in (F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"))])
    med = quantile_row(df, cols, [0.5], names=["med"])
    j = row.crossJoin(med).withColumns({f"{c}__median": F.col(f"{c}_med") for c in cols}) \
        .withColumns({f"{c}__miss": F.lit(100.0) * (F.col("_n") - F.col(f"{c}__count")) / F.col("_n") for c in cols})
    long = rows_of(j, cols, {"count": "Count", "miss": "miss", "mean": "mean", "median": "median"})
    return long.select(F.lit(dataset).alias("Dataset"), F.upper("variable").alias("Variable"), "Count",
                       F.concat(pct_text(F.col("miss"), 1), F.lit("%")).alias("Missing_Pct"),
                       pct_text(F.col("mean"), digits).alias("Mean"),
                       pct_text(F.col("median"), digits).alias("Median"))


def spread_cells(wide: DataFrame) -> DataFrame:
    """All value cells of the wide matrix as doubles (bad text -> NULL), before any filter."""
    from ..operators.clean import parse_spread_cells, unpivot_spreads
    return parse_spread_cells(unpivot_spreads(wide))


def spread_profile(cells: DataFrame) -> DataFrame:
    """A3: statistics over the positive cells; missing % counts zeros only."""
    v = F.col("cds_spread")
    pos = cells.filter(v > 0)
    a = cells.agg(F.count(F.lit(1)).alias("cells"), count_if(v == 0).alias("zeros"))
    b = pos.agg(F.count(F.lit(1)).alias("positive"), F.avg(v).alias("mean"))
    med = quantile_row(pos, ["cds_spread"], [0.5], names=["med"]).withColumnRenamed("cds_spread_med", "median")
    return a.crossJoin(b).crossJoin(med).withColumn(
        "zero_pct", F.lit(100.0) * F.col("zeros") / F.col("cells"))


def quality_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: total, missing, missing % (2 dp), negative, zero, valid, tier — one aggregation."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs += [count_if(F.col(c).isNull()).alias(f"{c}__miss"), count_if(F.col(c) < 0).alias(f"{c}__neg"),
                 count_if(F.col(c) == 0).alias(f"{c}__zero")]
    row = df.agg(*aggs).withColumns({f"{c}__n": F.col("_n") for c in cols})
    long = rows_of(row, cols, {"n": "Total", "miss": "Missing", "neg": "Negative", "zero": "Zero"})
    rate = F.col("Missing") / F.col("Total")
    return long.select(F.upper("variable").alias("Variable"), "Total", "Missing",
                       (F.lit(100.0) * rate).alias("Missing_Pct"), "Negative", "Zero",
                       (F.col("Total") - F.col("Missing") - F.col("Negative")).alias("Valid"),
                       tier(rate, [(0.1, "Good"), (0.2, "Fair")], "Poor").alias("Quality"))


def quality_with_outliers(df: DataFrame, cols: Sequence[str], outlier_cols: Sequence[str]) -> DataFrame:
    """A5: missing and 3-sigma outliers (sample std; 0 for columns not checked)."""
    mom = df.agg(*[x for c in outlier_cols for x in (F.avg(c).alias(f"{c}__mu"), F.stddev_samp(c).alias(f"{c}__sd"))])
    j = df.crossJoin(F.broadcast(mom))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(count_if(F.col(c).isNull()).alias(f"{c}__miss"))
        if c in outlier_cols:
            lo = F.col(f"{c}__mu") - 3 * F.col(f"{c}__sd")
            hi = F.col(f"{c}__mu") + 3 * F.col(f"{c}__sd")
            aggs.append(count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"{c}__out"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"{c}__out"))
    row = j.agg(*aggs).withColumns({f"{c}__n": F.col("_n") for c in cols})
    long = rows_of(row, cols, {"n": "Total", "miss": "Missing", "out": "Outliers"})
    rate = F.col("Missing") / F.col("Total")
    return long.select(F.upper("variable").alias("Variable"), "Total", "Missing",
                       (F.lit(100.0) * rate).alias("Missing_Pct"), "Outliers",
                       (F.col("Total") - F.col("Missing")).alias("Valid"),
                       tier(rate, [(0.05, "Good")], "Fair").alias("Quality"))


def spread_quality(cells: DataFrame) -> DataFrame:
    """A7, A9, A10 as (Metric, Value) rows, computed on the cells before the > 0 filter."""
    v = F.col("cds_spread")
    pos = cells.filter(v > 0)
    a = cells.agg(F.count(F.lit(1)).alias("total"), count_if(v > 0).alias("valid"),
                  count_if((v == 0) | v.isNull()).alias("missing_zero"),
                  count_if(v > 5000).alias("high"), count_if((v > 0) & (v < 10)).alias("low"))
    q = quantile_row(pos, ["cds_spread"], [0.5, 0.95], names=["p50", "p95"])
    j = a.crossJoin(q)
    metrics = [("Total_Points", F.col("total").cast("double")),
               ("Valid_Pct", F.lit(100.0) * F.col("valid") / F.col("total")),
               ("Missing_Pct", F.lit(100.0) * F.col("missing_zero") / F.col("total")),
               ("Extreme_Values_Pct", F.lit(100.0) * (F.col("high") + F.col("low")) / F.col("valid")),
               ("Extreme_High", F.col("high").cast("double")), ("Extreme_Low", F.col("low").cast("double")),
               ("Median", F.col("cds_spread_p50")), ("P95", F.col("cds_spread_p95"))]
    return j.select(F.explode(F.array(*[F.struct(F.lit(m).alias("Metric"), e.alias("Value"))
                                        for m, e in metrics])).alias("r")).select("r.*")


def spread_coverage(cells: DataFrame) -> DataFrame:
    """Positive cells per instrument as % of the matrix width; mean, > 90 %, < 50 %."""
    per = cells.groupBy("iqt").agg(count_if(F.col("cds_spread") > 0).alias("pos"),
                                   F.count(F.lit(1)).alias("width"))
    cov = F.col("pos") / F.col("width")
    return per.agg(F.count(F.lit(1)).alias("instruments"),
                   (F.lit(100.0) * F.avg(cov)).alias("mean_coverage_pct"),
                   count_if(cov > 0.9).alias("over_90"), count_if(cov < 0.5).alias("under_50"))


def missing_by_year(df: DataFrame, date_col: str, cols: Sequence[str], dataset: str) -> DataFrame:
    """Missing rate (%) per calendar year and variable."""
    g = df.groupBy(F.year(date_col).cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(f"{c}__m") for c in cols])
    return g.select("year", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), (F.lit(100.0) * F.col(f"{c}__m") / F.col("_n")).alias("missing_pct"))
        for c in cols])).alias("r")).select(F.lit(dataset).alias("dataset"), "year", "r.*")


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count and % per variable."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"{c}__nn") for c in cols])
    row = row.withColumns({f"{c}__pct": F.lit(100.0) * F.col(f"{c}__nn") / F.col("_n") for c in cols})
    return rows_of(row, cols, {"nn": "non_null", "pct": "coverage_pct"})


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs ``i < j`` of columns in order, pairwise deletion.

    ``covar_pop / (stddev_pop(x | y present) * stddev_pop(y | x present))`` equals the
    pairwise-complete Pearson r, gives NULL for a constant column and never divides by zero (T12).
    A row becomes one small row per pair, which the partial aggregate folds at once: one scan and
    one aggregate of fixed size for any number of columns, and only pairs are shuffled.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    left, right = (F.array(*[F.lit(p[s]) for p in pairs]) for s in (0, 1))
    at = lambda values, k: F.get(values, k)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v")).select(
        "v", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"))
    rows = rows.select("pair", at(F.col("v"), at(left, F.col("pair"))).alias("x"), at(F.col("v"), at(right, F.col("pair"))).alias("y"))
    rows = rows.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    stats = rows.groupBy("pair").agg(F.covar_pop("x", "y").alias("cov"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("sd"))
    names = F.array(*[F.lit(c) for c in cols])
    every = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"))     # a pair without common rows is NULL
    return every.join(stats, "pair", "left").select(
        "pair", at(names, at(left, F.col("pair"))).alias("feature1"), at(names, at(right, F.col("pair"))).alias("feature2"),
        (F.col("cov") / F.nullif(F.col("sd"), F.lit(0.0))).alias("corr"))
