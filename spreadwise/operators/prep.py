"""Step 5: forward fill, winsorise, required-column filter, median fills, lags and changes.

Every window is ``partitionBy(gvkey).orderBy(date)``: one shuffle on ``gvkey`` (none when the
panel arrives hash-partitioned on ``gvkey``), one sort, all window columns on it. A firm holds
one row per quarter, so no window partition grows with the data. The global statistics
(percentiles, overall medians) are one-row aggregates broadcast back; they cut the plan into
the reference's stage order: ffill -> bounds -> clip -> filter -> firm medians -> overall
medians -> lags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, count_if, present, safe_div
from ..functions.stats import quantile_row
from ..schemas import (FFILL_COLS, LAGS, MEDIAN_FILL_COLS, REQUIRED_COLS, WINSOR_COLS)



def firm() -> Window:
    """Rows of one firm in date order (built lazily: window specs need a live session)."""
    return Window.partitionBy("gvkey").orderBy("date")


def firm_to_date() -> Window:
    return firm().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def firm_all() -> Window:
    return Window.partitionBy("gvkey")


def forward_fill(panel: DataFrame, cols: Sequence[str] = FFILL_COLS) -> DataFrame:
    """Last non-missing value so far within the firm."""
    cols = present(panel, cols)
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(firm_to_date()) for c in cols})


def winsor_bounds(panel: DataFrame, cols: Sequence[str] = WINSOR_COLS) -> DataFrame:
    return quantile_row(panel, present(panel, cols), [0.01, 0.99], names=["p1", "p99"])


def winsorize(panel: DataFrame, cols: Sequence[str] = WINSOR_COLS,
              bounds: DataFrame | None = None, fit_on: Column | None = None) -> DataFrame:
    """Clip each column to its p1 / p99 over all rows, or over those that ``fit_on`` selects.
    NULL stays NULL."""
    cols = present(panel, cols)
    b = bounds if bounds is not None else winsor_bounds(panel if fit_on is None else panel.filter(fit_on), cols)
    j = panel.crossJoin(F.broadcast(b))
    return j.withColumns({c: clip(c, F.col(f"{c}_p1"), F.col(f"{c}_p99")) for c in cols}) \
            .select(*panel.columns)


def winsor_report(panel: DataFrame, cols: Sequence[str] = WINSOR_COLS) -> DataFrame:
    """Per column: p1, p99, values below, above (one aggregation + unpivot)."""
    cols = present(panel, cols)
    j = panel.crossJoin(F.broadcast(winsor_bounds(panel, cols)))
    aggs = []
    for c in cols:
        aggs += [F.first(f"{c}_p1").alias(f"{c}__p1"), F.first(f"{c}_p99").alias(f"{c}__p99"),
                 count_if(F.col(c) < F.col(f"{c}_p1")).alias(f"{c}__low"),
                 count_if(F.col(c) > F.col(f"{c}_p99")).alias(f"{c}__high")]
    row = j.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__p1").alias("p1"),
                 F.col(f"{c}__p99").alias("p99"), F.col(f"{c}__low").alias("n_low"),
                 F.col(f"{c}__high").alias("n_high")) for c in cols])).alias("r")).select("r.*")


def drop_required(panel: DataFrame, cols: Sequence[str] = REQUIRED_COLS) -> DataFrame:
    return panel.dropna(subset=present(panel, cols))


def required_report(panel: DataFrame, cols: Sequence[str] = REQUIRED_COLS) -> DataFrame:
    """Rows dropped per column in order (a row counts for the first missing column)."""
    cols = present(panel, cols)
    aggs = []
    for i, c in enumerate(cols):
        cond = F.col(c).isNull()
        for prev in cols[:i]:
            cond = cond & F.col(prev).isNotNull()
        aggs.append(count_if(cond).alias(c))
    row = panel.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(c).alias("variable"),
                 F.col(c).alias("dropped"), F.col("_n").alias("initial_rows"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")


def fill_medians(panel: DataFrame, cols: Sequence[str] = MEDIAN_FILL_COLS, fit_on: Column | None = None) -> DataFrame:
    """Missing -> firm median, then -> overall median of the firm-filled column.

    ``fit_on``: condition of the rows that the overall medians are taken from (T16), all by default.
    """
    cols = present(panel, cols)
    firm = panel.withColumns({c: F.coalesce(F.col(c), F.median(c).over(firm_all())) for c in cols})
    med = quantile_row(firm if fit_on is None else firm.filter(fit_on), cols, [0.5], names=["med"])
    j = firm.crossJoin(F.broadcast(med))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_med")) for c in cols}) \
            .select(*panel.columns)


def add_lags(panel: DataFrame) -> DataFrame:
    """Lagged spread and return (1, 2, 4 rows), growth of assets and sales, spread change."""
    new: dict[str, Column] = {}
    for k in LAGS:
        new[f"cds_spread_lag{k}"] = F.lag("cds_spread", k).over(firm())
    for k in LAGS:
        new[f"return_lag{k}"] = F.lag("return_1m", k).over(firm())
    new["atq_change"] = safe_div("atq", F.lag("atq", 1).over(firm())) - 1
    new["saleq_change"] = safe_div("saleq", F.lag("saleq", 1).over(firm())) - 1
    new["cds_change"] = F.col("cds_spread") - F.lag("cds_spread", 1).over(firm())
    return panel.withColumns(new)


def fill_report(panel: DataFrame, cols: Sequence[str], fill) -> DataFrame:
    """Missing before / after / filled per column of ``fill(panel)``, in one aggregation
    (the before-flags ride along as extra columns; no join)."""
    cols = present(panel, cols)
    flagged = panel.withColumns({f"_b_{c}": F.col(c).isNull() for c in cols})
    done = fill(flagged)
    aggs = []
    for c in cols:
        aggs += [count_if(F.col(f"_b_{c}")).alias(f"{c}__b"), count_if(F.col(c).isNull()).alias(f"{c}__a")]
    row = done.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"{c}__b").alias("missing_before"),
                 F.col(f"{c}__a").alias("missing_after"),
                 (F.col(f"{c}__b") - F.col(f"{c}__a")).alias("filled")) for c in cols])).alias("r")) \
        .select("r.*")
