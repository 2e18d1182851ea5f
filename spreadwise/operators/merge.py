"""Step 4: quarterise prices and spreads, map instruments to firms, build the firm-quarter panel.

Shuffle plan: the quarterly price and spread aggregates are hash-partitioned on
``(gvkey, year, quarter)``, which both equi-joins reuse. The mapping lookups are plain joins:
AQE turns them into broadcast joins when the runtime size of the deduplicated mapping is
under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and keeps a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import to_long
from ..schemas import MERGED_COLS, PRICE_RENAME

QKEY = ["gvkey", "year", "quarter"]


def with_quarter(df: DataFrame, date_col: str) -> DataFrame:
    return df.withColumns({"year": F.year(date_col), "quarter": F.quarter(date_col)})


def quarter_last(prices: DataFrame, cols=("prccm", "trt1m", "cshom")) -> DataFrame:
    """``groupby(gvkey, year, quarter).last()``: per column, the value at the latest date
    where that column is not missing. Rows with a missing key are dropped (T2)."""
    p = with_quarter(prices.withColumn("gvkey", to_long("gvkey", prices.schema["gvkey"].dataType)),
                     "datadate")
    p = p.filter(F.col("gvkey").isNotNull() & F.col("year").isNotNull())
    return p.groupBy(*QKEY).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("datadate"))).alias(c)
        for c in cols])


def mapping_iqt(mapping: DataFrame) -> DataFrame:
    """``iqt -> gvkey``, last duplicate (largest ``ingest_id``) wins; missing iqt never matches."""
    m = mapping.filter(F.col("iqt").isNotNull())
    return (m.groupBy(F.col("iqt").cast("string").alias("iqt"))
            .agg(F.max_by(to_long("gvkey", m.schema["gvkey"].dataType), F.col("ingest_id")).alias("gvkey")))


def mapping_names(mapping: DataFrame) -> DataFrame:
    """``gvkey -> company_name``, last duplicate wins."""
    m = mapping.withColumn("gvkey", to_long("gvkey", mapping.schema["gvkey"].dataType))
    return (m.filter(F.col("gvkey").isNotNull()).groupBy("gvkey")
            .agg(F.max_by(F.col("company_name"), F.col("ingest_id")).alias("company_name")))


def mapped_spreads(spreads: DataFrame, mapping: DataFrame, how: str = "inner") -> DataFrame:
    """Spread rows with their firm key; ``inner`` drops unmapped rows."""
    m = mapping_iqt(mapping)
    s = spreads.withColumn("iqt", F.col("iqt").cast("string")).join(m, "iqt", how)
    return s.filter(F.col("gvkey").isNotNull()) if how == "inner" else s


def quarter_mean_spread(spreads: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mean spread per firm-quarter of the mapped rows (rows without a date drop, T2)."""
    s = with_quarter(mapped_spreads(spreads, mapping), "date").filter(F.col("year").isNotNull())
    return s.groupBy(*QKEY).agg(F.avg("cds_spread").alias("cds_spread"))


def fundamentals_quarters(fund_clean: DataFrame) -> DataFrame:
    f = fund_clean.withColumn("gvkey", to_long("gvkey", fund_clean.schema["gvkey"].dataType))
    return with_quarter(f, "datadate")


def merge_prices(fund_clean: DataFrame, prices_clean: DataFrame) -> DataFrame:
    """Inner join fundamentals x quarter-end prices on (gvkey, year, quarter)."""
    q = quarter_last(prices_clean).withColumnsRenamed(PRICE_RENAME)
    return fundamentals_quarters(fund_clean).join(q, QKEY, "inner")


def merge_panel(fund_clean: DataFrame, prices_clean: DataFrame, spreads: DataFrame,
                mapping: DataFrame) -> DataFrame:
    """The 21-column firm-quarter panel."""
    panel = merge_prices(fund_clean, prices_clean)
    panel = panel.join(mapping_names(mapping), "gvkey", "left")
    panel = panel.join(quarter_mean_spread(spreads, mapping), QKEY, "left")
    panel = panel.withColumn("date", F.col("datadate"))
    return panel.select(*[c for c in MERGED_COLS if c in panel.columns])
