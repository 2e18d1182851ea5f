"""Step 9: future spread, its change, and the distress label; step 10: temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if
from ..schemas import ABS_THRESHOLD, LABEL, LEAD_QUARTERS, PCT_THRESHOLD
from .prep import firm

DEFAULT_SPLIT_DATE = "2021-01-01"      # fixed value


def label_distress(panel: DataFrame, strict: bool = False) -> DataFrame:
    """``lead(spread, 4)``, absolute and relative change, and the flag.

    Flag = 1 when ``abs >= 50 or pct >= 0.25``, NULL where the lead is missing. A row whose
    current spread is missing but whose lead exists gets 0, as in the reference (T4);
    ``strict=True`` makes it NULL instead.
    """
    lead = F.lead("cds_spread", LEAD_QUARTERS).over(firm())
    d = panel.withColumn("cds_spread_lead_4q", lead)
    d = d.withColumn("future_cds_change_abs", F.col("cds_spread_lead_4q") - F.col("cds_spread"))
    d = d.withColumn("future_cds_change_pct",
                     F.when(F.col("cds_spread") > 0, F.col("future_cds_change_abs") / F.col("cds_spread")))
    fired = F.coalesce((F.col("future_cds_change_abs") >= ABS_THRESHOLD)
                       | (F.col("future_cds_change_pct") >= PCT_THRESHOLD), F.lit(False))
    flag = F.when(F.col("cds_spread_lead_4q").isNull(), F.lit(None))
    if strict:
        flag = flag.when(F.col("cds_spread").isNull(), F.lit(None))
    flag = flag.when(fired, F.lit(1)).otherwise(F.lit(0)).cast("int")
    return d.withColumn("distress_flag", flag)


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col(LABEL).isNotNull())


def by_year(df: DataFrame) -> DataFrame:
    """Events, observations and rate (%) per calendar year of the labelled rows."""
    lab = labelled(df)
    return (lab.groupBy(F.year("date").cast("long").alias("year"))
            .agg(F.sum(LABEL).cast("long").alias("distress_events"),
                 F.count(F.lit(1)).alias("total_obs"),
                 (F.avg(LABEL) * 100).alias("distress_rate")))


def summary(df: DataFrame) -> DataFrame:
    """Label counts and rate, unlabelled rows, and the class-balance tier."""
    rate = F.avg(F.col(LABEL))
    s = df.agg(F.count(F.lit(1)).alias("total_rows"),
               F.count(LABEL).alias("labelled"),
               count_if(F.col(LABEL) == 1).alias("events"),
               count_if(F.col(LABEL) == 0).alias("non_events"),
               count_if(F.col(LABEL).isNull()).alias("unlabelled"),
               rate.alias("rate"),
               F.countDistinct(F.when(F.col(LABEL).isNotNull(), F.col("gvkey"))).alias("firms"))
    return s.withColumn("balance", F.when(F.col("rate") < 0.1, "Severe imbalance")
                        .when(F.col("rate") < 0.3, "Moderate imbalance").otherwise("Good balance"))


def breakdown(df: DataFrame) -> DataFrame:
    a, p = F.col("future_cds_change_abs"), F.col("future_cds_change_pct")
    return df.agg(count_if((a >= ABS_THRESHOLD) & (p < PCT_THRESHOLD)).alias("abs_only"),
                  count_if((a < ABS_THRESHOLD) & (p >= PCT_THRESHOLD)).alias("pct_only"),
                  count_if((a >= ABS_THRESHOLD) & (p >= PCT_THRESHOLD)).alias("abs_and_pct"))


def lost_at_end(df: DataFrame) -> DataFrame:
    return df.agg((F.count("cds_spread") - F.count("cds_spread_lead_4q")).alias("lost"))


def temporal_split(df: DataFrame, split_date: str = DEFAULT_SPLIT_DATE) -> DataFrame:
    """Labelled rows with ``split`` = train (date < split_date) / test."""
    return labelled(df).withColumn(
        "split", F.when(F.col("date") < F.lit(split_date).cast("date"), "train").otherwise("test"))
