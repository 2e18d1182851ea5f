"""Stage tables of the batch pipeline, each a lazy DataFrame over the given parquet tables.

``Stages`` builds the fixture inputs and chains the operators in the reference's step order.
Stage boundaries where two or more branches read the same table (the merged panel, the
preprocessed panel, the labelled dataset) are cut: written as Parquet tables into the shared folder
named by ``spark.checkpoint.dir`` and read back, so later queries scan only the columns they use and
a lost executor re-reads the stage table instead of recomputing from the raw scan. From the merged
to the labelled panel every window is partitioned by ``gvkey``: these tables are bucketed by it, so
only the write of the first one shuffles on it.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import clean, features, merge, prep, target
from ..session import apply_conf, bucketed_table, delete_folder, scratch_dir, stage_table
from ..sources import fixtures as fx


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        apply_conf(spark)
        self.spark, self.sf_dir, self.materialize = spark, sf_dir.rstrip("/"), materialize

    # ---- stage cut -------------------------------------------------------------------
    @cached_property
    def folder(self) -> str:
        """Where the stage tables of this derivation lie."""
        return f"{scratch_dir(self.spark).rstrip('/')}/tables/stages-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return stage_table(df, name) if self.materialize else df

    def cut_by_firm(self, df: DataFrame, name: str, date: str = "date") -> DataFrame:
        """A cut whose table is bucketed by firm, in the order of its dates."""
        return bucketed_table(df, self.folder, name, "gvkey", [date]) if self.materialize else df

    def drop(self) -> None:
        """Delete the stage tables; what was built on them cannot be read any more."""
        if "folder" in self.__dict__:
            delete_folder(self.spark, self.folder)

    # ---- raw inputs (fixture derivation) ---------------------------------------------
    @cached_property
    def firm_months(self) -> DataFrame:
        """Sums of each firm and month: the one read of the line items that all raw inputs share."""
        return self.cut_by_firm(fx.firm_months(self.spark, self.sf_dir), "firm_months", "ms")

    @cached_property
    def raw_fundamentals(self) -> DataFrame:
        return fx.fx_fundamentals(self.firm_months)

    @cached_property
    def raw_prices(self) -> DataFrame:
        return fx.fx_prices(self.firm_months)

    @cached_property
    def raw_spreads_wide(self) -> DataFrame:
        return fx.fx_spreads_wide(self.firm_months, self.sf_dir)

    @cached_property
    def raw_mapping(self) -> DataFrame:
        return fx.fx_mapping(self.spark, self.sf_dir)

    @cached_property
    def raw_firm_master(self) -> DataFrame:
        return fx.fx_firm_master(self.spark, self.sf_dir)

    # ---- step 3 ------------------------------------------------------------------------
    @cached_property
    def fundamentals_clean(self) -> DataFrame:
        return clean.clean_fundamentals(self.raw_fundamentals)

    @cached_property
    def prices_clean(self) -> DataFrame:
        return clean.clean_prices(self.raw_prices)

    @cached_property
    def spreads_long(self) -> DataFrame:
        return clean.spreads_long(self.raw_spreads_wide)

    # ---- step 4 ------------------------------------------------------------------------
    @cached_property
    def merged(self) -> DataFrame:
        m = merge.merge_panel(self.fundamentals_clean, self.prices_clean, self.spreads_long,
                              self.raw_mapping)
        return self.cut_by_firm(m, "merged")

    # ---- step 5 ------------------------------------------------------------------------
    @cached_property
    def ffilled(self) -> DataFrame:
        return prep.forward_fill(self.merged)

    @cached_property
    def winsorized(self) -> DataFrame:
        return prep.winsorize(self.ffilled)

    @cached_property
    def required(self) -> DataFrame:
        return prep.drop_required(self.winsorized)

    @cached_property
    def median_filled(self) -> DataFrame:
        return prep.fill_medians(self.required)

    @cached_property
    def preprocessed(self) -> DataFrame:
        return self.cut_by_firm(prep.add_lags(self.median_filled), "preprocessed")

    # ---- steps 6-7 ---------------------------------------------------------------------
    @cached_property
    def features_accounting(self) -> DataFrame:
        return features.accounting_features(self.preprocessed)

    @cached_property
    def features_complete(self) -> DataFrame:
        return features.market_features(self.features_accounting).select(*S.FEATURES_COMPLETE_COLS)

    # ---- step 8 ------------------------------------------------------------------------
    @cached_property
    def ml_ready(self) -> DataFrame:
        fc = self.features_complete
        return fc.select(*[c for c in S.SELECTED_COLS if c in fc.columns])

    # ---- step 9 ------------------------------------------------------------------------
    @cached_property
    def ml_dataset(self) -> DataFrame:
        return self.cut_by_firm(target.label_distress(self.ml_ready), "ml_dataset")

    @cached_property
    def target_table(self) -> DataFrame:
        return self.ml_dataset.select(*S.TARGET_COLS)

    # ---- step 10 -----------------------------------------------------------------------
    @cached_property
    def split(self) -> DataFrame:
        return target.temporal_split(self.ml_dataset, S.SPLIT_DATE)

    @cached_property
    def feature_cols(self) -> list[str]:
        return ml_feature_columns(self.ml_dataset)


def ml_feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not ids, label or metadata (P15), in table order."""
    from pyspark.sql.types import NumericType
    excl = set(S.ID_COLS) | {S.LABEL} | set(S.METADATA_COLS) | {"split"}
    return [f.name for f in df.schema.fields
            if f.name not in excl and isinstance(f.dataType, NumericType)]


def numeric_columns(df: DataFrame, exclude=S.ID_COLS) -> list[str]:
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields
            if f.name not in set(exclude) and isinstance(f.dataType, NumericType)]


def year_quarter_bigint(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.col("year").cast("long"), "quarter": F.col("quarter").cast("long")})
