"""CSV sources and sinks (S1-S5, S9, S10) in the dialects of the raw files.

Every value is read as text under an explicit schema, never inferred; ``operators.clean`` coerces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FUND_NUMERIC, PRICE_NUMERIC

# Separator, encoding and header of each raw file.
DIALECTS = {
    "fundamentals": {"sep": ";", "encoding": "ISO-8859-1", "header": True},
    "prices": {"sep": ",", "encoding": "UTF-8", "header": True},
    "spreads": {"sep": ",", "encoding": "UTF-8", "header": True},
    "mapping": {"sep": ",", "encoding": "UTF-8", "header": False},
    "firm_master": {"sep": ";", "encoding": "UTF-8", "header": True},
    "report": {"sep": ",", "encoding": "UTF-8", "header": True},
}
COLUMNS = {
    "fundamentals": ["gvkey", "datadate", *FUND_NUMERIC],
    "prices": ["gvkey", "datadate", *PRICE_NUMERIC],
    "mapping": ["gvkey", "iqt", "company_name", "extra"],
    "firm_master": ["gvkey", "tic", "cusip", "sic"],
}
BOM = "﻿"


def read_csv(spark: SparkSession, path: str, kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The file as text columns. The wide spread matrix takes its columns from the header line, the
    headerless mapping loses a byte order mark; ``extra`` names columns that follow the usual ones."""
    reader = spark.read.options(**{k: str(v) for k, v in DIALECTS[kind].items()}, mode="PERMISSIVE")
    if kind in ("spreads", "report"):
        return reader.csv(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*COLUMNS[kind], *extra)])
    # every column is in the schema: read by position, unused ones are pruned
    df = reader.option("enforceSchema", "true").schema(schema).csv(path)
    first = COLUMNS[kind][0]
    return df.withColumn(first, F.regexp_replace(first, "^" + BOM, "")) if kind == "mapping" else df


def in_file_order(df: DataFrame, name: str = "ingest_id") -> DataFrame:
    """Adds a key that grows with a row's place: file, then block, then row of the block."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.withColumn(name, place)


def write_csv(df: DataFrame, path: str, kind: str) -> None:
    df.write.options(**{k: str(v) for k, v in DIALECTS[kind].items()}).csv(path)
