"""A stored list of features that decides what later steps read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_list(spark: SparkSession, names: Sequence[str], path: str) -> None:
    """Write the names, in order, as a CSV file with the one column ``feature``."""
    rows = spark.createDataFrame(list(enumerate(names)), "number int, feature string")
    rows.coalesce(1).sortWithinPartitions("number").select("feature").write.mode("overwrite").option("header", True).csv(path)


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """The stored names, in file order, each once; blank lines do not count. Bounded by the number of columns."""
    rows = spark.read.option("header", True).schema("feature string").csv(path).collect()
    return list(dict.fromkeys(r.feature.strip() for r in rows if r.feature and r.feature.strip()))


def project(table: DataFrame, names: Sequence[str], keep: Sequence[str] = (), absent: str = "fail") -> DataFrame:
    """``keep`` and the listed columns of ``table``, nothing else, so that a scan reads no other column.

    A listed column that the table lacks is an error (``absent="fail"``), is left out (``"skip"``), or is a column
    of nulls (``"null"``).
    """
    lacking = [c for c in names if c not in table.columns]
    if lacking and absent == "fail":
        raise ValueError(f"the table lacks listed features: {', '.join(lacking)}")
    columns = [c for c in names if c not in keep]
    if absent == "skip":
        columns = [c for c in columns if c not in lacking]
    return table.select(*keep, *[F.lit(None).cast("double").alias(c) if c in lacking else F.col(c) for c in columns])
