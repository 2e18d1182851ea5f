"""DataFrame helpers shared by the operators: staged tables, row keys, empty inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir


#: Spark drops the shuffle files of a query when it ends, instead of when the driver next collects garbage
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads the table), gives later joins a known size,
    and frees the disk that the finished part's shuffles took.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A 96-bit key of a row that is never null: a hash of id and text, the same in every scan of the
    table. Rows equal in both share a key and get equal results."""
    i, t = F.col(id_col), F.col(text_col)
    nulls = i.isNull().cast("int") + 2 * t.isNull().cast("int")      # Spark's hashes pass over nulls
    return F.xxhash64(nulls, i, t).alias("k1"), F.hash(nulls, t, i).alias("k2")


def keyed(documents: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``(k1, k2, id, text)``; with ``carry`` also ``rest``, a struct of all columns but the text."""
    columns = [*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if carry:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text_col]).alias("rest"))
    return documents.select(*columns)


def reshuffled(key: str) -> Column:
    """The key as a computed column. A grouped table is already dealt out by its key, and Spark joins it
    as it lies; a computed key makes it deal out both sides for the join alone, and only such a join
    may it split where one key is hot. The table is small next to what it is joined with."""
    return F.bitwise_not(F.bitwise_not(F.col(key))).alias(key)


def field(df: DataFrame, name: str):
    return next(f for f in df.schema.fields if f.name == name)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
