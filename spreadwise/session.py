"""Session helpers: a local session for tests / bench, and the shared scratch folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this package relies on. ANSI stays on (Spark 4 default);
# the code uses try_cast / try_divide / nullif wherever a value may be bad.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "spreadwise") -> SparkSession:
    """Local session for tests and the bench (the cluster session comes from the caller)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPREADWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the one setting that results depend on, the time zone, on a session we did not build. It
    stays UTC for the caller afterwards: queries are lazy and run later."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: later queries read
    only the columns they need, and a lost executor re-reads the table."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, folder: str, name: str, by: str, sort: Sequence[str]) -> DataFrame:
    """Write ``df`` into ``folder`` as a table bucketed by ``by``, one sorted file a bucket, and read it back.

    Later windows and joins on ``by`` find the rows as they lie and shuffle nothing. The number of buckets is
    that of shuffle partitions. The table's entry lives in the session's catalog, its files in ``folder``.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"stage_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *[c for c in sort if c != by])
     .option("path", f"{folder}/{name}-{uuid.uuid4().hex}").saveAsTable(table))
    return spark.table(table)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the names, sizes and change times of the files under ``paths``, from the file system's listing."""
    hadoop, found = spark._jvm.org.apache.hadoop.fs, []
    for path in paths:
        p = hadoop.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of stage tables that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only when the session leaves it unset (local tests) do we create one.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
            path = tempfile.mkdtemp(prefix="spreadwise-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path
