"""Cutting lineage in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in a one-process session without it, a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tieweave-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """A folder below the shared one for tables between jobs; it goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tieweave-{spark.sparkContext.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; executors may be lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the application's folder, read again.

    For tables that many queries are built on: a checkpoint hands the optimizer all that it has concluded
    about ``df``, and after some steps working that out takes longer than the data does.
    """
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` as a table in the application's folder that lies in buckets by ``columns``, sorted.

    For tables that rounds of frontiers are joined to by all of ``columns``: only the frontier is shuffled.
    """
    spark = df.sparkSession
    name = f"tieweave_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *columns)  # one file for each bucket
    dealt.write.option("path", f"{scratch_dir(spark)}/{name}").bucketBy(n, *columns).sortBy(*columns).saveAsTable(name)
    return spark.table(name)
