"""Cutting lineage with a table in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="shelfcast-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's stored copies, inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/shelfcast/{spark.sparkContext.applicationId}"


def drop_copies(spark: SparkSession) -> None:
    """Delete this application's stored copies. No DataFrame that was built on them can be read afterwards."""
    drop_copy(spark, run_folder(spark))


def drop_copy(spark: SparkSession, path: str) -> None:
    """Delete one stored copy."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def durable(df: DataFrame) -> DataFrame:
    """Write the rows once and read them back.

    The copy survives executor loss, keeps column pruning, and gives the planner the true size,
    so a join against it is broadcast only below spark.sql.autoBroadcastJoinThreshold and is a
    sort-merge join beyond it.
    """
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """A durable copy and its path, for callers that replace it."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
