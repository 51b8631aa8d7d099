"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests); an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what stands before it. by: a column of
    few values whose rows are read apart."""
    spark = df.sparkSession
    path = place(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.kept = path
    return made


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of place()."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of keep() that nothing reads any more."""
    for made in tables:
        discard(made.sparkSession, made.kept)
