"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, one in the warehouse, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.startswith(("local[", "local-")) or spark.sparkContext.master == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomgraph-checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class Stored:
    """A table written once and read back: its lineage starts at durable files, so lost executors cost nothing."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        delete_path(self.frame.sparkSession, self.path)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomgraph-{label}-{uuid.uuid4().hex}"


def store(frame: DataFrame, label: str) -> Stored:
    """Write ``frame`` to the shared folder and return the reread table; what isn't dropped before goes when the application ends."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return Stored(spark.read.schema(frame.schema).parquet(path), path)
