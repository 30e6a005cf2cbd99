"""Cutting lineage in iterative operators: tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table written to the shared folder; it goes when the application ends.

    A reliable checkpoint would compute the rows twice, and keep the old plan's constraints, which grow in loops.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomgraph-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    """The folder that all executors share: the session's checkpoint folder, else one in the warehouse, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        local = spark.sparkContext.master.startswith(("local[", "local-")) or spark.sparkContext.master == "local"
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/loomgraph-checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")
