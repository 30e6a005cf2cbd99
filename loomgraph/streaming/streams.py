"""Structured Streaming: decoding with a dead letter, windows, sessions, deduplication, state and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream; a single file is read as the one of its name in its folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """``key, content, topic, partition, offset, timestamp`` of a topic."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string").alias("content"), "topic", "partition", "offset", "timestamp")


def decode(messages: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """JSON decoded to ``data``; ``ok`` is false for messages that don't parse (for the dead letter)."""
    parsed = messages.withColumn("data", F.from_json(column, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.withColumn("ok", F.col("data").isNotNull() & F.col("data._corrupt").isNull())


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys) if events.isStreaming else events.groupBy(F.window(time, width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.window(time, width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    base = events.withWatermark(time, late) if events.isStreaming else events
    return base.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def running_totals(events: DataFrame, key: str, key_type: str = "bigint") -> DataFrame:
    """Custom state: count and largest value of each key so far, updated with every micro-batch."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, top = n + len(f), max(top, float(f["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({key: [k[0]], "n": [n], "top": [top]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {key_type}, n bigint, top double", "n bigint, top double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there now, to Parquet or to ``each(batch, id)``, with its checkpoint in ``folder``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", f"{folder}/data").start()
    query.awaitTermination()


def drain_latest(stream: DataFrame, folder: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream in update mode and return the last row of each key: batches are appended with their number, then reduced."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    drain(stream, folder, mode, keep)
    spark = stream.sparkSession
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data/batch=*").drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "__batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("x")).select(*keys, "x.*")
