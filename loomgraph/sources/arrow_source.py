"""Python data sources: Arrow IPC files and paged callables (REST, OData, SOQL, cursors)."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ArrowIpcSource(DataSource):
    """``spark.read.format("arrow_ipc").load(path)``: one partition a file, record batches as they lie."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _files(self) -> list[str]:
        path = self.options["path"]
        return sorted(glob.glob(os.path.join(path, "*.arrow"))) if os.path.isdir(path) else [path]

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        with pa.OSFile(self._files()[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema) -> DataSourceReader:
        return _ArrowIpcReader(self._files())


class _ArrowIpcReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with pa.memory_map(partition.value) as f:
            source = pa.ipc.open_file(f)
            for i in range(source.num_record_batches):
                yield source.get_batch(i)


def scan_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(ArrowIpcSource)
    df = spark.read.format("arrow_ipc").load(path)
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def write_arrow(df: DataFrame, path: str) -> None:
    """One IPC file from the driver: for results that fit there."""
    table = df.toArrow()
    with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as sink:
        sink.write_table(table)


def scan_pages(spark: SparkSession, fetch: Callable[[int], list[tuple]], pages: int, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of a paged endpoint: ``fetch(page)`` runs on the executors, pages are dealt out evenly."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def run(batches):
        for b in batches:
            for page in b.column(0).to_pylist():
                rows = fetch(page)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return spark.range(0, pages, 1, partitions or min(pages, 200) or 1).mapInArrow(run, schema)
