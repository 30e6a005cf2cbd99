"""Scans: every source gives a lazy DataFrame, with projection, predicate and limit left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.predicates import dnf


def _shape(df: DataFrame, columns=None, filters=None, where: str | None = None, order_by=None, offset: int | None = None, limit: int | None = None) -> DataFrame:
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    if filters:
        df = df.where(dnf(filters))
    if where:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    if order_by:
        df = df.orderBy(*order_by)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def scan_parquet(spark: SparkSession, path: str, **shape) -> DataFrame:
    """A file, or a folder whose ``k=v`` parts become partition columns."""
    return _shape(spark.read.parquet(path), **shape)


def scan_csv(spark: SparkSession, path: str, *, header: bool = True, delimiter: str = ",", schema=None, **shape) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", delimiter)
    return _shape((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path), **shape)


def scan_json(spark: SparkSession, path: str, *, multi_line: bool = False, schema=None, **shape) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return _shape((reader.schema(schema) if schema else reader).json(path), **shape)


def scan_xml(spark: SparkSession, path: str, row_tag: str, *, schema=None, **shape) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return _shape((reader.schema(schema) if schema else reader).load(path), **shape)


def scan_text(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    return spark.read.option("wholetext", whole).text(path)


def scan_table(spark: SparkSession, name: str, **shape) -> DataFrame:
    """A catalog table, by up to three name parts."""
    return _shape(spark.table(name), **shape)


def scan_jdbc(spark: SparkSession, url: str, *, table: str | None = None, query: str | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, properties: dict | None = None, **shape) -> DataFrame:
    """A table (read in ranges of ``partition_column`` if given) or a query over JDBC."""
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return _shape(reader.load(), **shape)


def run_sql(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None, args: dict | None = None) -> DataFrame:
    """Ad-hoc SQL over frames given as views, with named parameters."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args or {})


#: Leading bytes of common formats.
MAGIC = {"pdf": "25504446", "png": "89504E47", "gif": "47494638", "jpeg": "FFD8FF", "zip": "504B0304", "gzip": "1F8B", "parquet": "50415231"}


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as bytes with extension and the format that their first bytes name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.coalesce(*(F.when(head.startswith(m), F.lit(k)) for k, m in MAGIC.items()), F.lit("unknown"))
    return files.withColumns({"extension": F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), "kind": kind})


def scan_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o`` of an N-Triples file; comments and lines that are no statement are dropped."""
    line = F.col("value")
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(.+?)\s*\.\s*$"
    rows = spark.read.text(path).where(line.rlike(pattern))
    return rows.select(*(F.regexp_extract(line, pattern, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))))


def parse_feed(df: DataFrame, column: str) -> DataFrame:
    """Items (title, link, published, author) of RSS feeds held as XML text in ``column``."""
    part = lambda tag: F.xpath(F.col(column), F.lit(f"//item/{tag}/text()"))
    titles, links, dates, authors = (part(t) for t in ("title", "link", "pubDate", "author"))
    item = F.posexplode(F.arrays_zip(titles.alias("title"), links.alias("link"), dates.alias("published"), authors.alias("author")))
    return df.select("*", item.alias("item", "i")).select("*", "i.title", "i.link", "i.published", "i.author").drop("i")


def footer(path: str) -> dict:
    """Schema and row-group facts from a Parquet footer, read on the driver."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    return {"rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": [meta.schema.column(i).name for i in range(meta.num_columns)], "compression": meta.row_group(0).column(0).compression if meta.num_row_groups else None}


def integrate_seed(seed: DataFrame, extracted: DataFrame, key: str, strategy: str = "seed_first") -> DataFrame:
    """Seed and extracted entities joined in full: ``seed_first``/``merge`` fill seed's gaps, ``extracted_first`` the other way."""
    if strategy not in ("seed_first", "extracted_first", "merge"):
        raise ValueError(strategy)
    first, second = (extracted, seed) if strategy == "extracted_first" else (seed, extracted)
    names = [c for c in dict.fromkeys([*first.columns, *second.columns]) if c != key]
    a = first.select(F.col(key).alias("__a"), *(F.col(c).alias(f"a_{c}") for c in first.columns if c != key))
    b = second.select(F.col(key).alias("__b"), *(F.col(c).alias(f"b_{c}") for c in second.columns if c != key))
    pick = lambda c: F.coalesce(*(F.col(f"{s}_{c}") for s, df in (("a", first), ("b", second)) if c in df.columns)).alias(c)
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), *map(pick, names))
