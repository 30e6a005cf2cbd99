"""Sinks: canonical tables, text serialisations and graph formats, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODECS = ("snappy", "gzip", "brotli", "zstd", "lz4", "none")


def metadata_struct(m: Column) -> Column:
    return F.struct(F.map_keys(m).alias("keys"), F.map_values(m).alias("values"))


def write_parquet(df: DataFrame, path: str, *, codec: str = "snappy", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Flat CSV with a header; maps, arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("map", "array", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def iri(base: str, name: Column) -> Column:
    """Base plus the name with what isn't a letter, digit, - or _ made into _."""
    return F.concat(F.lit(f"<{base}"), F.regexp_replace(name.cast("string"), "[^A-Za-z0-9_-]", "_"), F.lit(">"))


def literal(value: Column) -> Column:
    escaped = value.cast("string")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


# The public RDF vocabulary terms used below.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"
XSD_DOUBLE = "<http://www.w3.org/2001/XMLSchema#double>"


def graph_triples(nodes: DataFrame, edges: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """``s, p, o``: a node's type and label, an edge as a statement."""
    typed = nodes.select(iri(base, F.col("id")).alias("s"), F.lit(RDF_TYPE).alias("p"), iri(base, F.col("type")).alias("o")).where("o IS NOT NULL")
    named = nodes.select(iri(base, F.col("id")).alias("s"), F.lit(RDFS_LABEL).alias("p"), literal(F.coalesce("name", "id")).alias("o"))
    linked = edges.select(iri(base, F.col("src")).alias("s"), iri(base, F.col("type")).alias("p"), iri(base, F.col("dst")).alias("o"))
    return typed.unionByName(named).unionByName(linked).distinct()


def ntriples(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """One block a subject, predicates and objects in order."""
    pairs = triples.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("po"))
    body = F.array_join(F.transform("po", lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ")
    return pairs.select(F.concat("s", F.lit("\n    "), body, F.lit(" .")).alias("value"))


def rdfxml(edges: DataFrame, base: str) -> DataFrame:
    """Lines of an RDF/XML document of edges (``part`` orders them; header and footer are parts -1 and 1)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:n="{base}">'
    ends = edges.sparkSession.range(1).select(F.inline(F.array(F.struct(F.lit(-1).alias("part"), F.lit(head).alias("value")), F.struct(F.lit(1).alias("part"), F.lit("</rdf:RDF>").alias("value")))))
    name = F.regexp_replace("type", "[^A-Za-z0-9_]", "_")
    said = F.format_string('<rdf:Description rdf:about="%s%s"><n:%s rdf:resource="%s%s"/></rdf:Description>', F.lit(base), esc("src"), name, F.lit(base), esc("dst"))
    return ends.unionByName(edges.select(F.lit(0).alias("part"), said.alias("value")))


def jsonld(nodes: DataFrame, base: str = "http://example.org/") -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.concat(F.lit(base), F.col("id")).alias("@id"), F.col("type").alias("@type"), F.coalesce("name", "id").alias("label"))).alias("value"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """MERGE statements, nodes before edges (``part`` orders them)."""
    safe = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    name = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "_")
    made = nodes.select(F.lit(0).alias("part"), F.format_string("MERGE (n:%s {id: '%s'}) SET n.name = '%s';", name("type"), safe("id"), F.coalesce(safe("name"), safe("id"))).alias("value"))
    tied = edges.select(F.lit(1).alias("part"), F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) MERGE (a)-[:%s]->(b);", safe("src"), safe("dst"), F.upper(name("type"))).alias("value"))
    return made.unionByName(tied)


def aql(rows: DataFrame, collection: str) -> DataFrame:
    return rows.select(F.concat(F.lit("INSERT "), F.to_json(F.struct("*")), F.lit(f" INTO {collection}")).alias("value"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Body lines of a GraphML document (``part`` orders them; header and footer are parts -1 and 2)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    ends = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).alias("part"), F.lit('<graphml><graph edgedefault="directed">').alias("value")), F.struct(F.lit(2).alias("part"), F.lit("</graph></graphml>").alias("value")))).alias("x")).select("x.*")
    n = nodes.select(F.lit(0).alias("part"), F.format_string('<node id="%s"/>', esc("id")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.format_string('<edge source="%s" target="%s"/>', esc("src"), esc("dst")).alias("value"))
    return ends.unionByName(n).unionByName(e)


def dot(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string('"%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("type")).alias("value"))


def bulk_csv_frames(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bulk-import frames with typed headers, and the edges whose ends are no node."""
    ids = nodes.select("id")
    n = nodes.select(F.col("id").alias("id:ID"), F.col("name"), F.col("type").alias(":LABEL"))
    e = edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE"))
    dangling = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()
    return n, e, dangling


def valid_triples(triples: DataFrame) -> DataFrame:
    return triples.where("s <> '' AND p <> '' AND o <> ''")


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of equal key."""
    return current.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
