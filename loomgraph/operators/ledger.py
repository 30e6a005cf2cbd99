"""Provenance entries, alignments and links between graphs, concept schemes, and stores of versioned records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.graph_algorithms import connected_components
from loomgraph.operators.records import SparqlSubset, checksum


# provenance
def track(items: DataFrame, kind: str, id_col: str, source: str, at: str, parent: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Entries ``entity_id, kind, source, recorded_at, parent_id, checksum, valid`` of a batch of entities, relations, chunks or properties."""
    return items.select(
        F.col(id_col).cast("string").alias("entity_id"), F.lit(kind).alias("kind"), F.col(source).cast("string").alias("source"), F.col(at).cast("timestamp").alias("recorded_at"),
        (F.col(parent).cast("string") if parent else F.lit(None).cast("string")).alias("parent_id"), checksum(fields or [id_col]).alias("checksum"), F.lit(True).alias("valid"),
    )


def recorded_between(entries: DataFrame, start: Column, end: Column) -> DataFrame:
    """Entries recorded from ``start`` to ``end``, both included."""
    return entries.where(F.col("recorded_at").between(start, end))


def sources_of(entries: DataFrame) -> DataFrame:
    """``entity_id, sources, first_at, last_at, n`` of each entity."""
    return entries.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("recorded_at").alias("first_at"), F.max("recorded_at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def audit(entries: DataFrame, unit: str = "month") -> DataFrame:
    """``period, kind, source, n, n_entities``."""
    return entries.groupBy(F.date_trunc(unit, "recorded_at").alias("period"), "kind", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_entities"))


def invalidate(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """``entries`` with ``valid`` false for the entities of ``gone`` (entity_id); nothing is deleted."""
    marked = entries.join(gone.select("entity_id").distinct().withColumn("__gone", F.lit(True)), "entity_id", "left")
    return marked.withColumn("valid", F.col("valid") & F.col("__gone").isNull()).drop("__gone")


def prov_triples(entries: DataFrame, base: str = "http://example.org/") -> DataFrame:
    """Entries as PROV statements ``s, p, o``."""
    prov = lambda name: F.lit(f"<http://www.w3.org/ns/prov#{name}>")
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.col(c), F.lit(">"))
    said = F.array(F.struct(prov("hadPrimarySource").alias("p"), iri("source").alias("o")), F.struct(prov("wasDerivedFrom").alias("p"), iri("parent_id").alias("o")))
    return entries.select(iri("entity_id").alias("s"), F.explode(said).alias("x")).select("s", "x.p", "x.o").where("o IS NOT NULL").distinct()


# alignments and several graphs
def alignment_classes(alignments: DataFrame) -> DataFrame:
    """``id, class``: terms that equivalences (``a, b``) tie together, named after the least of them."""
    edges = alignments.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return connected_components(nodes, edges).withColumnRenamed("component", "class")


def expand_terms(terms: DataFrame, alignments: DataFrame) -> DataFrame:
    """``id, term``: each term (``id``) with all that are equivalent to it, itself included."""
    classes = alignment_classes(alignments)
    other = terms.join(classes, "id").join(classes.withColumnRenamed("id", "term"), "class").select("id", "term")
    return terms.select("id", F.col("id").alias("term")).union(other).distinct()


def cross_links(graphs: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """Edges ``graph_src, src, graph_dst, dst, type``: those inside each graph, and ``links`` between graphs whose ends exist there."""
    inner, nodes = None, None
    for name, e in graphs.items():
        g = F.lit(name)
        here = e.select(g.alias("graph_src"), "src", g.alias("graph_dst"), "dst", "type")
        ids = e.select(g.alias("graph"), F.col("src").alias("id")).union(e.select(g, "dst"))
        inner, nodes = (here, ids) if inner is None else (inner.unionByName(here), nodes.union(ids))
    nodes = nodes.distinct()
    good = links
    for side in ("src", "dst"):
        good = good.join(nodes.select(F.col("graph").alias(f"graph_{side}"), F.col("id").alias(side)), [f"graph_{side}", side], "left_semi")
    return inner.unionByName(good.select(inner.columns))


# concept schemes
def concept_levels(broader: DataFrame, most: int = 20) -> DataFrame:
    """``id, ancestor, depth`` over ``broader(id, parent)`` by its least depth; cycles end where they began."""
    from loomgraph.operators.graph_algorithms import bfs_levels

    links = broader.select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    found = bfs_levels(links, broader.select("id").distinct(), most).where("hops > 0")
    return found.select(F.col("origin").alias("id"), F.col("id").alias("ancestor"), F.col("hops").alias("depth"))


def concept_search(labels: DataFrame, text: str, k: int) -> DataFrame:
    """``id, label, score``: concepts whose label holds the text without case: 1 for equal, 0.8 for a beginning, 0.5 elsewhere."""
    x, t = F.lower("label"), text.lower()
    score = F.when(x == t, 1.0).when(x.startswith(t), 0.8).when(x.contains(t), 0.5)
    return labels.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "label", "id").limit(k).select("id", "label", "score")


def quality_gate(entities: DataFrame, required: list[str], least_share: float) -> DataFrame:
    """``field, filled, passes``: share of entities with each required field, and whether that is enough."""
    one = entities.agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in required))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in required))
    return one.select(F.explode(rows).alias("r")).select("r.field", "r.filled", (F.col("r.filled") >= least_share).alias("passes"))


def construct(triples: DataFrame, template: list[tuple[str, str, str]], where: str) -> DataFrame:
    """CONSTRUCT: ``s, p, o`` of the template's triples for every solution of the graph pattern ``where``."""
    names = sorted({t[1:] for row in template for t in row if t.startswith("?")} | set(re.findall(r"\?(\w+)", where)))
    found = SparqlSubset(triples).select(f"SELECT {' '.join('?' + n for n in names)} WHERE {{ {where} }}")
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    rows = F.array(*(F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template))
    return found.select(F.explode(rows).alias("t")).select("t.s", "t.p", "t.o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


# decisions
def causal_loops(edges: DataFrame, most: int = 6) -> DataFrame:
    """``path``: causal cycles of at most ``most`` edges, each once, from its least node on."""
    links = edges.select("src", "dst").distinct()
    at, done = links.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at")), None
    for _ in range(most - 1):
        step = at.join(links, at["at"] == links["src"]).where("dst >= path[0]").select("path", "dst")
        closed = step.where("dst = path[0]").select("path")
        done = closed if done is None else done.union(closed)
        at = step.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
    return done


def chain_at(edges: DataFrame, start, t: Column, most: int = 5) -> DataFrame:
    """``id, depth``: the downstream causal chain over edges recorded at or before ``t``."""
    from loomgraph.operators.records import causal_chain

    return causal_chain(edges.where(F.col("recorded_at") <= t), start, max_depth=most)


# versioned stores
def put(store: DataFrame, rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """``store`` with ``rows`` appended under the next version of their key."""
    last = store.groupBy(key).agg(F.max(version).alias("__last"))
    fresh = rows.join(last, key, "left").withColumn(version, F.coalesce(F.col("__last") + 1, F.lit(1))).drop("__last")
    return store.unionByName(fresh, allowMissingColumns=True)


def latest(store: DataFrame, key: str, version: str = "version", deleted: str | None = None) -> DataFrame:
    """The last version of each key; keys whose last version is marked ``deleted`` are gone."""
    top = store.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))).where("__r = 1").drop("__r")
    return top.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else top


def page(store: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return store.orderBy(key).offset(offset).limit(limit)


def readable(store: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    """Rows whose ``namespace`` a user may read (``grants``: namespace, user, permission)."""
    allowed = grants.where((F.col("user") == F.lit(user)) & F.col("permission").isin("read", "write", "admin")).select("namespace").distinct()
    return store.join(allowed, "namespace", "left_semi")


def blended(vectors: DataFrame, graph_scores: DataFrame, weight: float = 0.5) -> DataFrame:
    """``id, score``: semantic (id, score) and structural (id, score) similarity in one, a missing side as 0."""
    a, b = vectors.select("id", F.col("score").alias("a")), graph_scores.select("id", F.col("score").alias("b"))
    return a.join(b, "id", "full_outer").select("id", ((1 - weight) * F.coalesce("a", F.lit(0.0)) + weight * F.coalesce("b", F.lit(0.0))).alias("score"))


def checkpoint_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``n_added, n_removed, n_changed, n_same`` between two checkpoints of a table, by checksums of their other columns."""
    fields = sorted(c for c in old.columns if c != key)
    a, b = old.select(F.col(key).alias("ka"), checksum(fields).alias("ca")), new.select(F.col(key).alias("kb"), checksum(fields).alias("cb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    return both.agg(F.count_if(F.col("ka").isNull()).alias("n_added"), F.count_if(F.col("kb").isNull()).alias("n_removed"), F.count_if(F.col("ca") != F.col("cb")).alias("n_changed"), F.count_if(F.col("ca") == F.col("cb")).alias("n_same"))
