"""Provenance entries, alignments, concept schemes, decisions, versioned stores, reasoning and serialisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import ledger as L
from loomgraph.operators import reasoning, records, retrieval
from loomgraph.plans.frames import NEAR_SQL, PLACE_SQL, near_graph, place_graph
from loomgraph.queries import query, table
from loomgraph.sources import sinks

_ENTRIES = "entries AS (SELECT 'c' || o_custkey AS entity_id, 'entity' AS kind, o_orderpriority AS source, o_orderdate AS recorded_at, 'o' || o_orderkey AS parent_id FROM orders)"


def _entries(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("at"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("parent"))
    return L.track(o, "entity", "id", "source", "at", "parent")


@query(f"WITH {_ENTRIES} SELECT entity_id, source, recorded_at, parent_id, sha256(entity_id) AS checksum FROM entries WHERE recorded_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'")
def provenance_recorded_between(spark, d):
    found = L.recorded_between(_entries(spark, d), F.lit("1996-01-01").cast("timestamp"), F.lit("1997-06-30").cast("timestamp"))
    return found.select("entity_id", "source", "recorded_at", "parent_id", "checksum")


@query(f"WITH {_ENTRIES} SELECT entity_id, list_sort(list(DISTINCT source)) AS sources, min(recorded_at) AS first_at, max(recorded_at) AS last_at, count(*) AS n FROM entries GROUP BY entity_id")
def provenance_sources(spark, d):
    return L.sources_of(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT date_trunc('month', recorded_at)::TIMESTAMP AS period, kind, source, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM entries GROUP BY ALL")
def provenance_audit(spark, d):
    return L.audit(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT entity_id, count(*) AS n, bool_and(entity_id NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)) AS valid FROM entries GROUP BY entity_id")
def provenance_invalidated(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return L.invalidate(_entries(spark, d), gone).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("valid").alias("valid"))


@query(f"WITH {_ENTRIES} SELECT DISTINCT '<http://example.org/' || entity_id || '>' AS s, p, o FROM (SELECT entity_id, '<http://www.w3.org/ns/prov#hadPrimarySource>' AS p, '<http://example.org/' || source || '>' AS o FROM entries UNION ALL SELECT entity_id, '<http://www.w3.org/ns/prov#wasDerivedFrom>', '<http://example.org/' || parent_id || '>' FROM entries)")
def provenance_prov(spark, d):
    return L.prov_triples(_entries(spark, d))


_ALIGN = "pairs AS (SELECT p_name || '/' || (p_size % 5) AS a, p_name || '/' || (p_size % 7) AS b FROM part)"


def _alignments(spark, d):
    p = table(spark, d, "part")
    name = lambda n: F.concat_ws("/", "p_name", (F.col("p_size") % n).cast("string"))
    return p.select(name(5).alias("a"), name(7).alias("b"))


@query(f"WITH RECURSIVE {_ALIGN}, u AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b), n AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs), r AS (SELECT id, id AS label FROM n UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.id) SELECT id, min(label) AS class FROM r GROUP BY id")
def alignment_classes(spark, d):
    return L.alignment_classes(_alignments(spark, d))


@query(f"WITH RECURSIVE {_ALIGN}, u AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b), t AS (SELECT DISTINCT p_name || '/0' AS id FROM part), r AS (SELECT id, id AS term FROM t UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.term) SELECT id, term FROM r")
def alignment_expansion(spark, d):
    terms = table(spark, d, "part").select(F.concat("p_name", F.lit("/0")).alias("id")).distinct()
    return L.expand_terms(terms, _alignments(spark, d))


@query(f"WITH {PLACE_SQL} SELECT CASE type WHEN 'LIVES_IN' THEN 'people' ELSE 'places' END AS graph_src, src, CASE type WHEN 'LIVES_IN' THEN 'people' ELSE 'places' END AS graph_dst, dst, type FROM edges UNION ALL SELECT 'people', src, 'places', dst, 'SAME_AS' FROM (SELECT DISTINCT dst AS src, dst FROM edges WHERE type = 'LIVES_IN')")
def cross_graph_links(spark, d):
    e = place_graph(spark, d).edges
    people, places = e.where("type = 'LIVES_IN'"), e.where("type = 'PART_OF'")
    same = people.select(F.lit("people").alias("graph_src"), F.col("dst").alias("src"), F.lit("places").alias("graph_dst"), "dst", F.lit("SAME_AS").alias("type")).distinct()
    nowhere = same.limit(1).withColumn("dst", F.lit("nowhere"))
    return L.cross_links({"people": people, "places": places}, same.unionByName(nowhere))


@query(f"WITH {PLACE_SQL} SELECT src AS id, dst AS ancestor, 1 AS depth FROM edges UNION ALL SELECT a.src, b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src")
def concept_levels(spark, d):
    return L.concept_levels(place_graph(spark, d).edges.select(F.col("src").alias("id"), F.col("dst").alias("parent")))


@query("SELECT p_partkey AS id, p_name AS label, CASE WHEN p_name = 'ring' THEN 1.0 WHEN p_name LIKE 'ring%' THEN 0.8 ELSE 0.5 END::DOUBLE AS score FROM part WHERE p_name LIKE '%ring%' ORDER BY score DESC, label, id LIMIT 25")
def concept_search(spark, d):
    return L.concept_search(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), "Ring", 25)


@query("SELECT field, filled, filled >= 0.9 AS passes FROM (SELECT unnest(['lang', 'source', 'text']) AS field, unnest([avg((lang IS NOT NULL)::INT), avg((source IS NOT NULL)::INT), avg((text IS NOT NULL)::INT)]) AS filled FROM documents)")
def quality_gate(spark, d):
    return L.quality_gate(table(spark, d, "documents"), ["lang", "source", "text"], 0.9)


@query(f"WITH {PLACE_SQL} SELECT DISTINCT a.src AS s, 'IN_REGION' AS p, b.dst AS o FROM edges a JOIN edges b ON a.dst = b.src UNION SELECT b.dst, 'HAS', a.src FROM edges a JOIN edges b ON a.dst = b.src")
def construct_triples(spark, d):
    t = place_graph(spark, d).edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))
    return L.construct(t, [("?c", "IN_REGION", "?r"), ("?r", "HAS", "?c")], "?c LIVES_IN ?n . ?n PART_OF ?r")


_CAUSES = "causes AS (SELECT user_id AS src, (user_id * 7 + 3) % 15 AS dst, min(ts) AS recorded_at FROM events GROUP BY ALL UNION ALL SELECT user_id, (user_id + 1) % 15, min(ts) + INTERVAL 1 DAY FROM events GROUP BY ALL)"


def _causes(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("src")).agg(F.min("ts").cast("timestamp").alias("at"))
    one = e.select("src", ((F.col("src") * 7 + 3) % 15).alias("dst"), F.col("at").alias("recorded_at"))
    return one.unionByName(e.select("src", ((F.col("src") + 1) % 15).alias("dst"), F.expr("at + INTERVAL 1 DAY").alias("recorded_at")))


@query(f"WITH RECURSIVE {_CAUSES}, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM causes), w AS (SELECT [src, dst] AS path, dst AS x FROM l WHERE src < dst UNION ALL SELECT list_append(path, l.dst), l.dst FROM w JOIN l ON l.src = w.x WHERE len(path) <= 4 AND (l.dst = path[1] OR (l.dst > path[1] AND NOT list_contains(path, l.dst))) AND w.x <> path[1]) SELECT path[1 : len(path) - 1] AS path FROM w WHERE len(path) > 2 AND path[1] = x")
def causal_loops(spark, d):
    return L.causal_loops(_causes(spark, d), 4)


@query(f"WITH RECURSIVE {_CAUSES}, l AS MATERIALIZED (SELECT DISTINCT src, dst FROM causes WHERE recorded_at <= TIMESTAMP '2024-03-01 00:00:00'), w AS (SELECT 2::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN l ON src = id WHERE depth < 4) SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0")
def causal_chain_at(spark, d):
    return L.chain_at(_causes(spark, d), 2, F.lit("2024-03-01 00:00:00").cast("timestamp"), 4)


_STORE = "store AS (SELECT o_custkey AS id, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderstatus = 'P' AS gone, 'ns' || (o_custkey % 3) AS namespace FROM orders)"


def _store(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.row_number().over(w).alias("version"), (F.col("o_orderstatus") == "P").alias("gone"), F.concat(F.lit("ns"), (F.col("o_custkey") % 3).cast("string")).alias("namespace"))


@query(f"WITH {_STORE} SELECT id, price, version FROM store QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1 AND NOT gone")
def store_latest(spark, d):
    return L.latest(_store(spark, d), "id", deleted="gone").select("id", "price", "version")


@query(f"WITH {_STORE}, put AS (SELECT c_custkey AS id, coalesce((SELECT max(version) FROM store s WHERE s.id = c_custkey), 0) + 1 AS version, c_acctbal AS price FROM customer) SELECT id, version, price FROM put UNION ALL SELECT id, version, price FROM store")
def store_put(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price"))
    return L.put(_store(spark, d), rows, "id").select("id", "version", "price")


@query(f"WITH {_STORE} SELECT id, version, namespace FROM store WHERE namespace IN ('ns0', 'ns2')")
def store_readable(spark, d):
    grants = spark.createDataFrame([("ns0", "ada", "read"), ("ns2", "ada", "admin"), ("ns1", "ada", "none"), ("ns1", "eve", "read")], "namespace string, user string, permission string")
    return L.readable(_store(spark, d), grants, "ada").select("id", "version", "namespace")


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY id LIMIT 30 OFFSET 60")
def store_page(spark, d):
    return L.page(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id", 60, 30)


@query("SELECT count(*) FILTER (o_orderkey % 7 = 1) AS n_removed, count(*) FILTER (o_orderkey % 7 = 2) AS n_added, count(*) FILTER (o_orderkey % 7 = 3) AS n_changed, count(*) FILTER (o_orderkey % 7 NOT IN (1, 2, 3)) AS n_same FROM orders")
def checkpoint_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey") % 7
    return L.checkpoint_diff(o.where(k != 2), o.where(k != 1).withColumn("o_orderstatus", F.when(k == 3, F.lit("changed")).otherwise(F.col("o_orderstatus"))), "o_orderkey")


@query(f"WITH {NEAR_SQL}, deg AS (SELECT src AS id, count(*) / 4.0 AS b FROM und GROUP BY src), v AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS a FROM embeddings) SELECT coalesce(v.id, deg.id) AS id, round(0.7 * coalesce(a, 0) + 0.3 * coalesce(b, 0), 6) AS score FROM v FULL JOIN deg ON v.id = deg.id")
def blended_similarity(spark, d):
    from loomgraph.graph import undirected

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), S.dot(F.col("embedding"), F.col("embedding")).alias("score"))
    g = undirected(near_graph(spark, d).edges).groupBy(F.col("src").alias("id")).agg((F.count("dst") / 4).alias("score"))
    return L.blended(v, g, 0.3).select("id", F.round("score", 6).alias("score"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS b FROM embeddings WHERE vec_id < 5), s AS (SELECT query_id, vec_id AS id, round(list_dot_product(embedding::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])) + 1e-10), 6) AS score FROM embeddings, q WHERE vec_id <> query_id) SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 4")
def batch_similar_nodes(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = retrieval.search_batch(v, v.where("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 4)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey AS observation, rule_id, 0.3 / (1 + n) + 0.7 * p AS score FROM customer JOIN (VALUES ('r1', 'BUILDING', 2, 0.5), ('r2', 'MACHINERY', 1, 0.9), ('r3', 'BUILDING', 3, 0.8)) r(rule_id, segment, n, p) ON segment = c_mktsegment")
def abductive_hypotheses(spark, d):
    rules = spark.createDataFrame([("r1", "BUILDING", ["a", "b"], 0.5), ("r2", "MACHINERY", ["a"], 0.9), ("r3", "BUILDING", ["a", "b", "c"], 0.8)], "rule_id string, conclusion string, premises array<string>, plausibility double")
    seen = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("observation"))
    return reasoning.hypotheses(seen.select("observation").distinct(), rules).join(seen, "observation").select(F.col("c_custkey").alias("observation"), "rule_id", "score")


@query(f"WITH {PLACE_SQL} SELECT src AS a0, dst AS a1, 'LIVES_IN' AS kind FROM edges WHERE type = 'LIVES_IN' UNION ALL SELECT src, dst, 'PART_OF' FROM edges WHERE type = 'PART_OF'")
def graph_facts(spark, d):
    facts = reasoning.graph_facts(place_graph(spark, d).edges)
    return facts["LIVES_IN"].withColumn("kind", F.lit("LIVES_IN")).unionByName(facts["PART_OF"].withColumn("kind", F.lit("PART_OF")))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_custkey % 5 = 0 THEN TIMESTAMP '2000-01-01' END AS valid_until, CASE WHEN o_custkey % 5 = 0 THEN 'erased' END AS retracted_for FROM orders")
def retracted_facts(spark, d):
    facts = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("timestamp").alias("valid_until"))
    gone = table(spark, d, "orders").where("o_custkey % 5 = 0").select("o_custkey")
    return records.retract(facts, gone, "o_custkey", F.lit("2000-01-01").cast("timestamp"), "erased").select("id", "status", "valid_until", "retracted_for")


# serialisations
@query(f"WITH {PLACE_SQL} SELECT -1 AS part, '<graphml><graph edgedefault=\"directed\">' AS value UNION ALL SELECT 0, '<node id=\"' || id || '\"/>' FROM nodes UNION ALL SELECT 1, '<edge source=\"' || src || '\" target=\"' || dst || '\"/>' FROM edges UNION ALL SELECT 2, '</graph></graphml>'")
def graphml_export(spark, d):
    g = place_graph(spark, d)
    return sinks.graphml(g.nodes, g.edges)


@query(f"WITH {PLACE_SQL} SELECT '\"' || src || '\" -> \"' || dst || '\" [label=\"' || type || '\"];' AS value FROM edges")
def dot_export(spark, d):
    return sinks.dot(place_graph(spark, d).edges)


@query(f"""WITH {PLACE_SQL} SELECT '<http://example.org/' || src || '>' || chr(10) || '    ' || string_agg('<http://example.org/' || type || '> <http://example.org/' || dst || '>', ' ;' || chr(10) || '    ' ORDER BY type, dst) || ' .' AS value FROM edges GROUP BY src""")
def turtle_export(spark, d):
    iri = lambda c: F.concat(F.lit("<http://example.org/"), F.col(c), F.lit(">"))
    return sinks.turtle(place_graph(spark, d).edges.select(iri("src").alias("s"), iri("type").alias("p"), iri("dst").alias("o")))


@query(f"""WITH {PLACE_SQL} SELECT '{{"@id":"http://example.org/' || id || '","@type":"' || type || '","label":"' || name || '"}}' AS value FROM nodes""")
def jsonld_export(spark, d):
    return sinks.jsonld(place_graph(spark, d).nodes)


@query(f"""WITH {PLACE_SQL} SELECT 'INSERT {{"src":"' || src || '","dst":"' || dst || '"}} INTO ties' AS value FROM edges""")
def aql_export(spark, d):
    return sinks.aql(place_graph(spark, d).edges.select("src", "dst"), "ties")


@query(f"""WITH {PLACE_SQL} SELECT '<rdf:Description rdf:about="http://example.org/' || src || '"><n:' || type || ' rdf:resource="http://example.org/' || dst || '"/></rdf:Description>' AS value FROM edges""")
def rdfxml_export(spark, d):
    return sinks.rdfxml(place_graph(spark, d).edges, "http://example.org/").where("part = 0").select("value")
