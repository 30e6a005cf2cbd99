"""Reasoning, provenance, decisions, policies, ontologies and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import reasoning, records
from loomgraph.plans.frames import DECISIONS_SQL, PLACE_SQL, decisions, place_graph
from loomgraph.queries import query, table
from loomgraph.sources import sinks


def _part_of(spark, d):
    g = place_graph(spark, d)
    return {"part_of": g.edges.select(F.col("src").alias("a0"), F.col("dst").alias("a1"))}


@query(f"WITH RECURSIVE {PLACE_SQL}, a AS (SELECT src, dst FROM edges UNION SELECT a.src, e.dst FROM a JOIN edges e ON a.dst = e.src) SELECT src AS a0, dst AS a1 FROM a")
def datalog_ancestor(spark, d):
    return reasoning.datalog(_part_of(spark, d), ["within(X, Y) :- part_of(X, Y).", "within(X, Z) :- within(X, Y), part_of(Y, Z)."])["within"]


@query(f"WITH {PLACE_SQL} SELECT DISTINCT a.src AS x FROM edges a JOIN edges b ON a.dst = b.src WHERE b.dst = 'r1'")
def datalog_query(spark, d):
    closed = reasoning.datalog(_part_of(spark, d), ["IF part_of(?x, ?y) AND part_of(?y, ?z) THEN within(?x, ?z)"])
    return reasoning.ask(closed, "within(?x, r1)").withColumnRenamed("?x", "x")


@query(f"WITH RECURSIVE {PLACE_SQL}, a AS (SELECT src, dst FROM edges UNION SELECT a.src, e.dst FROM a JOIN edges e ON a.dst = e.src) SELECT src, dst FROM a")
def recursive_sql_closure(spark, d):
    return reasoning.recursive_closure(spark, place_graph(spark, d).edges, 5)


@query(f"WITH RECURSIVE {PLACE_SQL}, l AS (SELECT id AS origin, id, 0 AS depth FROM nodes WHERE type = 'Customer' UNION ALL SELECT origin, e.dst, depth + 1 FROM l JOIN edges e ON e.src = l.id) SELECT origin, id, depth FROM l")
def lineage_bfs(spark, d):
    g = place_graph(spark, d)
    return records.lineage(g.edges.select(F.col("src").alias("id"), F.col("dst").alias("parent")), g.nodes.where("type = 'Customer'").select("id"))


_CAUSES_SQL = "causes AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"


def _causes(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst IS NOT NULL")


@query(f"WITH RECURSIVE {_CAUSES_SQL}, start AS (SELECT src AS id FROM causes WHERE src NOT IN (SELECT dst FROM causes) ORDER BY src LIMIT 1), c AS (SELECT id, 0 AS depth FROM start UNION ALL SELECT dst, depth + 1 FROM c JOIN causes ON src = id WHERE depth < 5) SELECT id, depth FROM c WHERE depth > 0")
def causal_chain(spark, d):
    e = _causes(spark, d)
    first = e.select("src").join(e.select(F.col("dst").alias("src")), "src", "left_anti").orderBy("src").first()
    return records.causal_chain(e, first[0])


@query(f"WITH {_CAUSES_SQL} SELECT DISTINCT src AS id FROM causes WHERE src NOT IN (SELECT dst FROM causes)")
def causal_roots(spark, d):
    e = _causes(spark, d)
    return e.select("src").join(e.select(F.col("dst").alias("src")), "src", "left_anti").distinct().withColumnRenamed("src", "id")


@query(f"""WITH {DECISIONS_SQL}, e AS (SELECT a.maker AS id, CASE WHEN a.outcome = 'F' THEN 'PRECEDENT_FOR' ELSE 'INFLUENCED' END AS type, confidence FROM decisions a),
f AS (SELECT id, count(*) FILTER (WHERE type <> 'PRECEDENT_FOR') AS ni, coalesce(avg(confidence) FILTER (WHERE type <> 'PRECEDENT_FOR'), 0) AS ai, count(*) FILTER (WHERE type = 'PRECEDENT_FOR') AS np, coalesce(avg(confidence) FILTER (WHERE type = 'PRECEDENT_FOR'), 0) AS ap FROM e GROUP BY id)
SELECT id, least(1.0, (ni * ai + 0.5 * np * ap) / (greatest(ni, 1) + 0.5 * greatest(np, 1))) AS impact FROM f""")
def decision_impact(spark, d):
    e = decisions(spark, d).select(F.col("maker").alias("src"), F.col("decision_id").alias("dst"), F.when(F.col("outcome") == "F", "PRECEDENT_FOR").otherwise("INFLUENCED").alias("type"), "confidence")
    return records.impact(e)


@query(f"WITH {DECISIONS_SQL} SELECT category, count(*) AS n, avg(confidence) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, list_sort(list(confidence))[len(list(confidence)) // 2 + 1] AS median_confidence FROM decisions GROUP BY category")
def decision_insights(spark, d):
    return records.insights(decisions(spark, d))


@query(f"WITH {DECISIONS_SQL} SELECT decision_id, concat_ws(',', CASE WHEN NOT coalesce(confidence >= 0.2, false) THEN 'min_confidence' END, CASE WHEN NOT coalesce(confidence <= 0.9, false) THEN 'max_confidence' END, CASE WHEN outcome NOT IN ('F', 'O') THEN 'required_outcome' END, CASE WHEN maker IS NULL THEN 'maker' END) AS violations, confidence >= 0.2 AND confidence <= 0.9 AND outcome IN ('F', 'O') AND maker IS NOT NULL AS compliant FROM decisions")
def policy_compliance(spark, d):
    return records.compliance(decisions(spark, d), {"min_confidence": 0.2, "max_confidence": 0.9, "required_outcome": ["F", "O"], "maker": True})


_W = "list_distinct(list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"WITH {DECISIONS_SQL}, s AS (SELECT decision_id, category, {_W.format('scenario')} AS a, {_W.format(repr('order of customer 3 1-urgent'))} AS b FROM decisions) SELECT decision_id, 0.7 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + CASE WHEN category = '1-URGENT' THEN 0.3 ELSE 0 END AS score FROM s ORDER BY score DESC, decision_id LIMIT 10")
def precedent_jaccard(spark, d):
    return records.precedents(decisions(spark, d), "order of customer 3 1-urgent", category="1-URGENT").select("decision_id", "score")


@query("SELECT policy_id, version, updated_at FROM (SELECT o_orderpriority AS policy_id, o_orderstatus AS version, o_orderdate AS updated_at, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderstatus DESC) AS r FROM (SELECT DISTINCT o_orderpriority, o_orderstatus, o_orderdate FROM orders)) WHERE r = 1")
def policy_latest_version(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("policy_id"), F.col("o_orderstatus").alias("version"), F.col("o_orderdate").alias("updated_at")).distinct()
    return records.latest_policies(p)


@query("""WITH c AS (SELECT o_custkey, o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS checksum FROM orders)
SELECT o_custkey, o_orderkey, checksum, row_number() OVER w AS sequence_id, lag(checksum) OVER w AS previous_checksum FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def hash_chain(spark, d):
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return records.chain(table(spark, d, "orders").select("o_custkey", *fields), "o_custkey", "o_orderkey", fields).select("o_custkey", "o_orderkey", "checksum", "sequence_id", "previous_checksum")


@query("SELECT o_orderkey, 'checksum' AS problem FROM orders WHERE o_orderstatus = 'P'")
def hash_chain_verify(spark, d):
    """Orders in status P are altered after the chain was written: just they are found."""
    fields = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    chained = records.chain(table(spark, d, "orders").select("o_custkey", *fields), "o_custkey", "o_orderkey", fields)
    altered = chained.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P", F.lit("altered")).otherwise(F.col("o_orderpriority")))
    return records.verify_chain(altered, "o_custkey", fields).select("o_orderkey", "problem")


@query("SELECT 'Customer' AS class_name, count(*) AS n FROM customer UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def ontology_classes(spark, d):
    return records.infer_classes(place_graph(spark, d).nodes)


@query("SELECT 'livesIn' AS property, 'Customer' AS domain, 'Nation' AS \"range\", count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'partOf', 'Nation', 'Region', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey")
def ontology_properties(spark, d):
    g = place_graph(spark, d)
    return records.infer_properties(g.edges, g.nodes)


@query("SELECT c_custkey AS id, 'in:segment' AS \"constraint\" FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'pattern:name' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')")
def shacl_violations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return records.shape_violations(c, ["name"], {"segment": ["BUILDING", "MACHINERY"]}, {"name": "[02468]$"})


@query("SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'removed' WHEN a.name IS NULL THEN 'added' ELSE 'domain_changed' END AS change, CASE WHEN b.name IS NULL THEN 'critical' WHEN a.name IS NULL THEN 'safe' ELSE 'high' END AS risk FROM (SELECT p_type AS name, min(p_brand) AS domain FROM part WHERE p_size < 30 GROUP BY 1) a FULL JOIN (SELECT p_type AS name, min(p_brand) AS domain FROM part WHERE p_size > 20 GROUP BY 1) b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.domain IS DISTINCT FROM b.domain")
def ontology_diff(spark, d):
    p = table(spark, d, "part")
    snap = lambda w: p.where(w).groupBy(F.col("p_type").alias("name")).agg(F.min("p_brand").alias("domain"))
    return records.schema_diff(snap("p_size < 30"), snap("p_size > 20"))


def _triples(spark, d):
    g = place_graph(spark, d)
    return g.edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o")).unionByName(g.nodes.select(F.col("id").alias("s"), F.lit("name").alias("p"), F.col("name").alias("o")))


@query("SELECT 'c' || c_custkey AS person, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def triples_bgp_join(spark, d):
    return records.SparqlSubset(_triples(spark, d)).select('SELECT ?person ?region WHERE { ?person LIVES_IN ?n . ?n PART_OF ?r . ?r name ?region FILTER(?region != "ASIA") }')


@query("SELECT 'n' || n_nationkey AS n, 'c' || c_custkey AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE 'n' || n_nationkey < 'n2'")
def sparql_optional(spark, d):
    return records.SparqlSubset(_triples(spark, d)).select('SELECT ?n ?c WHERE { ?n PART_OF ?r OPTIONAL { ?c LIVES_IN ?n } FILTER(?n < "n2") }')


@query("SELECT count(*) AS total FROM customer")
def sparql_count(spark, d):
    return records.SparqlSubset(_triples(spark, d)).select("SELECT (COUNT(*) AS ?total) WHERE { ?c LIVES_IN ?n }")


@query("SELECT 'n' || c_nationkey AS o, 'added' AS change, 'c' || c_custkey AS s, 'LIVES_IN' AS p FROM customer WHERE c_acctbal >= 9000 UNION ALL SELECT 'n' || c_nationkey, 'removed', 'c' || c_custkey, 'LIVES_IN' FROM customer WHERE c_acctbal < 0")
def triples_delta(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("s"), F.lit("LIVES_IN").alias("p"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("o"), "c_acctbal")
    return records.triple_delta(c.where("c_acctbal < 9000").drop("c_acctbal"), c.where("c_acctbal >= 0").drop("c_acctbal"))


@query("""SELECT '<http://example.org/c' || c_custkey || '> <http://example.org/LIVES_IN> <http://example.org/n' || c_nationkey || '> .' AS value FROM customer UNION ALL SELECT '<http://example.org/n' || n_nationkey || '> <http://example.org/PART_OF> <http://example.org/r' || n_regionkey || '> .' FROM nation""")
def ntriples_edges(spark, d):
    g = place_graph(spark, d)
    return sinks.ntriples(sinks.graph_triples(g.nodes.limit(0), g.edges))


@query("""SELECT 'MERGE (n:Region {id: ''r' || r_regionkey || '''}) SET n.name = ''' || r_name || ''';' AS value FROM region UNION ALL SELECT 'MATCH (a {id: ''n' || n_nationkey || '''}), (b {id: ''r' || n_regionkey || '''}) MERGE (a)-[:PART_OF]->(b);' FROM nation""")
def cypher_export(spark, d):
    g = place_graph(spark, d)
    return sinks.cypher(g.nodes.where("type = 'Region'"), g.edges.where("type = 'PART_OF'")).select("value")


@query("SELECT 'e' AS kind, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'n', count(*) FROM nation WHERE n_regionkey = 1")
def bulk_csv_validation(spark, d):
    g = place_graph(spark, d)
    nation = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"))
    nodes = g.nodes.where("type = 'Customer'").unionByName(g.nodes.join(nation, "id", "left_semi"))
    n, _, dangling = sinks.bulk_csv_frames(nodes, g.edges.where("type = 'LIVES_IN'"))
    return dangling.select(F.lit("e").alias("kind")).unionByName(n.where("`:LABEL` = 'Nation'").select(F.lit("n").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS passed, count(*) FILTER (WHERE o_totalprice > 100000) / count(*) AS pass_rate FROM orders")
def eval_summary(spark, d):
    return records.eval_summary(table(spark, d, "orders").select((F.col("o_totalprice") > 100000).alias("passed")))
