"""Derived triples, propositional rules, incremental matches, and retrieval over graphs and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import inference as I
from loomgraph.plans.frames import NEAR_SQL, PLACE_SQL, near_graph, place_graph
from loomgraph.queries import query, table

LOCATED = "LOCATED_IN(X, Z) :- LIVES_IN(X, Y), PART_OF(Y, Z)."


def _triples(spark, d):
    return place_graph(spark, d).edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"))


@query("SELECT 'c' || c_custkey AS x, 'r' || n_regionkey AS z FROM customer JOIN nation ON c_nationkey = n_nationkey")
def sparql_inferred(spark, d):
    return I.sparql_inferred(_triples(spark, d), [LOCATED], "SELECT ?x ?z WHERE { ?x LOCATED_IN ?z }")


@query(f"WITH {PLACE_SQL} SELECT p, count(*) AS n FROM (SELECT src, type AS p, dst FROM edges UNION ALL SELECT 'c' || c_custkey, 'LOCATED_IN', 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY p")
def inferred_triples(spark, d):
    return I.inferred_triples(_triples(spark, d), [LOCATED]).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def _shipping(spark, d):
    """Suppliers with a positive balance deliver; an order is served if all its suppliers deliver, a customer if all their orders are."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    facts = table(spark, d, "supplier").where("s_acctbal > 0").select(key("s", "s_suppkey").alias("statement"))
    orders = table(spark, d, "lineitem").select(key("ro", "l_orderkey").alias("rule_id"), key("o", "l_orderkey").alias("conclusion"), key("s", "l_suppkey").alias("premise"))
    customers = table(spark, d, "orders").select(key("rc", "o_custkey").alias("rule_id"), key("c", "o_custkey").alias("conclusion"), key("o", "o_orderkey").alias("premise"))
    return facts, orders.unionByName(customers)


_SERVED = """good AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0),
served AS MATERIALIZED (SELECT l_orderkey AS k FROM lineitem LEFT JOIN good ON l_suppkey = s_suppkey GROUP BY 1 HAVING bool_and(s_suppkey IS NOT NULL)),
glad AS MATERIALIZED (SELECT o_custkey AS k FROM orders LEFT JOIN served ON o_orderkey = k GROUP BY 1 HAVING bool_and(k IS NOT NULL))"""


@query(f"WITH {_SERVED} SELECT 's' || s_suppkey AS statement, 0 AS depth, NULL AS rule_id FROM good UNION ALL SELECT 'o' || k, 1, 'ro' || k FROM served UNION ALL SELECT 'c' || k, 2, 'rc' || k FROM glad")
def deductive_conclusions(spark, d):
    return I.conclusions(*_shipping(spark, d))


@query(f"""WITH {_SERVED} SELECT DISTINCT 'o' || l_orderkey AS statement, 1 AS depth, 'ro' || l_orderkey AS rule_id, 's' || l_suppkey AS premise, 0 AS premise_depth FROM lineitem JOIN served ON l_orderkey = k
UNION ALL SELECT 'c' || o_custkey, 2, 'rc' || o_custkey, 'o' || o_orderkey, 1 FROM orders JOIN glad ON o_custkey = k""")
def derivation_steps(spark, d):
    facts, rules = _shipping(spark, d)
    return I.explain(I.conclusions(facts, rules), rules)


@query("SELECT DISTINCT o_custkey::VARCHAR AS \"C\", o_orderkey::VARCHAR AS \"O\", l_partkey::VARCHAR AS \"P\", 'bought' AS head, 3 AS priority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def rule_activations(spark, d):
    text = lambda c: F.col(c).cast("string")
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    contains = line.select(text("l_orderkey").alias("a0"), text("l_partkey").alias("a1"))
    ordered = o.select(text("o_custkey").alias("a0"), text("o_orderkey").alias("a1"), (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).alias("new"))
    old = {"ordered": ordered.where("NOT new").drop("new"), "contains": contains}
    return I.activations(old, {"ordered": ordered.where("new").drop("new")}, "IF ordered(C, O) AND contains(O, P) THEN bought(C, P)", priority=3)


@query(f"""WITH {NEAR_SQL}, w AS (SELECT id, (contains(lower(name), '#00000001')::INT + contains(lower(name), '7')::INT) / 2.0 AS seed_score FROM nodes), seeds AS MATERIALIZED (SELECT * FROM w WHERE seed_score > 0),
reach AS (SELECT id AS origin, id, 0 AS hops FROM seeds UNION ALL SELECT s.id, u.dst, 1 FROM seeds s JOIN und u ON s.id = u.src UNION ALL SELECT s.id, v.dst, 2 FROM seeds s JOIN und u ON s.id = u.src JOIN und v ON u.dst = v.src),
least_hops AS (SELECT origin, id, min(hops) AS hops FROM reach GROUP BY ALL)
SELECT r.id, max(seed_score)::DOUBLE AS seed_score, min(hops) AS hops, max(seed_score * pow(0.5, hops))::DOUBLE AS score FROM least_hops r JOIN seeds s ON r.origin = s.id GROUP BY r.id""")
def graph_retrieve(spark, d):
    g = near_graph(spark, d)
    return I.graph_retrieve(g.nodes, g.edges, ["#00000001", "7"], hops=2)


@query("""SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' AND (o_orderstatus <> 'F' OR TIMESTAMP '1996-06-30' < o_orderdate + INTERVAL 90 DAY)""")
def retrieve_at(spark, d):
    o = table(spark, d, "orders")
    spans = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp") + F.expr("interval 90 days")).alias("valid_until"))
    return I.retrieve_at(o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), spans, F.lit("1996-06-30").cast("timestamp"))


@query("""WITH q AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS b, ['between', 'before', 'AFTER', 'during', NULL][o_orderkey % 5 + 1] AS w, 'orders of customer ' || o_custkey AS base FROM orders)
SELECT o_orderkey, lower(w) AS intent, CASE WHEN w <> 'between' THEN a::DATE END AS at_time, CASE WHEN w = 'between' THEN a::DATE END AS start_time, CASE WHEN w = 'between' THEN b::DATE END AS end_time, base || '?' AS rest FROM q""")
def temporal_rewrite(spark, d):
    o = table(spark, d, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    a, b = day(F.col("o_orderdate")), day(F.col("o_orderdate") + F.expr("interval 30 days"))
    phrase = F.element_at(F.array(F.concat(F.lit(" between "), a, F.lit(" and "), b), F.concat(F.lit(" before "), a), F.concat(F.lit(" AFTER "), a), F.concat(F.lit(" during "), a), F.lit("")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("orders of customer "), F.col("o_custkey").cast("string"), phrase, F.lit("?"))
    return o.select("o_orderkey", text.alias("q")).select("o_orderkey", I.temporal_intent(F.col("q")).alias("t")).select("o_orderkey", "t.*")
