"""Graph analytics on the place and trade graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import simple_pairs
from loomgraph.operators import graph_algorithms as G
from loomgraph.plans.frames import PLACE_SQL, TRADE_SQL, place_graph, trade_graph
from loomgraph.queries import query

PLACE, TRADE = f"WITH {PLACE_SQL} ", f"WITH {TRADE_SQL} "


@query(PLACE + "SELECT n.id, coalesce(d.degree, 0) AS degree, coalesce(d.degree, 0) / greatest((SELECT count(*) FROM nodes) - 1, 1) AS score FROM nodes n LEFT JOIN (SELECT src AS id, count(*) AS degree FROM und GROUP BY src) d USING (id)")
def degree_centrality(spark, d):
    g = place_graph(spark, d)
    return G.degree_centrality(g.nodes, g.edges)


@query(PLACE + "SELECT id, degree FROM (SELECT src AS id, count(*) AS degree FROM und GROUP BY src) ORDER BY degree DESC, id LIMIT 20")
def top_degree_nodes(spark, d):
    g = place_graph(spark, d)
    return G.degree_centrality(g.nodes, g.edges).orderBy(F.desc("degree"), "id").limit(20).select("id", "degree")


@query(PLACE + """, deg AS (SELECT n.id, coalesce(count(u.dst), 0) AS degree FROM nodes n LEFT JOIN und u ON n.id = u.src GROUP BY n.id)
SELECT count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, sum(degree) / (count(*) * (count(*) - 1)) AS density, min(degree) AS min_degree, avg(degree) AS avg_degree, max(degree) AS max_degree FROM deg""")
def graph_metrics(spark, d):
    g = place_graph(spark, d)
    return G.graph_metrics(g.nodes, g.edges)


@query(PLACE + "SELECT degree, count(*) AS n FROM (SELECT src, count(*) AS degree FROM und GROUP BY src) GROUP BY degree")
def degree_histogram(spark, d):
    g = place_graph(spark, d)
    return G.degree_centrality(g.nodes, g.edges).where("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query(PLACE + "SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def type_histogram(spark, d):
    g = place_graph(spark, d)
    return g.nodes.groupBy(F.lit("node").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n")).unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n")))


@query("WITH RECURSIVE " + PLACE_SQL + """, reach AS (SELECT id, id AS label FROM nodes WHERE type = 'Region' UNION SELECT u.src, r.label FROM reach r JOIN und u ON u.dst = r.id),
named AS (SELECT r.id, l.component FROM reach r JOIN (SELECT label, min(id) AS component FROM reach GROUP BY label) l USING (label))
SELECT n.id, coalesce(c.component, n.id) AS component FROM nodes n LEFT JOIN named c USING (id)""")
def connected_components(spark, d):
    g = place_graph(spark, d)
    return G.connected_components(g.nodes, g.edges)


def _pagerank_sql(rounds: int) -> str:
    steps = ["p0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * coalesce(g.got, 0) AS rank FROM nodes n LEFT JOIN (SELECT e.dst AS id, sum(p.rank / o.n) AS got FROM links e JOIN o ON e.src = o.src JOIN p{i} p ON p.id = e.src GROUP BY e.dst) g ON g.id = n.id)")
    return ", links AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), o AS MATERIALIZED (SELECT src, count(*) AS n FROM links GROUP BY src), " + ", ".join(steps) + f" SELECT id, rank FROM p{rounds}"


@query(TRADE + _pagerank_sql(10))
def pagerank_trade(spark, d):
    g = trade_graph(spark, d)
    return G.pagerank(g.nodes, g.edges, iterations=10)


@query(PLACE + _pagerank_sql(6))
def pagerank_places(spark, d):
    g = place_graph(spark, d)
    return G.pagerank(g.nodes, g.edges, iterations=6)


def _eigen_sql(rounds: int) -> str:
    steps = ["x0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS x FROM nodes)"]
    for i in range(rounds):
        steps.append(f"y{i} AS MATERIALIZED (SELECT n.id, coalesce(g.x, 0) AS x FROM nodes n LEFT JOIN (SELECT u.src AS id, sum(v.x) AS x FROM und u JOIN x{i} v ON v.id = u.dst GROUP BY u.src) g ON g.id = n.id), x{i + 1} AS MATERIALIZED (SELECT id, CASE WHEN (SELECT max(x) FROM y{i}) > 0 THEN x / (SELECT max(x) FROM y{i}) ELSE 0 END AS x FROM y{i})")
    return ", " + ", ".join(steps) + f" SELECT id, round(x, 6) AS score FROM x{rounds}"


@query(TRADE + _eigen_sql(8))
def eigenvector_trade(spark, d):
    g = trade_graph(spark, d)
    return G.eigenvector_centrality(g.nodes, g.edges, iterations=8).select("id", F.round("score", 6).alias("score"))


@query("WITH RECURSIVE " + PLACE_SQL + ", walk AS (SELECT id AS origin, id, 0 AS hops FROM nodes WHERE type = 'Region' UNION ALL SELECT w.origin, e.src, hops + 1 FROM walk w JOIN edges e ON e.dst = w.id WHERE hops < 3) SELECT origin, id, min(hops) AS hops FROM walk GROUP BY origin, id")
def khop_3(spark, d):
    g = place_graph(spark, d)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.bfs_levels(back, g.nodes.where("type = 'Region'").select("id"), 3)


@query("WITH RECURSIVE " + PLACE_SQL + ", walk AS (SELECT 'r0' AS id, 0 AS hop, 1.0::DOUBLE AS decay UNION ALL SELECT e.src, hop + 1, decay * weight FROM walk w JOIN edges e ON e.dst = w.id WHERE hop < 2) SELECT id, hop, decay, CASE WHEN hop <= 1 THEN 'direct' WHEN hop <= 3 THEN 'near' ELSE 'far' END AS band FROM walk WHERE hop > 0")
def neighborhood_with_decay(spark, d):
    g = place_graph(spark, d)
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
    return G.neighborhood(back, "r0", 2)


def _distance_sql(rounds: int) -> str:
    steps = ["d0 AS MATERIALIZED (SELECT 0 AS id, 0.0::DOUBLE AS distance)"]
    steps += [f"d{i + 1} AS MATERIALIZED (SELECT id, min(distance) AS distance FROM (SELECT * FROM d{i} UNION ALL SELECT e.dst, distance + weight FROM d{i} JOIN both_ways e ON e.src = d{i}.id) GROUP BY id)" for i in range(rounds)]
    return ", both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges), " + ", ".join(steps) + f" SELECT id, round(distance, 6) AS distance FROM d{rounds}"


@query(TRADE + _distance_sql(12))
def dijkstra_distances(spark, d):
    return G.shortest_distances(trade_graph(spark, d).edges, 0, directed=False).select("id", F.round("distance", 6).alias("distance"))


@query("WITH RECURSIVE " + TRADE_SQL + ", walk AS (SELECT id AS origin, id, 0 AS hops FROM nodes UNION SELECT w.origin, e.dst, hops + 1 FROM walk w JOIN und e ON e.src = w.id WHERE hops < 4) SELECT origin, id, min(hops) AS hops FROM walk GROUP BY ALL")
def all_pairs_hops(spark, d):
    from loomgraph.graph import undirected

    g = trade_graph(spark, d)
    return G.bfs_levels(undirected(g.edges), g.nodes.select("id"), 4)


@query("WITH RECURSIVE " + TRADE_SQL + ", walk AS (SELECT id AS origin, id, 0 AS hops FROM nodes UNION SELECT w.origin, e.dst, hops + 1 FROM walk w JOIN und e ON e.src = w.id WHERE hops < 6), d AS (SELECT origin, id, min(hops) AS hops FROM walk GROUP BY ALL) SELECT origin AS id, CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / sum(hops) ELSE 0 END AS score FROM d GROUP BY origin")
def closeness_trade(spark, d):
    g = trade_graph(spark, d)
    return G.closeness(g.nodes, g.edges, 6)


@query("""WITH RECURSIVE """ + TRADE_SQL + """, walk AS (SELECT id AS s, id AS t, 0 AS h, 1::DOUBLE AS n FROM nodes UNION ALL SELECT s, dst, h + 1, sum(n) FROM walk JOIN und ON src = t WHERE h < 5 GROUP BY s, dst, h),
d AS MATERIALIZED (SELECT w.s, w.t, w.h, w.n FROM walk w JOIN (SELECT s, t, min(h) AS h FROM walk GROUP BY ALL) m ON w.s = m.s AND w.t = m.t AND w.h = m.h)
SELECT nodes.id, round(coalesce(b.score, 0), 6) AS score FROM nodes LEFT JOIN (SELECT a.t AS id, sum(a.n * c.n / e.n) / 2 AS score FROM d a JOIN d c ON a.t = c.s JOIN d e ON e.s = a.s AND e.t = c.t WHERE a.h > 0 AND c.h > 0 AND e.h = a.h + c.h GROUP BY a.t) b ON b.id = nodes.id""")
def betweenness_trade(spark, d):
    g = trade_graph(spark, d)
    return G.betweenness(g.nodes, g.edges).select("id", F.round("score", 6).alias("score"))


@query(TRADE + ", e AS (SELECT * FROM und WHERE src < dst) SELECT id, count(*) AS triangles FROM (SELECT unnest([a.src, a.dst, b.dst]) AS id FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst) GROUP BY id")
def triangles_trade(spark, d):
    return G.triangles(trade_graph(spark, d).edges)


@query(PLACE + """, deg AS (SELECT src, count(*) AS d FROM und GROUP BY src), w AS (SELECT a.dst AS u, b.dst AS v, d FROM und a JOIN und b ON a.src = b.src JOIN deg ON deg.src = a.src WHERE a.dst < b.dst),
c AS (SELECT u, v, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / (d * ln(d)) ELSE 0 END) AS adamic_adar, sum(1 / d) AS resource FROM w GROUP BY u, v)
SELECT c.u, c.v, common, common / (x.d + y.d - common) AS jaccard, adamic_adar, resource, x.d * y.d AS preferential FROM c JOIN deg x ON x.src = c.u JOIN deg y ON y.src = c.v WHERE NOT EXISTS (SELECT 1 FROM und WHERE src = c.u AND dst = c.v)""")
def link_prediction(spark, d):
    return G.link_scores(place_graph(spark, d).edges)


@query(TRADE + """, lab0 AS (SELECT id, id AS c FROM nodes), """ + ", ".join(f"lab{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(b.c, l.c) AS c FROM lab{i} l LEFT JOIN (SELECT src, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY n DESC, c) AS r FROM (SELECT src, c, count(*) AS n FROM und JOIN lab{i} ON lab{i}.id = dst GROUP BY ALL)) WHERE r = 1) b ON b.src = l.id)" for i in range(5)) + " SELECT id, c AS community FROM lab5")
def label_propagation_trade(spark, d):
    g = trade_graph(spark, d)
    return G.label_propagation(g.nodes, g.edges, 5)


@query(PLACE + """, comm AS (SELECT 'r' || r_regionkey AS id, r_regionkey AS c FROM region UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT count(*) / 2 AS m FROM und)
SELECT round((SELECT count(*) / 2 FROM und JOIN comm a ON a.id = src JOIN comm b ON b.id = dst WHERE a.c = b.c) / m - (SELECT sum(d::DOUBLE * d) FROM (SELECT c, count(*) AS d FROM und JOIN comm ON id = src GROUP BY c)) / (4 * m * m), 9) AS modularity FROM m""")
def modularity_by_region(spark, d):
    from loomgraph.queries import table

    g = place_graph(spark, d)
    nation, customer, region = (table(spark, d, t) for t in ("nation", "customer", "region"))
    comm = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_regionkey").alias("community")).unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_regionkey").alias("community")))
    comm = comm.unionByName(customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("n_regionkey").alias("community")))
    return G.modularity(g.edges, comm).select(F.round("modularity", 9).alias("modularity"))


@query()
def louvain_trade(spark, d):
    g = trade_graph(spark, d)
    return G.louvain_level(g.nodes, g.edges)


@query()
def clique_communities_trade(spark, d):
    return G.clique_communities(trade_graph(spark, d).edges)


@query(PLACE + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges")
def bridge_edges(spark, d):
    """Every edge of a tree is a bridge."""
    return G.bridges(place_graph(spark, d).edges)


@query(TRADE + "SELECT src, dst FROM und WHERE src < dst")
def simple_trade_pairs(spark, d):
    return simple_pairs(trade_graph(spark, d).edges)


@query(PLACE + """SELECT 'DANGLING_EDGE' AS code, 'error' AS severity, src || '->' || dst AS ref FROM edges WHERE dst LIKE 'n%' AND dst NOT IN (SELECT id FROM nodes WHERE type <> 'Nation' OR name < 'M') UNION ALL SELECT 'DANGLING_EDGE', 'error', src || '->' || dst FROM edges WHERE src LIKE 'n%' AND src NOT IN (SELECT id FROM nodes WHERE type <> 'Nation' OR name < 'M')""")
def graph_validation(spark, d):
    g = place_graph(spark, d)
    return G.validate_graph(g.nodes.where("type <> 'Nation' OR name < 'M'"), g.edges)


@query()
def random_walks(spark, d):
    g = trade_graph(spark, d)
    return G.random_walks(g.nodes, g.edges, 6, 2)
