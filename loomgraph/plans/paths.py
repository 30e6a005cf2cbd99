"""Paths, reach and communities on the customers' graph, the trade graph and the handoffs between users."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.graph import undirected
from loomgraph.operators import graph_algorithms as G
from loomgraph.operators import temporal as T
from loomgraph.plans.frames import HANDOFFS_SQL, NEAR_SQL, TRADE_SQL, handoffs, near_graph, trade_graph
from loomgraph.plans.graphs import _pagerank_sql
from loomgraph.queries import query


@query(f"WITH RECURSIVE {NEAR_SQL}, walk AS (SELECT 1::BIGINT AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM walk JOIN und ON src = id WHERE hops < 90) SELECT 1::BIGINT AS origin, id, min(hops) AS hops FROM walk GROUP BY id")
def bfs_customers(spark, d):
    g = near_graph(spark, d)
    return G.bfs_levels(undirected(g.edges), g.nodes.where("id = 1").select("id"))


@query(f"WITH RECURSIVE {NEAR_SQL}, reach AS (SELECT id, id AS label FROM nodes UNION SELECT u.dst, r.label FROM reach r JOIN und u ON u.src = r.id WHERE u.dst > r.label) SELECT id, min(label) AS component FROM reach GROUP BY id")
def components_customers(spark, d):
    g = near_graph(spark, d)
    return G.connected_components(g.nodes, g.edges)


@query(f"WITH {NEAR_SQL}" + _pagerank_sql(6))
def pagerank_customers(spark, d):
    g = near_graph(spark, d)
    return G.pagerank(g.nodes, g.edges, iterations=6)


@query(f"WITH RECURSIVE {NEAR_SQL}, walk AS (SELECT 1::BIGINT AS id, 0 AS hops, [1::BIGINT] AS path UNION ALL SELECT dst, hops + 1, min(list_append(path, dst)) FROM walk JOIN und ON src = id WHERE hops < 30 GROUP BY dst, hops) SELECT path, hops FROM walk WHERE id = 100 ORDER BY hops LIMIT 1")
def shortest_path_customers(spark, d):
    return G.shortest_path(undirected(near_graph(spark, d).edges), 1, 100)


_SIMPLE = """walk AS (SELECT 0 AS id, [0] AS path, 0.0::DOUBLE AS cost UNION ALL SELECT e.dst, list_append(path, e.dst), cost + weight FROM walk w JOIN edges e ON e.src = w.id WHERE len(path) <= {} AND w.id <> 7 AND NOT list_contains(path, e.dst))"""


@query(f"WITH RECURSIVE {TRADE_SQL}, {_SIMPLE.format(3)} SELECT path, round(cost, 6) AS cost, row_number() OVER (ORDER BY round(cost, 9), path) AS rank FROM walk WHERE id = 7 ORDER BY round(cost, 9), path LIMIT 5")
def k_shortest_paths(spark, d):
    found = G.k_shortest_paths(trade_graph(spark, d).edges, 0, 7, 5, max_hops=3)
    return found.select("path", F.round("cost", 6).alias("cost"), "rank")


@query(f"WITH RECURSIVE {TRADE_SQL}, {_SIMPLE.format(5)} SELECT path, round(cost, 6) AS cost FROM walk WHERE id = 7 ORDER BY round(cost, 9), path LIMIT 1")
def a_star_trade(spark, d):
    """Towards nation 7, with its cheapest incoming edge as every other node's bound."""
    g = trade_graph(spark, d)
    least = g.edges.where("dst = 7").agg(F.min("weight").alias("h"))
    bound = g.nodes.where("id <> 7").select("id").join(F.broadcast(least))
    return G.a_star(g.edges, bound, 0, 7).select("path", F.round("cost", 6).alias("cost"))


@query(f"WITH {TRADE_SQL}, p AS (SELECT src * 100 + dst AS path_id, [src, dst, (dst + 1) % 25] AS path FROM edges) SELECT path_id, round(a.weight + b.weight, 6) AS length FROM p JOIN edges a ON a.src = path[1] AND a.dst = path[2] LEFT JOIN edges b ON b.src = path[2] AND b.dst = path[3]")
def path_lengths(spark, d):
    e = trade_graph(spark, d).edges
    paths = e.select((F.col("src") * 100 + F.col("dst")).alias("path_id"), F.array("src", "dst", (F.col("dst") + 1) % 25).alias("path"))
    return G.path_length(paths, e).select("path_id", F.round("length", 6).alias("length"))


@query(f"""WITH RECURSIVE {HANDOFFS_SQL}, walk AS (SELECT dst AS id, [src, dst] AS path, "start" AS s FROM handoffs WHERE src = 1 AND type = 'view' UNION ALL SELECT h.dst, list_append(path, h.dst), h."start" FROM walk w JOIN handoffs h ON h.src = w.id AND h."start" >= w.s WHERE h.type = 'view' AND w.id <> 5 AND len(path) <= 3 AND NOT list_contains(path, h.dst)) SELECT path, count(*) AS n FROM walk WHERE id = 5 GROUP BY path""")
def temporal_paths(spark, d):
    return T.temporal_paths(handoffs(spark, d).where("type = 'view'"), 1, 5, max_edges=3)


def _cycles_sql(most: int) -> str:
    grow = """SELECT list_append(path, n.dst) AS path, n.src, n.dst, n.s, n.e FROM {} w JOIN nxt x ON x.src = w.src AND x.dst = w.dst AND x.s = w.s AND x.e = w.e JOIN ends n ON n.src = w.dst AND n.dst = x.to_dst AND n.s = x.to_s WHERE w.path[1] <> w.dst AND len(list_distinct(w.path)) = len(w.path)"""
    steps = ["w1 AS MATERIALIZED (SELECT [src, dst] AS path, src, dst, s, e FROM h WHERE src <> dst)"] + [f"w{i + 1} AS MATERIALIZED ({grow.format(f'w{i}')})" for i in range(1, most)]
    closed = " UNION ALL ".join(f"SELECT path FROM w{i} WHERE path[1] = dst" for i in range(2, most + 1))
    return f"""WITH {HANDOFFS_SQL}, h AS MATERIALIZED (SELECT src, dst, "start" AS s, "end" AS e FROM handoffs WHERE type = 'purchase' AND src <> dst), ends AS MATERIALIZED (SELECT src, dst, s, min(e) AS e FROM h GROUP BY ALL),
nxt AS MATERIALIZED (SELECT src, dst, s, e, to_s, to_dst FROM (SELECT a.*, b.s AS to_s, b.dst AS to_dst, row_number() OVER (PARTITION BY a.src, a.dst, a.s, a.e ORDER BY b.s, b.dst) AS r FROM h a JOIN h b ON b.src = a.dst AND b.s >= a.e AND epoch(date_trunc('second', b.s)) - epoch(date_trunc('second', a.e)) <= 86400) WHERE r = 1), {", ".join(steps)} SELECT path, count(*) AS n FROM ({closed}) GROUP BY path"""


@query(_cycles_sql(5))
def temporal_cycles(spark, d):
    return T.time_cycles(handoffs(spark, d).where("type = 'purchase' AND src <> dst"), most=5, gap_seconds=86400)


@query()
def leiden_customers(spark, d):
    g = near_graph(spark, d)
    return G.leiden(g.nodes, g.edges)


@query(f"WITH {NEAR_SQL}, e AS (SELECT * FROM und WHERE src < dst) SELECT id, count(*) AS triangles FROM (SELECT unnest([a.src, a.dst, b.dst]) AS id FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst) GROUP BY id")
def triangles_customers(spark, d):
    return G.triangles(near_graph(spark, d).edges)


@query(f"""WITH {NEAR_SQL}, deg AS (SELECT src, count(*) AS d FROM und GROUP BY src), w AS (SELECT a.dst AS u, b.dst AS v, d FROM und a JOIN und b ON a.src = b.src JOIN deg ON deg.src = a.src WHERE a.dst < b.dst),
c AS (SELECT u, v, count(*) AS common, sum(CASE WHEN d > 1 THEN 1 / (d * ln(d)) ELSE 0 END) AS adamic_adar, sum(1 / d) AS resource FROM w GROUP BY u, v)
SELECT c.u, c.v, common, common / (x.d + y.d - common) AS jaccard, adamic_adar, resource, x.d * y.d AS preferential FROM c JOIN deg x ON x.src = c.u JOIN deg y ON y.src = c.v WHERE NOT EXISTS (SELECT 1 FROM und WHERE src = c.u AND dst = c.v)""")
def link_prediction_customers(spark, d):
    return G.link_scores(near_graph(spark, d).edges)
