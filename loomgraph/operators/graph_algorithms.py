"""Graph analytics over edge tables: joins and aggregations, with loops that cut their lineage."""

from __future__ import annotations

from functools import reduce
from itertools import count
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.graph import simple_pairs, undirected
from loomgraph.storage import cut

#: Members of a class of like nodes are paired in parts of so many ids at most; a task holds the rows of one id with such a part.
PART_ROWS = 4096
#: Pairs of nodes are dealt over tasks of about so many rows, as far as so many tasks go.
TASK_ROWS, MOST_TASKS = 1 << 24, 20_000


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree, score``: distinct neighbours, and their share of the other nodes."""
    degrees = undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("degree"))
    total = nodes.agg(F.greatest(F.count("id") - 1, F.lit(1)).alias("others"))
    out = nodes.select("id").join(degrees, "id", "left").na.fill(0, ["degree"])
    return out.join(F.broadcast(total)).select("id", "degree", (F.col("degree") / F.col("others")).alias("score"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, and least, mean and largest degree."""
    d = degree_centrality(nodes, edges)
    return d.agg(
        F.count("id").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"),
        (F.sum("degree") / (F.count("id") * (F.count("id") - 1))).alias("density"), F.min("degree").alias("min_degree"),
        F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"),
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id of the component), by least-label steps with pointer jumping."""
    pairs = cut(undirected(edges))
    labels = nodes.select("id", F.col("id").alias("component"))
    state = None
    while True:
        near = pairs.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("least"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = cut(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("top", "component")).alias("component")))
        now = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return labels
        state = now


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """``id, rank`` after a fixed number of steps; a dangling node's mass isn't passed on."""
    links = edges.select("src", "dst").distinct()
    weighted = cut(links.join(links.groupBy("src").agg(F.count("dst").alias("out")), "src"))
    n = nodes.count()
    ids = nodes.select("id")
    ranks = ids.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(iterations):
        given = weighted.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = ids.join(given, "id", "left").select("id", (F.lit((1 - damping) / max(1, n)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 3 == 2:
            ranks = cut(ranks)
    return ranks


def eigenvector_centrality(nodes: DataFrame, edges: DataFrame, *, iterations: int = 10) -> DataFrame:
    """``id, score``: power iteration on the symmetric adjacency, scaled to a largest score of 1."""
    pairs = cut(undirected(edges))
    x = nodes.select("id", F.lit(1.0).alias("x"))
    for i in range(iterations):
        got = pairs.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("x"))
        got = nodes.select("id").join(got, "id", "left").na.fill(0.0, ["x"])
        largest = got.agg(F.max("x").alias("top"))
        x = got.join(F.broadcast(largest)).select("id", F.when(F.col("top") > 0, F.col("x") / F.col("top")).otherwise(0.0).alias("x"))
        if i % 3 == 2:
            x = cut(x)
    return x.withColumnRenamed("x", "score")


def bfs_levels(edges: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``origin, id, hops``: nodes reached from each source (column ``id``) over directed edges, at least distance; all of them, or up to ``max_hops``."""
    links = edges.select("src", "dst").distinct()
    seen = sources.select(F.col("id").alias("origin"), "id").distinct().withColumn("hops", F.lit(0))
    frontier = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        out = frontier.join(links, frontier["id"] == links["src"]).select("origin", F.col("dst").alias("id")).distinct()
        frontier = cut(out.join(seen.select("origin", "id"), ["origin", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier) if hop % 8 else cut(seen.union(frontier))
    return seen


def neighborhood(edges: DataFrame, source, hops: int, min_weight: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """``id, hop, decay, band`` from one node over outgoing edges: first visit, the largest product of weights there."""
    links = edges.where(F.col("weight") >= min_weight)
    links = links.where(F.col("type").isin(types)) if types else links
    links = links.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(source).alias("id"), F.lit(0).alias("hop"), F.lit(1.0).alias("decay"))
    frontier = seen
    for hop in range(1, hops + 1):
        out = frontier.join(links, frontier["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.max(F.col("decay") * F.col("weight")).alias("decay"))
        frontier = cut(out.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "decay"))
        seen = seen.union(frontier)
    return seen.where("hop > 0").withColumn("band", distance_band(F.col("hop")))


def distance_band(hops):
    return F.when(hops <= 1, "direct").when(hops <= 3, "near").when(hops <= 6, "mid-range").otherwise("distant")


def shortest_distances(edges: DataFrame, source, *, directed: bool = True, max_rounds: int | None = None) -> DataFrame:
    """``id, distance``: least sums of weights from a node, by relaxing until nothing changes (an error if that takes more than ``max_rounds``)."""
    links = edges.select("src", "dst", "weight")
    links = links if directed else links.union(links.select("dst", "src", "weight"))
    links = cut(links.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("distance"))
    frontier = best
    for done in count():
        if done == max_rounds:
            raise RuntimeError(f"distances still change after {max_rounds} rounds")
        tried = frontier.join(links, frontier["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("tried"))
        better = cut(tried.join(best, "id", "left").where("distance IS NULL OR tried < distance").select("id", F.col("tried").alias("distance")))
        if better.isEmpty():
            break
        best = cut(best.union(better).groupBy("id").agg(F.min("distance").alias("distance")))
        frontier = better
    return best


def shortest_path(edges: DataFrame, source, target, *, max_hops: int | None = None) -> DataFrame:
    """One row ``path, hops``: an unweighted shortest path (ties: the least path by nodes) of at most ``max_hops`` edges, if given; none gives no row."""
    links = edges.select("src", "dst").distinct()
    frontier = edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"))
    seen = frontier.select("id")
    for hop in count() if max_hops is None else range(max_hops + 1):
        hit = frontier.where(F.col("id") == F.lit(target))
        if not hit.isEmpty():
            return hit.select("path", F.lit(hop).alias("hops"))
        out = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(out.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("id"))
    return frontier.where("false").select("path", F.lit(0).alias("hops"))


def k_shortest_paths(edges: DataFrame, source, target, k: int, max_hops: int = 6) -> DataFrame:
    """``path, cost, rank``: the k cheapest simple paths of at most ``max_hops`` edges (ties by path)."""
    links = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    at = edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"), F.lit(0.0).alias("cost"))
    done = at.where("false")
    for _ in range(max_hops):
        at = at.join(links, at["id"] == links["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("weight")).alias("cost"))
        at = cut(at)
        done = done.union(at.where(F.col("id") == F.lit(target)))
        at = at.where(F.col("id") != F.lit(target))
    return done.select("path", "cost").orderBy("cost", "path").limit(k).withColumn("rank", F.row_number().over(W.orderBy("cost", "path")))


def a_star(edges: DataFrame, heuristic: DataFrame, source, target) -> DataFrame:
    """One row ``path, cost``: a cheapest path (ties: the least by nodes), pruned by ``heuristic`` (id, h: a lower bound of the cost from a node to the target).

    Relaxes whole frontiers at a time; once a path to the target is known, nodes whose cost so far and bound together
    aren't below it are left out. A node without a bound counts as 0. Bounds that are too high can cost the best path.
    """
    links = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    best = edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("cost"), F.array(F.lit(source)).alias("path"))
    frontier, reached = best, None
    while not frontier.isEmpty():
        out = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id"), (F.col("cost") + F.col("weight")).alias("cost"), F.concat("path", F.array("dst")).alias("path"))
        out = out.join(heuristic, "id", "left").withColumn("bound", F.col("cost") + F.coalesce("h", F.lit(0.0))).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b"), F.min("bound").alias("bound"))
        if reached is not None:
            out = out.where(F.col("bound") <= reached)
        known = best.select("id", F.struct("cost", "path").alias("k"))
        frontier = cut(out.join(known, "id", "left").where("k IS NULL OR b < k").select("id", "b.cost", "b.path"))
        best = cut(best.union(frontier).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b")).select("id", "b.cost", "b.path"))
        hit = best.where(F.col("id") == F.lit(target)).first()
        reached = hit["cost"] if hit else None
    return best.where(F.col("id") == F.lit(target)).select("path", "cost")


def louvain(nodes: DataFrame, edges: DataFrame, levels: int = 2, rounds: int = 4) -> DataFrame:
    """``id, community``: Louvain's levels. Communities become nodes, the edges between them are kept, until nothing joins any more."""
    labels = louvain_level(nodes, edges, rounds)
    for _ in range(levels - 1):
        of = labels.select("id", "community")
        lifted = edges.join(of.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        upper = cut(louvain_level(of.select(F.col("community").alias("id")).distinct(), lifted, rounds))
        if upper.where("id <> community").isEmpty():
            break
        labels = cut(labels.join(upper.select(F.col("id").alias("community"), F.col("community").alias("top")), "community").select("id", F.col("top").alias("community")))
    return labels


def leiden(nodes: DataFrame, edges: DataFrame, levels: int = 2, rounds: int = 4) -> DataFrame:
    """``id, community``: Louvain's communities, each parted into its connected pieces (named after their least node), which is what Leiden guarantees."""
    found = louvain(nodes, edges, levels, rounds)
    a, b = (found.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").where("c_src = c_dst").select("src", "dst")
    return connected_components(nodes.select("id"), inner).withColumnRenamed("component", "community")


def path_length(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``path_id, length``: summed weights along ``paths(path_id, path)``; null if an edge is missing."""
    steps = paths.select("path_id", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS src, path[i] AS dst))")).alias("i", "e")).select("path_id", "e.src", "e.dst")
    joined = steps.join(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), ["src", "dst"], "left")
    return joined.groupBy("path_id").agg(F.when(F.count("weight") == F.count(F.lit(1)), F.sum("weight")).alias("length"))


def closeness(nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``id, score``: reached nodes over the sum of their distances (0 if none), for all nodes or those of ``sources`` (id).

    Distances of all pairs are as many rows as nodes times reached nodes: on large graphs give a sample of sources, or a reach.
    """
    both = undirected(edges)
    reach = bfs_levels(both, (sources if sources is not None else nodes).select("id"), max_hops)
    return reach.groupBy(F.col("origin").alias("id")).agg(F.when(F.sum("hops") > 0, (F.count("id") - 1) / F.sum("hops")).otherwise(0.0).alias("score"))


def betweenness(nodes: DataFrame, edges: DataFrame, max_hops: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """``id, score``: Brandes' shares of shortest paths over unordered pairs, undirected, not normalised; paths of any length, or up to ``max_hops``.

    With ``sources`` (id) only paths from them count: the usual estimate on large graphs, where rows for all pairs are too many.

    Forward: counts of shortest paths by (origin, node), level by level. Backward: dependencies, level by level.
    """
    both = cut(undirected(edges))
    levels = [(sources if sources is not None else nodes).select(F.col("id").alias("origin"), "id", F.lit(1.0).alias("paths"))]
    seen = levels[0].select("origin", "id")
    for _ in count() if max_hops is None else range(max_hops):
        last = levels[-1]
        out = last.join(both, last["id"] == both["src"]).groupBy("origin", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = cut(out.join(seen, ["origin", "id"], "left_anti"))
        if level.isEmpty():
            break
        seen = cut(seen.union(level.select("origin", "id")))
        levels.append(level)
    flows = None
    shares = []
    for below, above in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
        here = below.withColumn("flow", F.lit(0.0)) if flows is None else below.join(flows, ["origin", "id"], "left").na.fill(0.0, ["flow"])
        shares.append(here.select("id", "flow"))
        up = here.select("origin", F.col("id").alias("src"), F.col("paths").alias("n"), "flow").join(both, "src").select("origin", F.col("dst").alias("id"), "n", "flow")
        flows = cut(above.join(up, ["origin", "id"]).groupBy("origin", "id").agg(F.sum(F.col("paths") / F.col("n") * (1 + F.col("flow"))).alias("flow")))
    if not shares:
        return nodes.select("id", F.lit(0.0).alias("score"))
    total = reduce(DataFrame.union, shares).groupBy("id").agg((F.sum("flow") / 2).alias("score"))
    return nodes.select("id").join(total, "id", "left").na.fill(0.0, ["score"])


def _alike(both: DataFrame) -> DataFrame:
    """``id, d, like, size, part``: nodes in classes of equal neighbours, named after their least id (``like``); ``part`` numbers bounded runs of the ids in order.

    Sets of neighbours are told apart by their size and 128 bits of hashes.
    """
    seen = both.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("d"), F.sum(F.xxhash64("dst").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("x"))
    classes = seen.groupBy("d", "h", "x").agg(F.min("id").alias("like"), F.count(F.lit(1)).alias("size"))
    out = seen.join(classes, ["d", "h", "x"]).select("id", "d", "like", "size").orderBy("like", "id")
    return out.withColumn("part", F.floor(F.monotonically_increasing_id() / PART_ROWS))


def link_scores(edges: DataFrame) -> DataFrame:
    """``u, v`` without an edge but with common neighbours: common, jaccard, adamic_adar (1/(d ln d)), resource, preferential.

    Nodes with equal neighbours (a hub's leaves, say) have equal scores, so scores are summed over pairs of classes of
    such nodes. Their members are spread last, from two arrays of ids for each pair of parts, dealt over as many tasks as
    the pairs around the hubs ask for: no shuffle or join holds a row for each pair of members.
    """
    both = cut(undirected(edges))
    nodes = cut(_alike(both))
    classes = nodes.where("id = like").select("like", "d", "size")
    arms = both.join(classes.select(F.col("like").alias("src"), "size"), "src").select(F.col("dst").alias("w"), F.col("src").alias("a"), "size")
    left, right = arms.join(nodes.select(F.col("id").alias("w"), F.col("d").alias("dw")), "w"), arms.select("w", F.col("a").alias("b"))
    pairs = left.join(right, "w").where("a < b OR (a = b AND size > 1)")
    common = pairs.groupBy("a", "b").agg(F.count("w").alias("common"), F.sum(F.when(F.col("dw") > 1, 1 / (F.col("dw") * F.log("dw"))).otherwise(0.0)).alias("adamic_adar"), F.sum(1 / F.col("dw")).alias("resource"))
    common = common.join(both.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    for x in ("a", "b"):
        common = common.join(classes.select(F.col("like").alias(x), F.col("d").alias(f"d{x}")), x)
    scored = common.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"), "adamic_adar", "resource", (F.col("da") * F.col("db")).alias("preferential"))
    parts = nodes.groupBy("like", "part").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    for x, k, ids in (("a", "p", "us"), ("b", "q", "vs")):
        scored = scored.join(parts.select(F.col("like").alias(x), F.col("part").alias(k), F.col("ids").alias(ids)), x)
    scored = scored.where("a <> b OR p <= q").withColumns({"twice": F.expr("a = b AND p = q"), "apart": F.expr("element_at(us, -1) < element_at(vs, 1)")})
    around = nodes.agg(F.sum(F.col("d").cast("double") * (F.col("d") - 1) / 2)).first()[0] or 0
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, ceil(around / TASK_ROWS)))
    dealt = scored.repartition(tasks, "a", "p", "b", "q")
    # The lambda keeps the outer loop out of generated code, which would hold the rows of both loops at once; the inner one is compiled.
    dealt = dealt.withColumn("x", F.explode(F.transform("us", lambda u: u))).withColumn("y", F.explode("vs")).where("NOT twice OR x < y")
    rising = F.expr("apart OR x < y")
    u, v = (F.when(rising, F.col(i)).otherwise(F.col(j)) for i, j in ("xy", "yx"))
    return dealt.select(u.alias("u"), v.alias("v"), "common", "jaccard", "adamic_adar", "resource", "preferential")


def triangles(edges: DataFrame) -> DataFrame:
    """``id, triangles``: each triangle once, found from its edges in order."""
    e = simple_pairs(edges)
    ab, bc, ac = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("src").alias("b"), F.col("dst").alias("c")), e.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    found = ab.join(bc, "b").join(ac, ["a", "c"])
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clique_communities(edges: DataFrame) -> DataFrame:
    """``id, community``: overlapping communities of triangles that share an edge (3-clique percolation)."""
    e = simple_pairs(edges)
    ab, bc, ac = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("src").alias("b"), F.col("dst").alias("c")), e.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    found = cut(ab.join(bc, "b").join(ac, ["a", "c"]).select(F.concat_ws("|", "a", "b", "c").alias("id"), "a", "b", "c"))
    sides = found.select("id", F.explode(F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))))).alias("e"))
    star = sides.groupBy("e").agg(F.min("id").alias("dst"))
    links = sides.join(star, "e").select(F.col("id").alias("src"), "dst")
    groups = connected_components(found.select("id"), links)
    members = found.join(groups, "id").select(F.explode(F.array("a", "b", "c")).alias("id"), F.col("component").alias("community"))
    return members.distinct()


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """``id, community``: synchronous steps; the most frequent label around a node, ties to the least."""
    both = cut(undirected(edges))
    labels = nodes.select("id", F.col("id").alias("community"))
    for i in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("new"))
        labels = labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"))
        if i % 2 == 1:
            labels = cut(labels)
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``modularity`` of a partition (id, community), standard form over all pairs."""
    e = simple_pairs(edges)
    both = undirected(edges)
    m = e.agg(F.count(F.lit(1)).alias("m"))
    a, b = (communities.select(F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in ("src", "dst"))
    inside = e.join(a, "src").join(b, "dst").where("c_src = c_dst").agg(F.count(F.lit(1)).alias("inside"))
    weight = both.groupBy(F.col("src").alias("id")).count().join(communities, "id").groupBy("community").agg(F.sum("count").alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.join(F.broadcast(m)).join(F.broadcast(weight)).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def louvain_level(nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """``id, community``: greedy modularity moves, nodes of alternating hash parity so that neighbours don't swap."""
    both = cut(undirected(edges))
    m2 = max(1, both.count())
    degree = cut(both.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("d")))
    labels = cut(nodes.select("id", F.col("id").alias("community")))
    for i in range(rounds):
        mine = labels.join(degree, "id", "left").na.fill(0, ["d"])
        total = mine.groupBy("community").agg(F.sum("d").alias("total"))
        ties = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.count(F.lit(1)).alias("k"))
        own = mine.select("id", F.col("community").alias("now"), "d")
        gain = ties.join(total, "community").join(own, "id").withColumn("gain", F.col("k") - F.col("d") * (F.col("total") - F.when(F.col("community") == F.col("now"), F.col("d")).otherwise(0)) / m2)
        best = gain.groupBy("id").agg(F.max_by("community", F.struct("gain", F.col("community") == F.col("now"), F.xxhash64("community"))).alias("new"))
        moves = best.where(F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2)
        labels = cut(labels.join(moves, "id", "left").select("id", F.coalesce("new", "community").alias("community")))
    return labels


def bridges(edges: DataFrame) -> DataFrame:
    """``src, dst``: edges whose removal parts a component. Each component is searched in one task (Arrow groups)."""
    import pandas as pd

    e = simple_pairs(edges)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    named = e.join(connected_components(nodes, e).withColumnRenamed("id", "src"), "src")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        around: dict = {}
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            around.setdefault(a, []).append(b)
            around.setdefault(b, []).append(a)
        order, low, out = {}, {}, []
        for root in around:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack = [(root, None, iter(around[root]))]
            while stack:
                at, parent, rest = stack[-1]
                for to in rest:
                    if to == parent:
                        continue
                    if to in order:
                        low[at] = min(low[at], order[to])
                    else:
                        order[to] = low[to] = len(order)
                        stack.append((to, at, iter(around[to])))
                        break
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[at])
                        if low[at] > order[parent]:
                            out.append((min(at, parent), max(at, parent)))
        return pd.DataFrame(out, columns=["src", "dst"])

    kind = e.schema["src"].dataType.simpleString()
    return named.groupBy("component").applyInPandas(search, f"src {kind}, dst {kind}")


def random_walks(nodes: DataFrame, edges: DataFrame, length: int = 8, walks: int = 2) -> DataFrame:
    """``id, walk, path``: uniform walks whose choices follow from a hash of node, walk and step."""
    around = undirected(edges).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    at = nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk")).withColumn("path", F.array("id")).withColumn("at", F.col("id"))
    for step in range(length - 1):
        joined = at.join(around, at["at"] == around["src"], "left")
        pick = F.expr(f"near[cast(pmod(xxhash64(id, walk, {step}), size(near)) AS int)]")
        at = joined.select("id", "walk", F.when(F.col("near").isNull(), F.col("path")).otherwise(F.concat("path", F.array(pick))).alias("path"), F.coalesce(pick, F.col("at")).alias("at"))
        if step % 3 == 2:
            at = cut(at)
    return at.select("id", "walk", "path")


def node2vec(nodes: DataFrame, edges: DataFrame, dimension: int = 16, length: int = 8, walks: int = 4) -> DataFrame:
    """``id, vector``: skip-gram vectors over the random walks."""
    from pyspark.ml.feature import Word2Vec

    paths = random_walks(nodes, edges, length, walks).select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=dimension, minCount=1, inputCol="path", outputCol="v", seed=1, maxIter=1).fit(paths)
    return model.getVectors().select(F.col("word").alias("id"), "vector")


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``code, severity, ref``: duplicate and missing ids, dangling ends, self-loops, missing types."""
    issue = lambda df, code, severity, ref: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), ref.cast("string").alias("ref"))
    key = F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string"))
    ids = nodes.select("id").distinct()
    parts = [
        issue(nodes.where("id IS NULL"), "MISSING_FIELD", "critical", F.lit("id")),
        issue(nodes.where("id IS NOT NULL").groupBy("id").count().where("count > 1"), "DUPLICATE_ID", "critical", F.col("id")),
        issue(nodes.where("type IS NULL OR type = ''"), "INVALID_TYPE", "warning", F.col("id")),
        issue(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "DANGLING_EDGE", "error", key),
        issue(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "DANGLING_EDGE", "error", key),
        issue(edges.where("src = dst"), "SELF_LOOP", "info", key),
    ]
    return reduce(DataFrame.unionByName, parts)
