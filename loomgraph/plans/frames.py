"""The graphs, facts and decisions that queries build from the standard tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.queries import table


def place_graph(spark: SparkSession, d: str) -> Graph:
    """Customers, nations and regions; a customer LIVES_IN a nation, a nation is PART_OF a region."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        region.select(key("r", "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name"))
        .unionByName(nation.select(key("n", "n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name")))
        .unionByName(customer.select(key("c", "c_custkey").alias("id"), F.lit("Customer").alias("type"), F.col("c_name").alias("name")))
    )
    edges = customer.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("type"), F.lit(0.5).alias("weight")).unionByName(
        nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"), F.lit(0.8).alias("weight"))
    )
    return Graph(nodes, edges)


PLACE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS id, 'Region' AS type, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer', c_name FROM customer),
edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'LIVES_IN' AS type, 0.5::DOUBLE AS weight FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', 0.8::DOUBLE FROM nation),
und AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"""


def trade_graph(spark: SparkSession, d: str) -> Graph:
    """Nations; an edge from a supplier's nation to a customer's where the revenue between them is above the mean."""
    line, orders, customer, supplier, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    sold = (
        line.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", F.col("c_nationkey").alias("dst")), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", F.col("s_nationkey").alias("src")), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("src", "dst").agg(F.sum("r").alias("revenue"))
    )
    edges = sold.withColumn("mean", F.avg("revenue").over(W.partitionBy(F.lit(1)))).where("revenue > mean AND src <> dst")
    edges = edges.select("src", "dst", F.lit("SELLS_TO").alias("type"), F.round(1e6 / F.col("revenue"), 6).alias("weight"))
    return Graph(nation.select(F.col("n_nationkey").alias("id"), F.lit("Nation").alias("type"), F.col("n_name").alias("name")), edges)


TRADE_SQL = """sold AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
edges AS MATERIALIZED (SELECT src, dst, round(1e6 / revenue, 6) AS weight FROM sold WHERE revenue > (SELECT avg(revenue) FROM sold) AND src <> dst),
nodes AS (SELECT n_nationkey AS id FROM nation),
und AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    """Facts ``user_id, type, start, end``: an event of a user holds until the user's next one (the last is left out)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.col("event_type").alias("type"), F.col("ts").alias("start"), F.lead("ts").over(w).alias("end")).where("end IS NOT NULL")


VISITS_SQL = """visits AS MATERIALIZED (SELECT * FROM (SELECT user_id, event_type AS type, ts AS "start", lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "end" FROM events) WHERE "end" IS NOT NULL)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Intervals ``user_id, start, end``: a purchase occupies a user for ``value`` minutes."""
    e = table(spark, d, "events").where("event_type = 'purchase' AND value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    minutes = F.floor(F.abs("value")).cast("long")
    return e.select("user_id", F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000).alias("end"))


SPANS_SQL = """spans AS MATERIALIZED (SELECT user_id, ts AS "start", ts + to_minutes(floor(abs(value))::BIGINT) AS "end" FROM events WHERE event_type = 'purchase' AND value IS NOT NULL)"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions: category by priority, outcome by status, confidence by price."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("decision_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("outcome"), F.col("o_custkey").alias("maker"), F.col("o_orderdate").alias("ts"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000.0).alias("confidence"), F.concat_ws(" ", F.lit("order of customer"), F.pmod("o_custkey", F.lit(7)).cast("string"), F.lower("o_orderpriority")).alias("scenario"),
    )


DECISIONS_SQL = """decisions AS (SELECT o_orderkey AS decision_id, o_orderpriority AS category, o_orderstatus AS outcome, o_custkey AS maker, o_orderdate AS ts, least(1.0, o_totalprice / 500000.0) AS confidence, 'order of customer ' || (o_custkey % 7) || ' ' || lower(o_orderpriority) AS scenario FROM orders)"""


def near_graph(spark: SparkSession, d: str) -> Graph:
    """Customers, each tied to the next one of its nation (in blocks of 1000 keys) and to the next richer one of its class of keys: a sparse graph with cycles that grows with the table."""
    c = table(spark, d, "customer")
    own = W.partitionBy("c_nationkey", F.floor(F.col("c_custkey") / 1000)).orderBy("c_custkey")
    means = W.partitionBy(F.col("c_custkey") % 37).orderBy("c_acctbal", "c_custkey")
    parts = [c.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst"), F.lit(kind).alias("type"), F.round(1 + F.abs(F.lead("c_acctbal").over(w) - F.col("c_acctbal")) / 1000, 3).alias("weight")) for kind, w in (("NEXT", own), ("RICHER", means))]
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"))
    return Graph(nodes, parts[0].unionByName(parts[1]).where("dst IS NOT NULL"))


NEAR_SQL = """nodes AS (SELECT c_custkey AS id, c_mktsegment AS type, c_name AS name FROM customer),
edges AS MATERIALIZED (SELECT src, dst, type, round(1 + abs(b - a) / 1000, 3) AS weight FROM (SELECT c_custkey AS src, 'NEXT' AS type, c_acctbal AS a, lead(c_custkey) OVER w AS dst, lead(c_acctbal) OVER w AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey)
UNION ALL SELECT c_custkey, 'RICHER', c_acctbal, lead(c_custkey) OVER w, lead(c_acctbal) OVER w FROM customer WINDOW w AS (PARTITION BY c_custkey % 37 ORDER BY c_acctbal, c_custkey)) WHERE dst IS NOT NULL),
und AS MATERIALIZED (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)"""


def handoffs(spark: SparkSession, d: str) -> DataFrame:
    """Temporal edges: the user of an event to the user of the day's next event of its type, from the one's time to the other's."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = W.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"), F.col("event_type").alias("type"), F.col("ts").alias("start"), F.lead("ts").over(w).alias("end")).where("dst IS NOT NULL")


HANDOFFS_SQL = """handoffs AS MATERIALIZED (SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER w AS dst, event_type AS type, ts AS "start", lead(ts) OVER w AS "end" FROM events WINDOW w AS (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id)) WHERE dst IS NOT NULL)"""
