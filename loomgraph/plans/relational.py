"""Scans, predicates, joins, aggregations, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.temporal import snapshot_diff
from loomgraph.queries import query, table
from loomgraph.sources.predicates import dnf, metadata_filter
from loomgraph.sources.scans import integrate_seed, run_sql, scan_parquet


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE (l_quantity > 45 AND l_returnflag IN ('A', 'R')) OR (l_discount <= 0.01 AND l_linestatus <> 'O')")
def scan_predicate_dnf(spark, d):
    want = [[("l_quantity", ">", 45), ("l_returnflag", "in", ["A", "R"])], [("l_discount", "<=", 0.01), ("l_linestatus", "!=", "O")]]
    return scan_parquet(spark, f"{d}/lineitem.parquet", filters=want).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def scan_order_offset_limit(spark, d):
    return scan_parquet(spark, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"], where="o_orderstatus = 'F'", order_by=[F.desc("o_totalprice"), "o_orderkey"], offset=10, limit=50)


@query("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def adhoc_sql(spark, d):
    views = {t: table(spark, d, t) for t in ("nation", "customer")}
    return run_sql(spark, "SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > :least GROUP BY n_name", views, {"least": 0})


@query("""SELECT event_id, user_id FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
WHERE k >= 20 AND k < 80 AND k <> 50 AND event_type IN ('view', 'click') AND event_type LIKE '%i%' AND value IS NOT NULL AND value > 1""")
def metadata_filter_ops(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.where(metadata_filter([("k", "gte", 20), ("k", "lt", 80), ("k", "ne", 50), ("event_type", "in", ["view", "click"]), ("event_type", "contains", "i"), ("value", "gt", 1)])).select("event_id", "user_id")


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY ALL")
def json_field_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'view' OR event_type = 'error' GROUP BY event_type")
def metadata_or_query(spark, d):
    return table(spark, d, "events").where(dnf([[("event_type", "=", "view")], [("event_type", "=", "error")]])).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_field_values(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join_customers(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def anti_join_dangling(spark, d):
    ok = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ok, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""WITH a AS (SELECT p_name AS k, min(p_brand) AS brand, max(p_size) AS size FROM part WHERE p_retailprice < 1500 GROUP BY p_name), b AS (SELECT p_name AS k, min(p_brand) AS brand, max(p_size) AS size FROM part WHERE p_retailprice > 1000 GROUP BY p_name)
SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.brand IS DISTINCT FROM b.brand OR a.size IS DISTINCT FROM b.size THEN 'modified' END AS change,
CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(',', CASE WHEN a.brand IS DISTINCT FROM b.brand THEN 'brand' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END) ELSE '' END AS changed FROM a FULL JOIN b ON a.k = b.k) WHERE change IS NOT NULL""")
def full_outer_snapshot_diff(spark, d):
    p = table(spark, d, "part")
    snap = lambda w: p.where(w).groupBy(F.col("p_name").alias("k")).agg(F.min("p_brand").alias("brand"), F.max("p_size").alias("size"))
    return snapshot_diff(snap("p_retailprice < 1500"), snap("p_retailprice > 1000"), "k", ["brand", "size"])


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join_totals(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_discount) AS avg_disc, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY ALL")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("n_orders"),
    )


def _grouping(sets: str) -> str:
    return f"SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY {sets}"


@query(_grouping("ROLLUP (l_returnflag, l_linestatus)"))
def grouping_rollup(spark, d):
    return table(spark, d, "lineitem").rollup(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query(_grouping("CUBE (l_returnflag, l_linestatus)"))
def grouping_cube(spark, d):
    return table(spark, d, "lineitem").cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query(_grouping("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark, d):
    return run_sql(spark, "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(l_quantity) AS qty FROM li GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", {"li": table(spark, d, "lineitem")})


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS value_missing, count(*) FILTER (WHERE props IS NULL OR props = '') AS props_missing, count(*) FILTER (WHERE event_type IS NULL) AS type_missing FROM events""")
def missing_profile(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("value_missing"), F.count_if(F.col("props").isNull() | (F.col("props") == "")).alias("props_missing"), F.count_if(F.col("event_type").isNull()).alias("type_missing"))


@query("""SELECT event_id, coalesce(value, (SELECT avg(value) FROM events)) AS filled FROM events""")
def impute_mean(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("mean")))).select("event_id", F.coalesce("value", "mean").alias("filled"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def window_latest(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events")
def window_lag_gap(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))).alias("gap_us"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def running_sum(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT p_brand, p_partkey, p_retailprice, r FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r FROM part) WHERE r <= 3")
def top_parts_by_brand(spark, d):
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))
    return table(spark, d, "part").withColumn("r", F.rank().over(w)).where("r <= 3").select("p_brand", "p_partkey", "p_retailprice", "r")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def conversation_history(spark, d):
    from loomgraph.operators.retrieval import history

    return history(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, sum(length(text)) AS chars, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").where("l_quantity > 30").select("l_partkey"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_parties(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.bal, b.bal) AS bal, coalesce(a.seg, b.seg) AS seg FROM (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS bal, NULL::VARCHAR AS seg FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS bal, min(s_name) AS seg FROM supplier GROUP BY 1) b ON a.k = b.k""")
def seed_integration(spark, d):
    seed = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 4).alias("bal"), F.first(F.lit(None).cast("string")).alias("seg"))
    found = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 4).alias("bal"), F.min("s_name").alias("seg"))
    return integrate_seed(seed, found, "k", "seed_first")


@query("SELECT user_id, event_type, coalesce(sum(value), 0) AS total FROM events GROUP BY ALL")
def totals_by_user_type(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query("PIVOT (SELECT user_id, event_type FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY user_id")
def pivot_event_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_id, 'value' AS issue FROM events WHERE value IS NULL OR value < 0 UNION ALL SELECT event_id, 'type' FROM events WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') UNION ALL SELECT event_id, 'props' FROM events WHERE NOT regexp_matches(props, '^\\{.*\\}$')")
def record_validation(spark, d):
    checks = F.array_compact(F.array(
        F.when(F.col("value").isNull() | (F.col("value") < 0), F.lit("value")), F.when(~F.col("event_type").isin("view", "click", "purchase", "signup"), F.lit("type")), F.when(~F.col("props").rlike(r"^\{.*\}$"), F.lit("props")),
    ))
    return table(spark, d, "events").select("event_id", F.explode(checks).alias("issue"))
