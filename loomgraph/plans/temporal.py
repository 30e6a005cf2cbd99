"""Bi-temporal facts and intervals made from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import numbers
from loomgraph.operators import temporal as T
from loomgraph.plans.frames import SPANS_SQL, VISITS_SQL, spans, visits
from loomgraph.queries import query, table

AT = "2024-01-15 12:00:00"
VISITS, SPANS = f"WITH {VISITS_SQL} ", f"WITH {SPANS_SQL} "
MERGED_SQL = SPANS_SQL + """, marked AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM spans),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS MATERIALIZED (SELECT user_id, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM numbered GROUP BY user_id, island)"""


@query(VISITS + f"""SELECT user_id, type, "start" FROM visits WHERE "start" <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' < "end" """)
def point_in_time(spark, d):
    return visits(spark, d).where(T.active_at(F.col("start"), F.col("end"), F.lit(AT).cast("timestamp"))).select("user_id", "type", "start")


@query(VISITS + f"""SELECT count(*) AS n FROM visits WHERE "start" <= TIMESTAMP '{AT}' AND TIMESTAMP '{AT}' <= "end" """)
def point_in_time_closed(spark, d):
    return visits(spark, d).where(T.active_at(F.col("start"), F.col("end"), F.lit(AT).cast("timestamp"), closed=True)).agg(F.count(F.lit(1)).alias("n"))


@query(VISITS + """SELECT user_id, type, "start" FROM visits WHERE NOT ("end" < TIMESTAMP '2024-01-10' OR "start" > TIMESTAMP '2024-01-12')""")
def range_union(spark, d):
    v, lo, hi = visits(spark, d), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")
    return v.where(~T.allen(F.col("start"), F.col("end"), lo, hi).isin("before", "after")).select("user_id", "type", "start")


@query(VISITS + """SELECT user_id, type, "start" FROM visits WHERE "start" <= TIMESTAMP '2024-01-10 06:00:00' AND "end" >= TIMESTAMP '2024-01-10 07:00:00'""")
def range_intersection(spark, d):
    v, lo, hi = visits(spark, d), F.lit("2024-01-10 06:00:00").cast("timestamp"), F.lit("2024-01-10 07:00:00").cast("timestamp")
    return v.where((F.col("start") <= lo) & (F.col("end") >= hi)).select("user_id", "type", "start")


@query(VISITS + """SELECT bucket, count(*) AS n_facts, count(DISTINCT type) AS n_types FROM (SELECT type, unnest(generate_series(date_trunc('day', "start"), date_trunc('day', "end"), INTERVAL 1 DAY)) AS bucket FROM visits) GROUP BY bucket""")
def bucket_evolution(spark, d):
    return T.bucket_evolution(visits(spark, d), "day")


@query("WITH " + MERGED_SQL + " SELECT * FROM merged")
def interval_merge(spark, d):
    return T.merge_intervals(spans(spark, d), "user_id")


@query("WITH " + MERGED_SQL + """ SELECT user_id, gap_start, gap_end FROM (SELECT user_id, "end" AS gap_start, lead("start") OVER (PARTITION BY user_id ORDER BY "start") AS gap_end FROM merged) WHERE gap_end IS NOT NULL""")
def interval_gaps(spark, d):
    return T.interval_gaps(spans(spark, d), "user_id")


@query("WITH " + MERGED_SQL + """ SELECT user_id, round(least(1.0, sum(greatest(0, epoch_us(least("end", TIMESTAMP '2024-01-31')) - epoch_us(greatest("start", TIMESTAMP '2024-01-01')))) / (30 * 86400e6)), 9) AS coverage FROM merged GROUP BY user_id""")
def coverage_pct(spark, d):
    out = T.coverage(spans(spark, d), "user_id", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))
    return out.select("user_id", F.round("coverage", 9).alias("coverage"))


_ALLEN_SQL = """CASE WHEN a."end" < b."start" THEN 'before' WHEN a."start" > b."end" THEN 'after' WHEN a."end" = b."start" THEN 'meets' WHEN a."start" = b."end" THEN 'met_by'
WHEN a."start" = b."start" AND a."end" = b."end" THEN 'equals' WHEN a."start" = b."start" AND a."end" < b."end" THEN 'starts' WHEN a."start" = b."start" THEN 'started_by'
WHEN a."end" = b."end" AND a."start" > b."start" THEN 'finishes' WHEN a."end" = b."end" THEN 'finished_by' WHEN a."start" < b."start" AND a."end" < b."end" THEN 'overlaps'
WHEN a."start" > b."start" AND a."end" > b."end" THEN 'overlapped_by' WHEN a."start" > b."start" AND a."end" < b."end" THEN 'during' ELSE 'contains' END"""


@query(VISITS + f", {SPANS_SQL}, m AS (SELECT user_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\" FROM spans GROUP BY user_id) SELECT {_ALLEN_SQL} AS relation, count(*) AS n FROM visits a JOIN m b USING (user_id) GROUP BY 1")
def allen_relation_matrix(spark, d):
    m = spans(spark, d).groupBy("user_id").agg(F.min("start").alias("bs"), F.max("end").alias("be"))
    j = visits(spark, d).join(m, "user_id")
    return j.groupBy(T.allen(F.col("start"), F.col("end"), F.col("bs"), F.col("be")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + MERGED_SQL + """ SELECT a.user_id, a."start" AS l_start, b."start" AS r_start, epoch_us(least(a."end", b."end")) - epoch_us(greatest(a."start", b."start")) AS overlap_us FROM merged a JOIN (SELECT user_id, ts AS "start", ts + INTERVAL 2 HOUR AS "end" FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a."start" <= b."end" AND b."start" <= a."end" """)
def interval_overlap_join(spark, d):
    left = T.merge_intervals(spans(spark, d), "user_id").select("user_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = table(spark, d, "events").where("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", F.col("ts").alias("r_start"), (F.col("ts") + F.expr("interval 2 hours")).alias("r_end"))
    j = T.interval_join(left, right, "user_id", 6 * 3600)
    return j.select("user_id", "l_start", "r_start", (F.unix_micros(F.least("l_end", "r_end")) - F.unix_micros(F.greatest("l_start", "r_start"))).alias("overlap_us"))


@query("""SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_purchase_after_view(spark, d):
    e = table(spark, d, "events")
    seen = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return T.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "value", "last_view").select("event_id", "last_view")


@query(VISITS + """SELECT user_id, type, issue, count(*) AS n FROM (SELECT *, lag("end") OVER (PARTITION BY user_id, type ORDER BY "start", "end") AS prior FROM visits) v, LATERAL (SELECT unnest(CASE WHEN "start" < prior THEN ['overlapping_same_edge'] WHEN "start" > prior THEN ['gap_after_restart'] ELSE [] END) AS issue) GROUP BY ALL""")
def temporal_consistency(spark, d):
    v = visits(spark, d).select(F.col("user_id").alias("src"), F.lit(0).alias("dst"), "type", "start", "end")
    return T.consistency_issues(v).groupBy(F.col("src").alias("user_id"), "type", "issue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after, count(DISTINCT event_type) AS diversity FROM events GROUP BY user_id""")
def evolution_metrics(spark, d):
    cut = F.lit("2024-01-16").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("ts") < cut).alias("before"), F.count_if(F.col("ts") >= cut).alias("after"), F.count_distinct("event_type").alias("diversity"))


@query("SELECT min(ts) AS lo, max(ts) AS hi FROM events")
def temporal_bounds(spark, d):
    return table(spark, d, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query("SELECT event_id, date_trunc('hour', ts) AS lo, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS hi FROM events")
def granularity_bounds(spark, d):
    return table(spark, d, "events").select("event_id", numbers.floor_to(F.col("ts"), "hour").alias("lo"), numbers.ceil_to(F.col("ts"), "month").alias("hi"))


@query(VISITS + """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN "start" <= TIMESTAMP '2024-01-10' AND "end" >= TIMESTAMP '2024-01-10 02:00:00' THEN 'affected' WHEN "start" < TIMESTAMP '2024-01-10 02:00:00' AND TIMESTAMP '2024-01-10' < "end" THEN 'partial' ELSE 'unaffected' END AS kind FROM visits) GROUP BY kind""")
def retroactive_coverage(spark, d):
    lo, hi = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-10 02:00:00").cast("timestamp")
    return visits(spark, d).groupBy(T.retroactive(F.col("start"), F.col("end"), lo, hi).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_orderdate AS at, 'added' AS change FROM orders UNION ALL SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY, 'removed' FROM orders WHERE o_orderstatus = 'F'""")
def fact_timeline(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 30 days")).alias("valid_until"), F.lit(None).cast("timestamp").alias("superseded_at"))
    return T.timeline(o, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice, NULL::TIMESTAMP AS superseded_at FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_totalprice, TIMESTAMP '2025-01-01' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, o_totalprice * 2, NULL FROM orders WHERE o_orderstatus = 'P'""")
def apply_revision(spark, d):
    o = table(spark, d, "orders")
    facts = o.select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
    new = o.where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("2025-01-01").cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("superseded_at"))
    return T.apply_revision(facts, new, "o_orderkey").select("o_orderkey", "o_totalprice", "superseded_at")


@query(VISITS + """SELECT a.type, b.type AS next_type, count(*) AS n FROM visits a JOIN visits b ON a.user_id = b.user_id AND a."end" = b."start" WHERE a."start" < a."end" AND b."start" < b."end" GROUP BY ALL""")
def sequence_patterns(spark, d):
    v = visits(spark, d).where(F.col("start") < F.col("end"))
    nxt = v.select("user_id", F.col("start").alias("end"), F.col("type").alias("next_type"))
    return v.select("user_id", "type", "end").join(nxt, ["user_id", "end"]).groupBy("type", "next_type").agg(F.count(F.lit(1)).alias("n"))
