"""Duplicates, merging and conflicts on customers, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import resolution as E
from loomgraph.queries import query, table


@query("SELECT doc_id, copy_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of FROM documents) WHERE doc_id <> copy_of")
def exact_dup_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return docs.join(first, "h").where("doc_id <> copy_of").select("doc_id", "copy_of")


_PAIRS_SQL = """k AS (SELECT DISTINCT s_suppkey AS id, lower(trim(s_name, ' ')) AS name, s_nationkey AS nation FROM supplier),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.name AS name_a, b.name AS name_b FROM k a JOIN k b ON a.nation = b.nation AND a.id < b.id)"""


def _supplier_pairs(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.col("s_nationkey")).alias("block"))
    return E.candidate_pairs(s, "id", F.col("block"), ["name"])


@query(f"WITH {_PAIRS_SQL} SELECT id_a, id_b, 1 - levenshtein(name_a, name_b) / greatest(length(name_a), length(name_b)) AS score FROM pairs WHERE 1 - levenshtein(name_a, name_b) / greatest(length(name_a), length(name_b)) >= 0.9")
def blocked_levenshtein_suppliers(spark, d):
    return _supplier_pairs(spark, d).select("id_a", "id_b", S.levenshtein_similarity(F.col("name_a"), F.col("name_b")).alias("score")).where("score >= 0.9")


@query(f"WITH {_PAIRS_SQL}, j AS (SELECT *, jaro_similarity(name_a, name_b) AS j, CASE WHEN name_a[1] <> name_b[1] THEN 0 WHEN name_a[2] <> name_b[2] THEN 1 WHEN name_a[3] <> name_b[3] THEN 2 WHEN name_a[4] <> name_b[4] THEN 3 ELSE 4 END AS p FROM pairs) SELECT id_a, id_b, round(j + 0.1 * p * (1 - j), 6) AS score FROM j")
def udf_jaro_winkler(spark, d):
    return _supplier_pairs(spark, d).select("id_a", "id_b", F.round(S.jaro_winkler(S.clean(F.col("name_a")), S.clean(F.col("name_b"))), 6).alias("score"))


@query("""WITH b AS (SELECT s_suppkey AS id, list_distinct(list_transform(generate_series(1, length(s_name) - 1), lambda i: substr(lower(s_name), i::INT, 2))) AS g, s_nationkey AS nation FROM supplier) SELECT a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS score FROM b a JOIN b ON a.nation = b.nation AND a.id < b.id""")
def bigram_similarity(spark, d):
    return _supplier_pairs(spark, d).select("id_a", "id_b", F.round(S.bigram_similarity(F.col("name_a"), F.col("name_b")), 6).alias("score"))


@query(f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT id_a AS a, id_b AS b FROM pairs WHERE 1 - levenshtein(name_a, name_b) / greatest(length(name_a), length(name_b)) >= 0.9), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS id, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.id), g AS (SELECT id, min(label) AS grp FROM r GROUP BY id) SELECT id, grp AS "group", count(*) OVER (PARTITION BY grp) AS size FROM g""")
def dup_clusters(spark, d):
    pairs = blocked_levenshtein_suppliers(spark, d).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return E.duplicate_groups(table(spark, d, "supplier"), "id", pairs)


_COUNTED = """SELECT *, count(*) OVER (PARTITION BY p_name) AS merged FROM part"""


@query(f"SELECT p_name, p_brand, p_type, p_size, merged FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM ({_COUNTED})) WHERE r = 1")
def merge_most_complete(spark, d):
    return E.merge_records(table(spark, d, "part"), "p_name", "p_partkey", ["p_brand", "p_type", "p_size"])


@query(f"SELECT p_name, p_brand, p_type, p_size, merged FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS r FROM ({_COUNTED})) WHERE r = 1")
def merge_keep_last(spark, d):
    return E.merge_records(table(spark, d, "part"), "p_name", "p_partkey", ["p_brand", "p_type", "p_size"], "keep_last")


@query("SELECT p_name, arg_min(p_brand, p_partkey) AS p_brand, arg_min(p_size, p_partkey) AS p_size, count(*) AS merged FROM part GROUP BY p_name")
def merge_all_fields(spark, d):
    return E.merge_records(table(spark, d, "part"), "p_name", "p_partkey", ["p_brand", "p_size"], "merge_all")


@query("SELECT p_partkey, p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part) WHERE r > 1")
def record_duplicates(spark, d):
    return E.exact_duplicates(table(spark, d, "part"), ["p_brand", "p_type"], "p_partkey").select("p_partkey", "p_brand", "p_type")


FACTS_SQL = """facts AS (SELECT o_custkey AS entity, 'priority' AS property, o_orderpriority AS value, o_orderkey AS pos, o_orderdate AS ts, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 0.6 END AS confidence, CASE o_orderstatus WHEN 'F' THEN 0.9 WHEN 'O' THEN 0.7 ELSE 0.4 END AS credibility FROM orders)"""


def _facts(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("entity"), F.lit("priority").alias("property"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("pos"), F.col("o_orderdate").alias("ts"),
        F.when(F.col("o_orderstatus") != "P", 0.6).alias("confidence"), F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.4).alias("credibility"),
    )


@query(f"WITH {FACTS_SQL} SELECT entity, property, count(*) AS n_records, count(DISTINCT value) AS n_values, list_sort(list(DISTINCT value)) AS values FROM facts GROUP BY entity, property HAVING count(*) > 1 AND count(DISTINCT value) > 1")
def conflict_detect(spark, d):
    return E.value_conflicts(_facts(spark, d))


@query(f"WITH {FACTS_SQL}, v AS (SELECT entity, property, value, count(*) AS n, min(pos) AS pos FROM facts GROUP BY ALL) SELECT entity, property, arg_min(value, (-n, pos)) AS value, max(n) / sum(n) AS confidence FROM v GROUP BY entity, property")
def conflict_vote(spark, d):
    return E.resolve_by_voting(_facts(spark, d))


@query(f"WITH {FACTS_SQL}, v AS (SELECT entity, property, value, sum(coalesce(confidence, 0.5)::DOUBLE * credibility::DOUBLE) AS w, min(pos) AS pos FROM facts GROUP BY entity, property, value) SELECT entity, property, arg_min(value, (-round(w, 9), pos)) AS value, round(max(w) / sum(w), 6) AS confidence FROM v GROUP BY entity, property")
def conflict_credibility(spark, d):
    return E.resolve_by_credibility(_facts(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {FACTS_SQL} SELECT entity, property, value FROM (SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY ts DESC, pos) AS r FROM facts) WHERE r = 1")
def conflict_recency(spark, d):
    return E.resolve_by(_facts(spark, d), "ts")


@query(f"WITH {FACTS_SQL}, c AS (SELECT entity, count(DISTINCT value) AS n FROM facts GROUP BY entity HAVING count(DISTINCT value) > 1) SELECT CASE WHEN n > 5 THEN 'critical' WHEN n > 3 THEN 'high' WHEN n > 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM c GROUP BY 1")
def conflict_severity(spark, d):
    return E.value_conflicts(_facts(spark, d)).groupBy(E.severity(F.col("n_values")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACTS_SQL} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, count(*) - lag(count(*)) OVER (ORDER BY strftime(ts, '%Y-%m')) AS delta FROM facts WHERE value = '1-URGENT' GROUP BY 1")
def conflict_trend(spark, d):
    from pyspark.sql import Window as W

    m = _facts(spark, d).where("value = '1-URGENT'").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("delta", F.col("n") - F.lag("n").over(W.orderBy("month")))
