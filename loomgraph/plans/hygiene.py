"""Encodings, cleaning, types, mail, tracked values, translated values, causal edges and gates over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators import hygiene as H
from loomgraph.plans.frames import decisions
from loomgraph.queries import query, table


@query("""SELECT doc_id, ['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE'][doc_id % 4 + 1] AS encoding, doc_id % 4 <> 0 AS marked, sha256(text) AS digest FROM documents WHERE text IS NOT NULL""")
def encoding_detect(spark, d):
    docs, text = table(spark, d, "documents").where("text IS NOT NULL"), F.col("text")
    mark = lambda x: F.unhex(F.lit(x))
    forms = [F.encode(text, "UTF-8"), F.concat(mark("EFBBBF"), F.encode(text, "UTF-8")), F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")), F.concat(mark("FEFF"), F.encode(text, "UTF-16BE"))]
    data = F.when(F.col("doc_id") % 4 == 0, forms[0]).when(F.col("doc_id") % 4 == 1, forms[1]).when(F.col("doc_id") % 4 == 2, forms[2]).otherwise(forms[3])
    return docs.select("doc_id", H.decode(data).alias("x")).select("doc_id", "x.encoding", "x.marked", F.sha2("x.text", 256).alias("digest"))


@query("""SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 AND trim(text) <> ''""")
def clean_pipeline(spark, d):
    return H.clean(table(spark, d, "documents"), "text", ["doc_id", "text"], {"lang": "und", "source": "unknown"}, "doc_id").select("doc_id", "lang", "source")


@query("""SELECT unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'large']) AS field, unnest(['integer', 'string', 'double', 'timestamp', 'boolean']) AS type, (SELECT count(*) FROM orders) AS n, 0 AS nulls""")
def column_types(spark, d):
    o = table(spark, d, "orders")
    texts = [F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")]
    return H.column_types(o.select(*texts, (F.col("o_totalprice") > 100000).cast("string").alias("large")))


@query("""SELECT 'conversation ' || conv_id AS thread, count(*) AS n, count(DISTINCT role) AS n_senders, count(*) FILTER (WHERE turn % 2 = 1) AS n_replies FROM conversations GROUP BY conv_id""")
def mail_threads(spark, d):
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL")
    reply = F.col("turn") % 2 == 1
    raw = F.concat(
        F.lit("From: "), F.coalesce("role", F.lit("")), F.lit("\nSubject: "), F.when(reply, "Re: RE: ").otherwise(""), F.lit("Conversation "), F.col("conv_id").cast("string"),
        F.when(reply, F.concat(F.lit("\nIn-Reply-To: <"), F.col("conv_id").cast("string"), F.lit(">"))).otherwise(""), F.lit("\n\n"), F.coalesce("text", F.lit("")),
    )
    return H.mail_threads(H.parse_mail(c.select(raw.alias("raw"))))


_TRACED = """traced AS MATERIALIZED (SELECT l_partkey AS entity, 'price' AS property, count(DISTINCT l_extendedprice) AS n_values, count(DISTINCT l_suppkey) AS n_sources, first(l_suppkey ORDER BY l_shipdate, l_suppkey) AS first_source, last(l_suppkey ORDER BY l_shipdate, l_suppkey) AS last_source FROM lineitem GROUP BY l_partkey)"""


def _traced(spark, d):
    line = table(spark, d, "lineitem")
    return H.value_sources(line.select(F.col("l_partkey").alias("entity"), F.lit("price").alias("property"), F.col("l_extendedprice").alias("value"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("at")))


@query(f"WITH {_TRACED} SELECT * FROM traced")
def value_sources(spark, d):
    return _traced(spark, d)


@query(f"""WITH {_TRACED} SELECT entity, property, unnest(range(1, len(s) + 1)) AS step, unnest(s) AS action FROM (SELECT entity, property, list_filter(['Compare the ' || n_values || ' values of price from ' || n_sources || ' sources', 'Check the first source ' || first_source, CASE WHEN last_source <> first_source THEN 'Check the last source ' || last_source END], lambda x: x IS NOT NULL) AS s FROM traced WHERE n_values > 1)""")
def investigation_guides(spark, d):
    return H.guides(_traced(spark, d))


@query("""SELECT p_partkey AS entity, layer, ['retail', 'wholesale', 'landed'][layer + 1] AS property, round(p_retailprice::DOUBLE * [1.0, 0.8, 0.88][layer + 1], 4) AS value, [NULL, 'margin', 'freight'][layer + 1] AS axiom FROM part, range(0, 3) t(layer)""")
def bridge_axioms(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.lit("retail").alias("property"), F.col("p_retailprice").alias("value"))
    return H.translate(p, [("margin", "wholesale", 0.8), ("freight", "landed", 1.1)]).withColumn("value", F.round("value", 4))


@query("""SELECT o_orderkey AS src, nxt AS dst, ['CAUSED', 'INFLUENCED', 'PRECEDENT_FOR'][o_orderkey % 4 + 1] AS type FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL AND o_orderkey % 4 < 3""")
def causal_edges(spark, d):
    o = table(spark, d, "orders")
    kinds = F.element_at(F.array(F.lit("causes"), F.lit(" Influences "), F.lit("PRECEDES"), F.lit("near")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    edges = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("dst"), kinds.alias("type"))
    return H.causal_edges(edges.where("dst IS NOT NULL"), o.select(F.col("o_orderkey").alias("id"))).select("src", "dst", "type")


@query("""WITH p AS (SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, a.p_type AS a_type, b.p_type AS b_type, lower(trim(a.p_name)) AS an, lower(trim(b.p_name)) AS bn FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 25 OR a.p_brand = b.p_brand AND b.p_partkey = a.p_partkey + 1),
w AS (SELECT *, list_filter(regexp_split_to_array(an, '[\\s_-]+'), lambda x: len(x) > 2) AS aw, list_filter(regexp_split_to_array(bn, '[\\s_-]+'), lambda x: len(x) > 2) AS bw FROM p)
SELECT a_key, b_key, CASE WHEN a_type <> b_type THEN 'type' WHEN least(len(an), len(bn)) < 0.3 * greatest(len(an), len(bn)) THEN 'length' WHEN len(aw) > 0 AND len(bw) > 0 AND NOT list_has_any(aw, bw) THEN 'words' END AS reason FROM w""")
def prefilter_gates(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_partkey").alias("a_key"), "p_brand", F.col("p_type").alias("at"), F.col("p_name").alias("an"), F.explode(F.array(F.col("p_partkey") + 25, F.col("p_partkey") + 1)).alias("b_key"))
    b = part.select(F.col("p_partkey").alias("b_key"), "p_brand", F.col("p_type").alias("bt"), F.col("p_name").alias("bn"))
    pairs = a.join(b, ["p_brand", "b_key"])
    return pairs.select("a_key", "b_key", H.gate(F.col("at"), F.col("an"), F.col("bt"), F.col("bn"), shared_word=True).alias("reason"))


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_orderpriority AS category, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_final, round(avg(least(1.0, o_totalprice / 500000.0)), 6) AS confidence FROM orders GROUP BY ALL""")
def decision_periods(spark, d):
    by = decisions(spark, d).groupBy(F.date_trunc("month", "ts").alias("period"), "category")
    return by.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "F").alias("n_final"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""SELECT doc_id, count(*) AS n_words FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY doc_id""")
def table_function_words(spark, d):
    """A SQL table function, one text to many rows, in a lateral join."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loomgraph_words(t STRING) RETURNS TABLE(word STRING) RETURN SELECT explode(regexp_extract_all(t, '[A-Za-z]+', 0))")
    return spark.sql("SELECT doc_id, count(*) AS n_words FROM {docs} d, LATERAL loomgraph_words(d.text) GROUP BY doc_id", docs=table(spark, d, "documents"))
