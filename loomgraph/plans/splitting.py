"""Chunkers on the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import chunking, extraction
from loomgraph.queries import query, table


def _last(sep: str, w: str) -> str:
    """Where the last ``sep`` of a text ends, 0 if it has none."""
    s = "'" + sep + "'" if sep.strip() or sep == " " else " || ".join(["chr(10)"] * len(sep))
    back = s if len(sep) == 1 or not sep.strip() else "'" + sep[::-1] + "'"
    return f"(CASE WHEN contains({w}, {s}) THEN length({w}) - (instr(array_to_string(list_reverse(regexp_extract_all({w}, '(?s).')), ''), {back}) - 1) ELSE 0 END)"


def _recursive_sql(size: int, overlap: int) -> str:
    half = size // 2
    w = f"substr(text, s + {half} + 1, {size - half})"
    cut = "coalesce(" + ", ".join(f"nullif({_last(x, 'w')}, 0)" for x in ("\n\n", "\n", ". ", " ")) + f", {size - half})"
    stop = f"CASE WHEN s + {size} >= n THEN n ELSE s + {half} + {cut} END"
    step = f"SELECT doc_id, idx, s, {stop} AS e, n FROM (SELECT d.doc_id, idx, s, n, {w} AS w FROM ({{}}) x JOIN documents d ON d.doc_id = x.doc_id)"
    first = step.format("SELECT doc_id, 0 AS idx, 0::BIGINT AS s, length(text) AS n FROM documents WHERE length(text) > 0")
    later = step.format(f"SELECT doc_id, idx + 1 AS idx, greatest(s + 1, e - {overlap}) AS s, n FROM c WHERE e < n")
    return f'WITH RECURSIVE c(doc_id, idx, s, e, n) AS ({first} UNION ALL {later}) SELECT doc_id, idx, s AS "start", e AS "end" FROM c'


@query(_recursive_sql(600, 50))
def chunk_recursive(spark, d):
    chunk = chunking.recursive_chunks(600, 50)
    return table(spark, d, "documents").select("doc_id", F.explode(chunk("text")).alias("c")).select("doc_id", "c.idx", "c.start", "c.end")


@query(r"""SELECT doc_id, i // 120 AS idx, least(150, len(t) - i) AS n, array_to_string(t[i + 1 : i + 150], ' ') AS chunk FROM (SELECT doc_id, t, unnest(generate_series(0, greatest(0, len(t) - 31), 120)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS t FROM documents) WHERE len(t) > 0)""")
def chunk_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(chunking.token_chunks(F.col("text"), 150, 30)).alias("c")).select("doc_id", "c.idx", "c.n", F.col("c.text").alias("chunk"))


@query(r"""SELECT doc_id, pos - 1 AS pos, p[pos] AS paragraph FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents))""")
def chunk_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query(r"""WITH s AS (SELECT doc_id, section, x[section] AS t FROM (SELECT doc_id, x, unnest(generate_series(1, len(x))) AS section FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(^|\n)(#{1,6} )', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda v: trim(v, ' ') <> '') AS x FROM documents))),
p AS (SELECT doc_id, section, paragraph, x[paragraph] AS t FROM (SELECT doc_id, section, x, unnest(generate_series(1, len(x))) AS paragraph FROM (SELECT doc_id, section, list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda v: trim(v, ' ')), lambda v: v <> '') AS x FROM s)))
SELECT doc_id, section - 1 AS section, paragraph - 1 AS paragraph, sentence - 1 AS sentence, x[sentence] AS text FROM (SELECT doc_id, section, paragraph, x, unnest(generate_series(1, len(x))) AS sentence FROM (SELECT doc_id, section, paragraph, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v, ' ')), lambda v: v <> '') AS x FROM p))""")
def chunk_hierarchical(spark, d):
    return chunking.hierarchical_chunks(table(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH e AS (SELECT doc_id, x.s AS s, x.s + length(x.m) AS e FROM (SELECT doc_id, unnest(list_zip(list_transform(generate_series(1, len(parts)), lambda i: coalesce(list_sum(list_transform(parts[1 : i], lambda v: length(v))), 0) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda v: length(v))), 0)), m)) AS x0 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Za-z]+') AS m, regexp_split_to_array(text, '[A-Z][a-z]+ [A-Za-z]+') AS parts FROM documents)), LATERAL (SELECT {'s': x0[1]::BIGINT, 'm': x0[2]} AS x) WHERE x0[2] IS NOT NULL),
b AS (SELECT doc_id, unnest(generate_series(0, length(text), 200)) AS k, length(text) AS n FROM documents),
m AS (SELECT DISTINCT b.doc_id, least(coalesce(max(e.e), b.k), b.n) AS k FROM b LEFT JOIN e ON e.doc_id = b.doc_id AND e.s < b.k AND b.k < e.e GROUP BY b.doc_id, b.k, b.n),
c AS (SELECT doc_id, k AS s, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, s AS "start", coalesce(e, length(text)) AS "end", substr(text, s + 1, coalesce(e, length(text)) - s) AS chunk FROM c JOIN documents USING (doc_id) WHERE s < coalesce(e, length(text))""")
def chunk_entity_safe(spark, d):
    docs = table(spark, d, "documents")
    spans = extraction.spans(docs, "doc_id", "text", r"[A-Z][a-z]+ [A-Za-z]+")
    return chunking.span_safe_chunks(docs, spans, "doc_id", "text", 200).withColumnRenamed("text", "chunk")


_SENTENCES = r"""s AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, pos - 1 AS sentence, x[pos] AS t FROM (SELECT conv_id, turn, x, unnest(generate_series(1, len(x))) AS pos FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: trim(v, ' ')), lambda v: v <> '') AS x FROM conversations)))"""


@query(rf"""WITH {_SENTENCES}, w AS (SELECT id, sentence, list_distinct(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda v: v <> '')) AS w FROM s), p AS (SELECT id, sentence, w, lag(w) OVER o AS b FROM w WINDOW o AS (PARTITION BY id ORDER BY sentence))
SELECT id, sentence, sum(CASE WHEN b IS NULL THEN 0 WHEN len(list_distinct(list_concat(w, b))) = 0 THEN 1 WHEN len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))) < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY sentence) AS chunk FROM p""")
def chunk_semantic(spark, d):
    c = table(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return chunking.semantic_breaks(c, "id", "text", 0.1)


@query("""SELECT doc_id, i // 400 AS idx, lag(i // 400) OVER w AS previous, lead(i // 400) OVER w AS following FROM (SELECT doc_id, unnest(generate_series(0, greatest(0, length(text) - 101), 400)) AS i FROM documents WHERE length(text) > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def chunk_neighbors(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(chunking.fixed_chunks(F.col("text"), 500, 100)).alias("c")).select("doc_id", "c.idx")
    return chunking.adjacent_chunks(c, "doc_id", "idx")


@query("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS chunk FROM part")
def table_row_groups(spark, d):
    return chunking.table_chunks(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 7)
