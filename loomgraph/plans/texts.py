"""Text, number and date scalars, chunking and extraction over documents, pages and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import chunking, extraction, records, retrieval
from loomgraph.queries import query, table


@query(r"""SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\t', ' ', 'g'), '\r\n?', chr(10), 'g'), ' +', ' ', 'g'), '\n[ \n]*\n', chr(10) || chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '')) AS norm FROM documents""")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(text.normalize_whitespace(F.col("text"))).alias("norm"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[\t\n\r]+', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS digest FROM documents""")
def text_flat_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.flat_whitespace(F.col("text")), 256).alias("digest"))


@query("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def diacritics_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_diacritics("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, nfc_normalize(text) = text AS is_nfc FROM documents")
def unicode_nfc(spark, d):
    return table(spark, d, "documents").select("doc_id", (text.unicode_normalize("NFC")("text") == F.col("text")).alias("is_nfc"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ') AS body FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.remove_html(F.col("html")).alias("body"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), ' '), '') AS title, len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1, 'i')) AS links FROM pages""")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.size(text.html_links(F.col("html"))).cast("long").alias("links"))


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), chr(10)) AS body FROM documents""")
def drop_empty_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.drop_empty_lines(F.col("text")).alias("body"))


@query(r"""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') AS body FROM documents""")
def mask_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", text.pii_free(F.col("text")).alias("body"))


def _language_sql() -> str:
    parts = {g: f"len(list_filter(t, lambda w: w IN ({', '.join(repr(x) for x in w)})))" for g, w in text.STOPWORDS.items()}
    cols = ", ".join(f"{p} AS {g}" for g, p in parts.items())
    return f"SELECT doc_id, CASE WHEN n < 10 OR greatest({', '.join(parts)}) = 0 THEN 'en' " + " ".join(f"WHEN {g} = greatest({', '.join(parts)}) THEN '{g}'" for g in parts) + f" END AS found FROM (SELECT doc_id, length(trim(text, ' ')) AS n, {cols} FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS t FROM documents))"


@query(_language_sql())
def stopword_language(spark, d):
    return table(spark, d, "documents").select("doc_id", text.detect_language(F.col("text")).alias("found"))


@query("""SELECT doc_id, i // 400 AS idx, i AS "start", least(i + 500, length(text)) AS "end", substr(text, i + 1, 500) AS chunk FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 101), 400)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(chunking.fixed_chunks(F.col("text"), 500, 100)).alias("c"))
    return c.select("doc_id", "c.idx", "c.start", "c.end", F.col("c.text").alias("chunk"))


@query(r"""SELECT doc_id, i // 80 AS idx, array_to_string(w[i + 1 : i + 100], ' ') AS chunk FROM (SELECT doc_id, w, unnest(generate_series(0, greatest(0, len(w) - 21), 80)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""")
def chunk_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(chunking.word_chunks(F.col("text"), 100, 20)).alias("c")).select("doc_id", "c.idx", F.col("c.text").alias("chunk"))


@query(r"""SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents))""")
def chunk_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "sentence"))


@query()
def chunk_packed_sentences(spark, d):
    parts = chunking.pack_parts(chunking.sentences(F.col("text")), 400)
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "chunk"))


@query(r"""SELECT doc_id, line - 1 AS line, kind, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM (SELECT doc_id, line, CASE WHEN trim(x, ' ') = '' THEN 'blank' WHEN regexp_matches(x, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(x, '^\s*([-*+]|\d+\.) ') THEN 'list' WHEN contains(x, '|') THEN 'table' WHEN starts_with(x, '```') THEN 'fence' ELSE 'paragraph' END AS kind
FROM (SELECT doc_id, line, l[line] AS x FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))""")
def structural_blocks(spark, d):
    return chunking.structural_blocks(table(spark, d, "documents"), "doc_id", "text")


def _entities_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS text FROM documents" for k, p in extraction.PATTERNS.items())


@query(_entities_sql())
def entities_regex(spark, d):
    return extraction.entities(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT page_id, word AS text, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '\b[A-Z][a-z]{2,}')) AS word FROM pages) GROUP BY ALL")
def entities_capitalized(spark, d):
    return extraction.capitalized(table(spark, d, "pages"), "page_id", "html")


@query(r"""WITH m AS (SELECT conv_id, turn, pos, w[pos] AS text FROM (SELECT conv_id, turn, w, unnest(generate_series(1, len(w))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM conversations)))
SELECT conv_id, a, b, count(*) AS n FROM (SELECT DISTINCT x.conv_id, x.turn, x.text AS a, y.text AS b FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.pos < y.pos AND y.pos - x.pos <= 5 AND x.text <> y.text) GROUP BY ALL""")
def cooccurrence_relations(spark, d):
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Z][a-z]+"), F.lit(0))
    m = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words).alias("pos", "text")).withColumn("doc", F.struct("conv_id", "turn"))
    spans = m.select("doc", "text", F.col("pos").alias("start"), F.col("pos").alias("end"))
    pairs = extraction.cooccurrences(spans, "doc", within=6)
    return pairs.groupBy("doc.conv_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT token, count(*) AS docs, sum(n) AS n FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY ALL) GROUP BY token")
def inverted_index_terms(spark, d):
    i = retrieval.inverted_index(table(spark, d, "documents"), "doc_id", "text")
    return i.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))


@query("SELECT doc_id, (contains(lower(text), 'license')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'email')::INT) / 3 AS score FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'the') OR contains(lower(text), 'email')")
def keyword_search(spark, d):
    return retrieval.keyword_search(table(spark, d, "documents"), ["license", "the", "email"]).select("doc_id", "score")


@query(r"SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[A-Za-z0-9]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS cls FROM customer")
def naming_conventions(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.class_name(F.col("c_name")).alias("cls"))


@query()
def eval_rouge(spark, d):
    t = table(spark, d, "conversations")
    a, b = t.where("turn % 2 = 0"), t.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(records.unigram_f1(F.col("text"), F.col("other")), 9).alias("f1"))


@query(r"SELECT doc_id, kind, position FROM (SELECT doc_id, position - 1 AS position, CASE WHEN regexp_matches(x, 'acquir|merge') THEN 'acquisition' WHEN regexp_matches(x, 'partner') THEN 'partnership' WHEN regexp_matches(x, 'launch|releas') THEN 'launch' WHEN regexp_matches(x, 'invest|fund') THEN 'investment' WHEN regexp_matches(x, 'lawsuit|sued|court') THEN 'legal' END AS kind FROM (SELECT doc_id, position, w[position] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS position FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\s+') AS w FROM documents)))) WHERE kind IS NOT NULL")
def event_triggers(spark, d):
    return extraction.events(table(spark, d, "documents"), "doc_id", "text")
