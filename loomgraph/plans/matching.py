"""Record matching, conflicts and scalars over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import numbers, similarity, text
from loomgraph.operators import extraction, matching, resolution
from loomgraph.queries import query, table

_PAIRS = "pairs AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_name AS na, b.s_name AS nb, a.s_nationkey AS ka, b.s_nationkey AS kb, a.s_acctbal AS xa, b.s_acctbal AS xb FROM supplier a JOIN supplier b ON a.s_suppkey // 8 = b.s_suppkey // 8 AND a.s_suppkey < b.s_suppkey)"
_LEV = "(1 - levenshtein(lower(trim({0})), lower(trim({1}))) / greatest(length(trim({0})), length(trim({1}))))"


def _pairs(spark, d):
    s = table(spark, d, "supplier").withColumn("block", F.floor(F.col("s_suppkey") / 8))
    side = lambda x: s.select("block", F.col("s_suppkey").alias(x), F.col("s_name").alias(f"n{x}"), F.col("s_nationkey").alias(f"k{x}"), F.col("s_acctbal").alias(f"x{x}"))
    return side("a").join(side("b"), "block").where("a < b")


@query(f"WITH {_PAIRS} SELECT a, b, {_LEV.format('na', 'nb')} AS levenshtein, (na = nb)::INT::DOUBLE AS exact FROM pairs")
def string_similarities(spark, d):
    a, b = F.col("na"), F.col("nb")
    return _pairs(spark, d).select("a", "b", matching.string_similarity(a, b).alias("levenshtein"), matching.string_similarity(a, b, "exact").alias("exact"))


@query(f"WITH {_PAIRS} SELECT a, b, ({_LEV.format('na', 'nb')} * (na <> nb)::INT + (na = nb)::INT + CASE WHEN ka = kb THEN 1 ELSE {_LEV.format('ka::VARCHAR', 'kb::VARCHAR')} END + CASE WHEN (xa > 0) <> (xb > 0) THEN 0.5 WHEN xa > 0 THEN 1 ELSE 0 END) / (2 + (xa > 0 OR xb > 0)::INT) AS score FROM pairs")
def property_similarities(spark, d):
    def props(x: str):
        base = F.create_map(F.lit("name"), F.col(f"n{x}"), F.lit("nation"), F.col(f"k{x}").cast("string"))
        return F.when(F.col(f"x{x}") > 0, F.map_concat(base, F.create_map(F.lit("solvent"), F.lit("yes")))).otherwise(base)

    return _pairs(spark, d).select("a", "b", matching.property_similarity(props("a"), props("b")).alias("score"))


_BOUGHT = "bought AS (SELECT l_orderkey AS o, list_sort(list_distinct(list(l_partkey % 20))) AS parts FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_BOUGHT} SELECT a.o AS a, b.o AS b, len(list_intersect(a.parts, b.parts)) / len(list_distinct(list_concat(a.parts, b.parts))) AS score FROM bought a JOIN bought b ON b.o = a.o + 1")
def relationship_similarities(spark, d):
    bought = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.collect_set(F.col("l_partkey") % 20).alias("x"))
    other = bought.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    return bought.join(other, "a").select("a", "b", matching.relationship_similarity(F.col("x"), F.col("y")).alias("score"))


@query(f"WITH {_PAIRS} SELECT a, b, CASE WHEN ka <> kb THEN 0.0 ELSE least(1.0, {_LEV.format('na', 'nb')} + 0.1 * (na = nb)::INT + 0.05 * (round(xa / 1000) = round(xb / 1000))::INT + 0.05) END AS confidence FROM pairs WHERE least(length(na), length(nb)) >= 0.3 * greatest(length(na), length(nb))")
def duplicate_confidence(spark, d):
    p = _pairs(spark, d).where(matching.passes_gates(F.col("na"), F.col("nb")))
    equal = (F.round(F.col("xa") / 1000) == F.round(F.col("xb") / 1000)).cast("int")
    c = matching.pair_confidence(similarity.levenshtein_similarity(F.col("na"), F.col("nb")), F.col("na") == F.col("nb"), equal, F.col("ka") == F.col("kb"))
    return p.select("a", "b", c.alias("confidence"))


@query(f"WITH {_PAIRS} SELECT a, b, (0.6 * {_LEV.format('na', 'nb')} + 0.2 * (ka = kb)::INT) / 0.8 AS score FROM pairs")
def weighted_similarity(spark, d):
    parts = {"string": (similarity.levenshtein_similarity(F.col("na"), F.col("nb")), 0.6), "property": ((F.col("ka") == F.col("kb")).cast("double"), 0.2), "relationship": (F.lit(None).cast("double"), 0.2)}
    return _pairs(spark, d).select("a", "b", resolution.weighted_score(parts).alias("score"))


@query("SELECT a.p_partkey AS new_id, b.p_partkey AS known_id, a.p_name AS name FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand WHERE a.p_partkey % 10 = 0 AND b.p_partkey % 10 <> 0")
def incremental_matches(spark, d):
    p = table(spark, d, "part")
    new, known = p.where("p_partkey % 10 = 0"), p.where("p_partkey % 10 <> 0")
    found = matching.match_new(new, known, "p_partkey", F.array(F.concat_ws(":", "p_brand", "p_name")), ["p_name"])
    return found.select(F.col("p_partkey_new").alias("new_id"), F.col("p_partkey_known").alias("known_id"), F.col("p_name_new").alias("name"))


@query("""WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY b) <= 2 UNION SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY b ORDER BY a) <= 2""")
def candidate_cap(spark, d):
    pairs = resolution.candidate_pairs(table(spark, d, "part"), "p_partkey", F.array(F.concat_ws(":", "p_brand", "p_name")), [])
    return resolution.cap_candidates(pairs.select(F.col("p_partkey_a").alias("a"), F.col("p_partkey_b").alias("b")), "a", "b", 2)


_KINDS = {"click": "saw", "view": "saw", "purchase": "bought"}


@query("SELECT user_id::VARCHAR AS s, CASE event_type WHEN 'click' THEN 'saw' WHEN 'view' THEN 'saw' WHEN 'purchase' THEN 'bought' ELSE event_type END AS p, (floor(value / 5))::BIGINT::VARCHAR AS o, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def canonical_triples(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    t = e.select(F.col("user_id").cast("string").alias("s"), F.concat(F.lit(" "), F.upper("event_type")).alias("p"), F.floor(F.col("value") / 5).cast("string").alias("o"))
    return matching.canonical_triples(t, _KINDS)


@query("SELECT s_suppkey, 'Nation ' || n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def alias_resolution(spark, d):
    aliases = table(spark, d, "nation").select(F.concat(F.lit(" NATION-"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("Nation "), "n_name").alias("canonical"))
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("nation"))
    return matching.resolve_aliases(s, "nation", aliases)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 15")
def most_linked(spark, d):
    return matching.most_linked(table(spark, d, "orders"), "o_custkey", 15)


@query("""SELECT entity, kind, property, n FROM (SELECT l_partkey AS entity, 'temporal' AS kind, 'date' AS property, count(DISTINCT l_shipdate) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_partkey, 'type', 'flag', count(DISTINCT l_returnflag) FROM lineitem GROUP BY ALL UNION ALL SELECT l_partkey, 'value', 'supplier', count(DISTINCT l_suppkey) FROM lineitem GROUP BY ALL) WHERE n > 1""")
def conflict_kinds(spark, d):
    one = lambda p, c: F.struct(F.lit(p).alias("property"), F.col(c).cast("string").alias("value"))
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.inline(F.array(one("date", "l_shipdate"), one("flag", "l_returnflag"), one("supplier", "l_suppkey"))))
    return matching.value_kind_conflicts(facts, {"date": "temporal", "flag": "type"}).withColumnRenamed("n_values", "n")


@query("SELECT entity, 'A' AS a, 'R' AS b FROM (SELECT l_suppkey AS entity, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1) WHERE list_contains(f, 'A') AND list_contains(f, 'R')")
def incompatible_types(spark, d):
    typed = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("type"))
    return matching.incompatible_types(typed, [("A", "R"), ("A", "Z")])


@query("SELECT p.p_partkey AS mention, q.p_partkey AS entity_id, 1.0::DOUBLE AS score FROM part p JOIN part q ON p.p_name = q.p_name WHERE q.p_partkey < 60 AND p.p_partkey >= 60")
def entity_links(spark, d):
    p = table(spark, d, "part")
    found = resolution.link_mentions(p.where("p_partkey >= 60").select(F.col("p_name").alias("mention")).distinct(), p.where("p_partkey < 60").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), 0.9)
    back = p.where("p_partkey >= 60").select(F.col("p_partkey"), F.col("p_name").alias("mention"))
    return found.join(back, "mention").select(F.col("p_partkey").alias("mention"), "entity_id", "score")


# scalars on columns
@query("SELECT o_orderkey, (o_orderdate AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS utc FROM orders")
def time_zones(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.col("o_orderdate").cast("timestamp_ntz")).alias("utc"))


@query("SELECT o_orderkey, round(o_totalprice / pow(10, floor(log10(o_totalprice)) - 2)) * pow(10, floor(log10(o_totalprice)) - 2) AS short FROM orders WHERE o_totalprice > 0")
def significant_digits(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 0").select("o_orderkey", numbers.significant(F.col("o_totalprice"), 3).alias("short"))


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT::DOUBLE AS plain, round(floor(o_totalprice) / 100, 9) AS share, floor(o_totalprice) * 1000 AS thousands FROM orders")
def number_parse(spark, d):
    whole = F.floor("o_totalprice").cast("string")
    o = table(spark, d, "orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("a"), F.concat(whole, F.lit("%")).alias("b"), F.concat(F.lit("$"), whole, F.lit("k")).alias("c"))
    return o.select("o_orderkey", numbers.parse_number(F.col("a")).alias("plain"), F.round(numbers.parse_number(F.col("b")), 9).alias("share"), numbers.parse_number(F.col("c")).alias("thousands"))


@query("SELECT p_partkey, round(p_size * 0.0254, 9) AS metres, round(p_size * 0.453592, 9) AS kilos FROM part")
def unit_convert(spark, d):
    p = table(spark, d, "part").select("p_partkey", numbers.parse_quantity(F.concat(F.col("p_size").cast("string"), F.lit(" inch"))).alias("q"), numbers.parse_quantity(F.concat(F.col("p_size").cast("string"), F.lit("LB"))).alias("w"))
    return p.select("p_partkey", F.round(numbers.convert_unit(F.col("q.value"), F.col("q.unit"), "m"), 9).alias("metres"), F.round(numbers.convert_unit(F.col("w.value"), F.col("w.unit"), "kg"), 9).alias("kilos"))


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS amount, CASE c_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'CHF' END AS currency FROM customer")
def currency_parse(spark, d):
    sign = F.element_at(F.array(F.lit("$"), F.lit("€"), F.lit("chf ")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = table(spark, d, "customer").select("c_custkey", numbers.parse_currency(F.concat(sign, F.format_number(F.abs("c_acctbal"), 2))).alias("m"))
    return c.select("c_custkey", "m.amount", "m.currency")


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS a, date_trunc('day', o_orderdate)::TIMESTAMP AS b FROM orders")
def date_normalize(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", numbers.parse_date(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("a"), numbers.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("b"))


@query("SELECT o_orderkey, (o_orderdate::DATE - INTERVAL (o_orderkey % 9) DAY)::DATE AS ago, (o_orderdate::DATE + INTERVAL (7 * (o_orderkey % 9)) DAY)::DATE AS later FROM orders")
def relative_date_columns(spark, d):
    n, day = (F.col("o_orderkey") % 9).cast("string"), F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", numbers.relative_date(F.concat(n, F.lit(" days ago")), day).alias("ago"), numbers.relative_date(F.concat(n, F.lit(" weeks from now")), day).alias("later"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS lo, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS hi FROM orders")
def temporal_phrase(spark, d):
    b = numbers.period_bounds(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").select("o_orderkey", b.alias("b")).select("o_orderkey", F.col("b.start").cast("date").alias("lo"), F.col("b.end").cast("date").alias("hi"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}_ ]', '', 'g')) AS digest FROM documents")
def special_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.remove_special(F.col("text"))).alias("digest"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<iframe[^>]*>.*?</iframe>', '', 'gis'), 'javascript:', '', 'gi'), 'data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+', '', 'g')) AS digest FROM pages""")
def sanitized_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.sanitize(F.col("html"))).alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN last_value(CASE WHEN turn % 2 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS antecedent FROM conversations")
def pronoun_antecedents(spark, d):
    """Even turns name a speaker, odd ones say only a pronoun."""
    c = table(spark, d, "conversations")
    m = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.lit("They")).otherwise(F.concat("role", F.col("turn").cast("string"))).alias("text"), F.col("turn").alias("start"))
    return extraction.resolve_pronouns(m, "conv_id").select("conv_id", "turn", "antecedent")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'empty_text' WHEN c_custkey % 4 = 1 THEN 'bad_span' WHEN c_custkey % 4 = 2 THEN 'bad_confidence' ELSE '' END AS issues FROM customer")
def mention_validation(spark, d):
    k = F.col("c_custkey") % 4
    m = table(spark, d, "customer").select("c_custkey", F.when(k == 0, " ").otherwise(F.col("c_name")).alias("text"), F.lit(3).alias("start"), F.when(k == 1, 3).otherwise(5).alias("end"), F.when(k == 2, 1.5).otherwise(0.5).alias("confidence"))
    return extraction.validate_mentions(m).select("c_custkey", F.array_join("issues", ",").alias("issues"))
