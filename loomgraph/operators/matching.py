"""Pairwise similarity of records by several factors, gates before scoring, and incremental matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.similarity import bigram_similarity, clean, jaro_winkler, levenshtein_similarity, set_jaccard


def string_similarity(a: Column, b: Column, method: str = "levenshtein") -> Column:
    """``levenshtein``, ``jaro_winkler`` or ``cosine`` (of bigram sets); any other name compares exactly. An empty or null side gives 0."""
    by = {"levenshtein": levenshtein_similarity, "jaro_winkler": lambda x, y: jaro_winkler(clean(x), clean(y)), "cosine": bigram_similarity}
    score = by.get(method, lambda x, y: (clean(x) == clean(y)).cast("double"))(a, b)
    empty = F.coalesce(F.trim(a) == "", F.lit(True)) | F.coalesce(F.trim(b) == "", F.lit(True))
    return F.when(empty, 0.0).otherwise(score)


def property_similarity(a: Column, b: Column) -> Column:
    """Of two text maps: mean over all keys of 0.5 where one lacks it, 1 where the values are equal, else their Levenshtein similarity; 1 if both are empty."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    x, y = (lambda k: F.try_element_at(a, k)), (lambda k: F.try_element_at(b, k))
    one = lambda k: F.when(x(k).isNull() | y(k).isNull(), 0.5).when(x(k) == y(k), 1.0).otherwise(levenshtein_similarity(x(k), y(k)))
    total = F.aggregate(F.transform(keys, one), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(keys) == 0, 1.0).otherwise(total / F.size(keys))


def relationship_similarity(a: Column, b: Column) -> Column:
    """Of two sets of related ids: Jaccard; 0.5 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.5).otherwise(set_jaccard(a, b))


def passes_gates(name_a: Column, name_b: Column, type_a: Column | None = None, type_b: Column | None = None, *, least_ratio: float = 0.3, share_word: bool = False) -> Column:
    """Cheap conditions that a pair must meet before it is scored: equal types, lengths of a ratio, a common word."""
    la, lb = F.length(name_a), F.length(name_b)
    ok = F.least(la, lb) >= least_ratio * F.greatest(la, lb)
    if type_a is not None:
        ok = ok & (type_a.isNull() | type_b.isNull() | (type_a == type_b))
    if share_word:
        words = lambda c: F.filter(F.split(clean(c), r"[^a-z0-9]+"), lambda w: w != "")
        ok = ok & F.arrays_overlap(words(name_a), words(name_b))
    return ok


def pair_confidence(score: Column, same_name: Column, n_equal: Column, same_type: Column) -> Column:
    """Score with 0.1 for the same name, 0.05 for each equal property and for the same type, at most 1; 0 for different types."""
    return F.when(~same_type, 0.0).otherwise(F.least(F.lit(1.0), score + F.when(same_name, 0.1).otherwise(0.0) + 0.05 * n_equal + 0.05))


def match_new(new: DataFrame, known: DataFrame, id_col: str, keys: Column, kept: list[str]) -> DataFrame:
    """Pairs of a new and a known record that share a block key, ``kept`` columns with the suffixes ``_new`` and ``_known``."""
    side = lambda df, s: df.select(F.explode(keys).alias("__key"), *(F.col(c).alias(f"{c}_{s}") for c in (id_col, *kept)))
    return side(new, "new").join(side(known, "known"), "__key").drop("__key").distinct()


def canonical_triples(triples: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """``s, p, o, n``: triples under their predicates' canonical names, each once, with how many rows say so."""
    names = F.create_map(*(F.lit(v) for pair in synonyms.items() for v in pair))
    p = F.lower(F.trim("p"))
    return triples.groupBy(clean(F.col("s")).alias("s"), F.coalesce(F.try_element_at(names, p), p).alias("p"), clean(F.col("o")).alias("o")).agg(F.count(F.lit(1)).alias("n"))


def resolve_aliases(records: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``records`` with ``column`` replaced by its canonical name (``aliases``: alias, canonical), compared without case and outer blanks."""
    known = aliases.select(clean(F.col("alias")).alias("__alias"), "canonical")
    found = records.join(known, clean(F.col(column)) == F.col("__alias"), "left")
    return found.withColumn(column, F.coalesce("canonical", column)).drop("__alias", "canonical")


def most_linked(links: DataFrame, entity: str, k: int) -> DataFrame:
    """The ``k`` entities with most links."""
    return links.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), entity).limit(k)


def value_kind_conflicts(facts: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``entity, kind, property, n_values``: conflicting values by the kind of conflict that their property stands for (``kinds``; others: value)."""
    kind = F.create_map(*(F.lit(v) for pair in kinds.items() for v in pair))
    found = facts.where("value IS NOT NULL").groupBy("entity", "property").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")
    return found.select("entity", F.coalesce(F.try_element_at(kind, F.col("property")), F.lit("value")).alias("kind"), "property", "n_values")


def incompatible_types(typed: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``entity, a, b``: entities (``entity, type``) that carry two types which exclude each other."""
    kinds = typed.groupBy("entity").agg(F.collect_set("type").alias("t"))
    hits = F.filter(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)), lambda p: F.array_contains("t", p["a"]) & F.array_contains("t", p["b"]))
    return kinds.select("entity", F.explode(hits).alias("p")).select("entity", "p.a", "p.b")
