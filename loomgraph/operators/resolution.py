"""Entity resolution, duplicate clusters, merging, and conflicts between sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.similarity import clean, levenshtein_similarity, word_jaccard
from loomgraph.operators.graph_algorithms import connected_components


def block_keys(name: Column, kind: Column | None = None, prefix: int = 4) -> Column:
    """Prefixes of a name's words (longer than two letters), with the type; a nameless record has one key."""
    words = F.filter(F.split(clean(name), r"[^a-z0-9]+"), lambda w: F.length(w) > 2)
    keys = F.transform(words, lambda w: F.substring(w, 1, prefix))
    keys = F.when(F.size(keys) > 0, F.array_distinct(keys)).otherwise(F.array(F.lit("")))
    return F.transform(keys, lambda k: F.concat_ws(":", F.coalesce(kind, F.lit("")), k)) if kind is not None else keys


def candidate_pairs(records: DataFrame, id_col: str, keys: Column, kept: list[str]) -> DataFrame:
    """Distinct pairs ``id_a < id_b`` of records that share a block key, with the columns of ``kept`` on both sides."""
    blocked = records.select(id_col, *kept, F.explode(keys).alias("__key"))
    a = blocked.select("__key", *(F.col(c).alias(f"{c}_a") for c in (id_col, *kept)))
    b = blocked.select("__key", *(F.col(c).alias(f"{c}_b") for c in (id_col, *kept)))
    return a.join(b, "__key").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).drop("__key").distinct()


def cap_candidates(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """For each record its ``most`` least partners, from both sides."""
    left = pairs.withColumn("r", F.row_number().over(W.partitionBy(a).orderBy(b))).where(F.col("r") <= most).drop("r")
    right = pairs.withColumn("r", F.row_number().over(W.partitionBy(b).orderBy(a))).where(F.col("r") <= most).drop("r")
    return left.union(right).distinct()


def weighted_score(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null."""
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(0.0)


def duplicate_groups(records: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """``id, group, size``: components of the duplicate pairs (``a``, ``b``); single records are left out."""
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    groups = connected_components(nodes, edges).withColumnRenamed("component", "group")
    return groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "group").select(F.col("id").alias(id_col), "group", "size")


def merge_records(records: DataFrame, group: str, order: str, fields: list[str], strategy: str = "most_complete") -> DataFrame:
    """One record a group: keep_first, keep_last, most_complete (most non-null fields, ties first) or merge_all (first non-null field by field)."""
    first = W.partitionBy(group).orderBy(order)
    if strategy == "merge_all":
        return records.groupBy(group).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields), F.count(F.lit(1)).alias("merged"))
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rank = {"keep_first": first, "keep_last": W.partitionBy(group).orderBy(F.desc(order)), "most_complete": W.partitionBy(group).orderBy(F.desc(filled), order)}[strategy]
    return records.withColumns({"merged": F.count(F.lit(1)).over(W.partitionBy(group)), "r": F.row_number().over(rank)}).where("r = 1").select(group, *fields, "merged")


def exact_duplicates(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Records that aren't the first of their key."""
    return records.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("r > 1").drop("r")


def link_mentions(mentions: DataFrame, entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mentions (``mention``) linked to entities (``entity_id, name``) with word-set Jaccard of at least ``threshold``, via shared words."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")))
    m, e = mentions.select("mention", words(F.col("mention")).alias("w")), entities.select("entity_id", "name", words(F.col("name")).alias("w"))
    pairs = m.join(e, "w").select("mention", "entity_id", "name").distinct()
    return pairs.withColumn("score", word_jaccard(F.col("mention"), F.col("name"))).where(F.col("score") >= threshold)


def value_conflicts(facts: DataFrame) -> DataFrame:
    """``entity, property, n_records, n_values, values`` of ``facts(entity, property, value, ...)`` with more than one value; nulls don't count."""
    found = facts.where("value IS NOT NULL").groupBy("entity", "property").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("value").alias("n_values"), F.array_sort(F.collect_set("value")).alias("values"))
    return found.where("n_records > 1 AND n_values > 1")


def resolve_by_voting(facts: DataFrame) -> DataFrame:
    """``entity, property, value, confidence``: the most frequent value (ties: the first by ``pos``), its share of votes."""
    votes = facts.where("value IS NOT NULL").groupBy("entity", "property", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return votes.groupBy("entity", "property").agg(F.min_by("value", F.struct(-F.col("n"), "pos")).alias("value"), (F.max("n") / F.sum("n")).alias("confidence"))


def resolve_by_credibility(facts: DataFrame) -> DataFrame:
    """The value with the largest sum of confidence (0.5 if null) times source credibility, and its share."""
    weight = F.coalesce("confidence", F.lit(0.5)) * F.coalesce("credibility", F.lit(0.5))
    votes = facts.where("value IS NOT NULL").groupBy("entity", "property", "value").agg(F.sum(weight).alias("w"), F.min("pos").alias("pos"))
    return votes.groupBy("entity", "property").agg(F.min_by("value", F.struct(-F.round("w", 9), "pos")).alias("value"), (F.max("w") / F.sum("w")).alias("confidence"))


def resolve_by(facts: DataFrame, measure: str) -> DataFrame:
    """The value with the largest ``measure`` (latest time, highest confidence); ties: the first by ``pos``."""
    best = facts.where(F.col("value").isNotNull() & F.col(measure).isNotNull()).withColumn("r", F.row_number().over(W.partitionBy("entity", "property").orderBy(F.desc(measure), "pos")))
    return best.where("r = 1").select("entity", "property", "value")


def severity(n_values: Column) -> Column:
    return F.when(n_values > 5, "critical").when(n_values > 3, "high").when(n_values > 2, "medium").otherwise("low")


__all__ = ["block_keys", "candidate_pairs", "cap_candidates", "duplicate_groups", "exact_duplicates", "levenshtein_similarity", "link_mentions", "merge_records", "resolve_by", "resolve_by_credibility", "resolve_by_voting", "severity", "value_conflicts", "weighted_score"]
