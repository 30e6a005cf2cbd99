"""Extraction of entities, relations, triplets and events from text by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Entity patterns by label.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[^\s<>\"]+",
    "MONEY": r"[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?",
    "PERCENT": r"[0-9]+(?:\.[0-9]+)?%",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "PHONE": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
}


def entities(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """``id, label, text`` for every match of every pattern."""

    def labelled(label: str):
        return lambda t: F.struct(F.lit(label).alias("label"), t.alias("text"))

    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(p), F.lit(0)), labelled(k)) for k, p in (patterns or PATTERNS).items())))
    return df.select(id_col, F.explode(found).alias("e")).select(id_col, "e.label", "e.text")


def spans(df: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """``id, start, end, text`` of a pattern's matches, left to right; places from the lengths of the matches and of the text between them."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text_col), pattern, -1)
    pieces = df.select(id_col, F.posexplode(F.arrays_zip(between.alias("gap"), found.alias("m"))).alias("i", "x")).select(id_col, "i", "x.gap", "x.m")
    before = F.coalesce(F.sum(F.length("gap") + F.coalesce(F.length("m"), F.lit(0))).over(W.partitionBy(id_col).orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("start", (before + F.length("gap")).cast("int")).where("m IS NOT NULL")
    return placed.select(id_col, "start", (F.col("start") + F.length("m")).cast("int").alias("end"), F.col("m").alias("text"))


def capitalized(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, n``: capitalised words of more than two letters, and how often each occurs."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"\b[A-Z][a-z]{2,}"), F.lit(0))
    return df.select(id_col, F.explode(words).alias("text")).groupBy(id_col, "text").agg(F.count(F.lit(1)).alias("n"))


def cooccurrences(mentions: DataFrame, doc: str, within: int = 100) -> DataFrame:
    """``doc, a, b`` of distinct mention texts (``text, start, end``) of one document less than ``within`` characters apart."""
    a = mentions.select(doc, F.col("text").alias("a"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = mentions.select(doc, F.col("text").alias("b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    near = (F.col("sa") < F.col("sb")) & (F.col("sb") - F.col("ea") < within)
    return a.join(b, doc).where(near & (F.col("a") != F.col("b"))).select(doc, "a", "b").distinct()


# Relation templates between two capitalised names.
RELATIONS = {"founded_by": "(?:was )?founded by", "located_in": "(?:is )?located in", "works_for": "works (?:for|at)", "born_in": "(?:was )?born in", "acquired_by": "(?:was )?acquired by"}
NAME = r"[A-Z]\w+(?: [A-Z]\w+)*"


def relations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, subject, predicate, object`` of the templates' matches."""

    def triplet(name: str, phrase: str):
        return lambda t: F.struct(F.regexp_extract(t, f"^({NAME}) {phrase}", 1).alias("subject"), F.lit(name).alias("predicate"), F.regexp_extract(t, f"{phrase} ({NAME})$", 1).alias("object"))

    parts = []
    for name, phrase in RELATIONS.items():
        whole = F.regexp_extract_all(F.col(text_col), F.lit(f"{NAME} {phrase} {NAME}"), F.lit(0))
        parts.append(F.transform(whole, triplet(name, phrase)))
    return df.select(id_col, F.explode(F.flatten(F.array(*parts))).alias("r")).select(id_col, "r.*")


# Trigger words of event kinds.
TRIGGERS = {"acquisition": "acquir|merge", "partnership": "partner", "launch": "launch|releas", "investment": "invest|fund", "legal": "lawsuit|sued|court"}


def events(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, kind, position``: each event trigger, in order of its place among the document's words."""
    words = df.select(id_col, F.posexplode(F.split(F.lower(text_col), r"\s+")).alias("position", "word"))
    kind = F.coalesce(*(F.when(F.col("word").rlike(p), F.lit(k)) for k, p in TRIGGERS.items()))
    return words.select(id_col, kind.alias("kind"), "position").where("kind IS NOT NULL")


def resolve_pronouns(mentions: DataFrame, doc: str) -> DataFrame:
    """Mentions with ``antecedent``: for pronouns, the last earlier mention that isn't one."""
    pronoun = F.lower("text").isin("he", "she", "it", "they")
    w = W.partitionBy(doc).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return mentions.withColumn("antecedent", F.when(pronoun, F.last(F.when(~pronoun, F.col("text")), ignorenulls=True).over(w)))


def weighted_confidence(original: Column, similarity: Column, w_method: float = 0.5, w_similarity: float = 0.5) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (w_method * original + w_similarity * similarity) / (w_method + w_similarity)))


def validate_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with the array of their issues: empty text, bad span, confidence outside [0, 1]."""
    checks = [F.when(F.trim("text") == "", F.lit("empty_text")), F.when(F.col("start") >= F.col("end"), F.lit("bad_span")), F.when(~F.col("confidence").between(0, 1), F.lit("bad_confidence"))]
    return mentions.withColumn("issues", F.array_compact(F.array(*checks)))
