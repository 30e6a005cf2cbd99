"""Provenance chains, decisions, policies, triples, ontologies and evaluation over tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.similarity import word_jaccard
from loomgraph.functions.text import class_name, property_name
from loomgraph.storage import cut


# provenance
def checksum(fields: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)


def chain(entries: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """``entries`` with checksum, sequence number and the previous entry's checksum, one chain for each group."""
    w = W.partitionBy(group).orderBy(order)
    with_sum = entries.withColumn("checksum", checksum(fields))
    return with_sum.withColumns({"sequence_id": F.row_number().over(w), "previous_checksum": F.lag("checksum").over(w)})


def verify_chain(chained: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Entries with what is wrong: own checksum, link to the one before, or a gap; a bad entry doesn't spoil the next ones."""
    w = W.partitionBy(group).orderBy("sequence_id")
    checked = chained.withColumns({"want": F.lag("checksum").over(w), "seq": F.lag("sequence_id").over(w)})
    problems = F.array_compact(F.array(
        F.when(F.col("checksum") != checksum(fields), F.lit("checksum")), F.when(~F.col("previous_checksum").eqNullSafe(F.col("want")), F.lit("link")),
        F.when(F.col("sequence_id") != F.coalesce(F.col("seq"), F.lit(0)) + 1, F.lit("sequence")),
    ))
    return checked.withColumn("problem", F.explode(problems)).drop("want", "seq")


def lineage(parents: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """``origin, id, depth``: ancestors over ``parents(id, parent)`` by frontier joins; cycles end at what was seen."""
    seen = start.select(F.col("id").alias("origin"), "id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        up = frontier.join(parents.withColumnRenamed("id", "child"), F.col("id") == F.col("child")).select("origin", F.col("parent").alias("id")).distinct()
        frontier = cut(up.join(seen, ["origin", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


# decisions and policies
def insights(decisions: DataFrame) -> DataFrame:
    """By category: count, mean, least, largest and upper-median confidence."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY confidence DESC)")
    return decisions.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), upper.alias("median_confidence"))


def precedents(decisions: DataFrame, scenario: str, *, category: str | None = None, threshold: float = 0.0, k: int = 10) -> DataFrame:
    """The ``k`` decisions most like a scenario: 0.7 word Jaccard + 0.3 for the same category."""
    same = F.when(F.col("category") == F.lit(category), 1.0).otherwise(0.0) if category else F.lit(0.0)
    score = 0.7 * word_jaccard(F.col("scenario"), F.lit(scenario)) + 0.3 * same
    return decisions.withColumn("score", score).where(F.col("score") >= threshold).orderBy(F.desc("score"), "decision_id").limit(k)


def compliance(decisions: DataFrame, rules: dict[str, object]) -> DataFrame:
    """``decision_id, violations, compliant``: rules ``min_x``, ``max_x``, ``required_x`` (one of), other keys must not be null."""
    checks = []
    for key, value in rules.items():
        if key.startswith("min_"):
            bad = ~F.coalesce(F.col(key[4:]) >= F.lit(value), F.lit(False))
        elif key.startswith("max_"):
            bad = ~F.coalesce(F.col(key[4:]) <= F.lit(value), F.lit(False))
        elif key.startswith("required_"):
            bad = ~F.coalesce(F.col(key[9:]).isin(list(value)), F.lit(False))
        else:
            bad = F.col(key).isNull()
        checks.append(F.when(bad, F.lit(key)))
    violations = F.array_compact(F.array(*checks))
    return decisions.select("decision_id", F.array_join(violations, ",").alias("violations"), (F.size(violations) == 0).alias("compliant"))


def latest_policies(policies: DataFrame) -> DataFrame:
    return policies.withColumn("r", F.row_number().over(W.partitionBy("policy_id").orderBy(F.desc("updated_at"), F.desc("version")))).where("r = 1").drop("r")


def causal_chain(edges: DataFrame, start, direction: str = "downstream", max_depth: int = 5) -> DataFrame:
    """``id, depth`` over causal edges from one decision, upstream or downstream, nearest first visit."""
    links = edges.select("src", "dst") if direction == "downstream" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = links.select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    seed = edges.sparkSession.range(1).select(F.lit(start).alias("id"))
    return lineage(up, seed, max_depth).where("depth > 0").select("id", "depth")


def impact(edges: DataFrame) -> DataFrame:
    """``id, impact``: min(1, (n_i avg_i + 0.5 n_p avg_p) / (max(n_i, 1) + 0.5 max(n_p, 1))) over influenced and precedent edges (confidence)."""
    g = edges.groupBy(F.col("src").alias("id"))
    kind = F.col("type") == "PRECEDENT_FOR"
    f = g.agg(F.count(F.when(~kind, 1)).alias("ni"), F.coalesce(F.avg(F.when(~kind, F.col("confidence"))), F.lit(0.0)).alias("ai"), F.count(F.when(kind, 1)).alias("np"), F.coalesce(F.avg(F.when(kind, F.col("confidence"))), F.lit(0.0)).alias("ap"))
    return f.select("id", F.least(F.lit(1.0), (F.col("ni") * F.col("ai") + 0.5 * F.col("np") * F.col("ap")) / (F.greatest("ni", F.lit(1)) + 0.5 * F.greatest("np", F.lit(1)))).alias("impact"))


def retract(facts: DataFrame, gone: DataFrame, key: str, at: Column, reason: str) -> DataFrame:
    """Close the facts of ``gone`` at ``at`` with a reason; others stay as they are."""
    marked = facts.join(gone.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    hit = F.coalesce("__gone", F.lit(False)) & F.col("valid_until").isNull()
    return marked.withColumn("retracted_for", F.when(hit, F.lit(reason))).withColumn("valid_until", F.when(hit, at).otherwise(F.col("valid_until"))).drop("__gone")


# triples
def match(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one pattern; terms that begin with ``?`` are variables."""
    seen: dict[str, str] = {}
    for column, term in (("s", s), ("p", p), ("o", o)):
        if not term.startswith("?"):
            triples = triples.where(F.col(column) == F.lit(term))
        elif term in seen:
            triples = triples.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return triples.select(*(F.col(c).alias(v[1:]) for v, c in seen.items()))


_TERM = r"(\?\w+|<[^>]*>|\"[^\"]*\"|[\w:./#-]+)"


class SparqlSubset:
    """SELECT [DISTINCT] over basic graph patterns with FILTER, OPTIONAL, UNION, ORDER BY, LIMIT, OFFSET and COUNT, compiled to joins."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    def select(self, text: str) -> DataFrame:
        m = re.fullmatch(r"\s*SELECT\s+(DISTINCT\s+)?(.+?)\s+WHERE\s*\{(.*)\}\s*(ORDER\s+BY\s+(?:DESC\()?\?\w+\)?)?\s*(LIMIT\s+\d+)?\s*(OFFSET\s+\d+)?\s*", text, re.I | re.S)
        if not m:
            raise ValueError("not a query of the supported subset")
        distinct, head, body, order, limit, offset = m.groups()
        df = self._group(body)
        if count := re.fullmatch(r"\(\s*COUNT\s*\(\s*(\*|\?\w+)\s*\)\s+AS\s+\?(\w+)\s*\)", head.strip(), re.I):
            return df.agg(F.count(F.lit(1) if count[1] == "*" else F.col(count[1][1:])).alias(count[2]))
        df = df if head.strip() == "*" else df.select(*re.findall(r"\?(\w+)", head))
        df = df.distinct() if distinct else df
        if order:
            name = re.search(r"\?(\w+)", order)[1]
            df = df.orderBy(F.desc(name) if "DESC(" in order.upper() else F.asc(name))
        df = df.offset(int(offset.split()[1])) if offset else df
        return df.limit(int(limit.split()[1])) if limit else df

    def _group(self, body: str) -> DataFrame:
        if union := re.fullmatch(r"\s*\{(.*?)\}\s*UNION\s*\{(.*?)\}\s*", body, re.I | re.S):
            return self._group(union[1]).unionByName(self._group(union[2]), allowMissingColumns=True)
        optional = re.findall(r"OPTIONAL\s*\{([^}]*)\}", body, re.I)
        filters = re.findall(r"FILTER\s*\(([^()]*)\)", body, re.I)
        rest = re.sub(r"OPTIONAL\s*\{[^}]*\}|FILTER\s*\([^()]*\)", " ", body, flags=re.I)
        df = None
        for s, p, o in re.findall(rf"{_TERM}\s+{_TERM}\s+{_TERM}\s*(?:\.|$)", rest.strip()):
            found = match(self.triples, s, p, o)
            shared = [] if df is None else [c for c in found.columns if c in df.columns]
            df = found if df is None else df.join(found, shared) if shared else df.crossJoin(found)
        if df is None:
            raise ValueError("no triple pattern")
        for part in optional:
            found = self._group(part)
            df = df.join(found, [c for c in found.columns if c in df.columns], "left")
        for f in filters:
            v, op, term = re.fullmatch(r"\s*\?(\w+)\s*(!=|<=|>=|=|<|>)\s*(.+?)\s*", f).groups()
            value = F.col(term[1:]) if term.startswith("?") else F.lit(term.strip('"')) if not re.fullmatch(r"-?[\d.]+", term) else F.lit(float(term))
            left = F.col(v).try_cast("double") if re.fullmatch(r"-?[\d.]+", term) else F.col(v)
            df = df.where({"=": left == value, "!=": left != value, "<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value}[op])
        return df


def triple_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``s, p, o, change``: triples added and removed."""
    added = new.join(old, ["s", "p", "o"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.join(new, ["s", "p", "o"], "left_anti").withColumn("change", F.lit("removed"))).distinct()


# ontology
def infer_classes(entities: DataFrame, least: int = 1) -> DataFrame:
    """``class_name, n``: entity types that occur at least so often."""
    return entities.groupBy(class_name(F.col("type")).alias("class_name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def infer_properties(edges: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """``property, domain, range, n`` of edge types that occur at least so often."""
    kinds = entities.select("id", class_name(F.col("type")).alias("k"))
    typed = edges.join(kinds.select(F.col("id").alias("src"), F.col("k").alias("d")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("k").alias("r")), "dst")
    out = typed.groupBy(property_name(F.col("type")).alias("property")).agg(F.array_join(F.array_sort(F.collect_set("d")), ",").alias("domain"), F.array_join(F.array_sort(F.collect_set("r")), ",").alias("range"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def shape_violations(entities: DataFrame, required: list[str], allowed: dict[str, list], patterns: dict[str, str]) -> DataFrame:
    """``id, constraint``: missing required fields, values outside a list, values that don't match a pattern."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"minCount:{c}")) for c in required]
    checks += [F.when(~F.col(c).isin(v), F.lit(f"in:{c}")) for c, v in allowed.items()]
    checks += [F.when(~F.col(c).rlike(p), F.lit(f"pattern:{c}")) for c, p in patterns.items()]
    return entities.select(F.col("id"), F.explode(F.array_compact(F.array(*checks))).alias("constraint"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``name, change, risk`` of ontology terms (name, domain): removed is critical, another domain high, added safe."""
    a, b = old.select(F.col("name").alias("na"), F.col("domain").alias("da")), new.select(F.col("name").alias("nb"), F.col("domain").alias("db"))
    joined = a.join(b, F.col("na") == F.col("nb"), "full_outer")
    change = F.when(F.col("nb").isNull(), "removed").when(F.col("na").isNull(), "added").when(~F.col("da").eqNullSafe(F.col("db")), "domain_changed")
    risk = F.when(F.col("nb").isNull(), "critical").when(F.col("na").isNull(), "safe").otherwise("high")
    return joined.select(F.coalesce("na", "nb").alias("name"), change.alias("change"), risk.alias("risk")).where("change IS NOT NULL")


# evaluation
def unigram_f1(a: Column, b: Column) -> Column:
    """ROUGE-1 F1: multiset overlap of words."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, w: s + F.least(count(x, w), count(y, w)))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * common / total)


def eval_summary(results: DataFrame) -> DataFrame:
    """``n, passed, pass_rate`` (1 without cases)."""
    return results.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.coalesce(F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("pass_rate"))
