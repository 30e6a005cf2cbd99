"""Inference beside Datalog: derived triples under SPARQL, propositional rules with their derivations, new matches of
rules, and retrieval over graphs and time."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import reasoning
from loomgraph.operators.graph_algorithms import bfs_levels
from loomgraph.operators.records import SparqlSubset
from loomgraph.operators.temporal import active_at
from loomgraph.storage import cut


def inferred_triples(triples: DataFrame, rules: list[str]) -> DataFrame:
    """``s, p, o``: the triples and all that follow from them by rules over predicates with two arguments.

    Only the predicates that the rules name go through the fixpoint; the others are handed on as they are.
    """
    parsed = [reasoning.parse_rule(r) for r in rules]
    named = sorted({p for head, body in parsed for p, _ in (head, *body)})
    facts = {p: triples.where(F.col("p") == p).select(F.col("s").alias("a0"), F.col("o").alias("a1")) for p in named}
    closed = reasoning.datalog(facts, rules)
    parts = [f.select(F.col("a0").alias("s"), F.lit(p).alias("p"), F.col("a1").alias("o")) for p, f in closed.items()]
    rest = triples.where(~F.col("p").isin(named)).select("s", "p", "o")
    return reduce(DataFrame.unionByName, parts, rest)


def sparql_inferred(triples: DataFrame, rules: list[str], text: str) -> DataFrame:
    """The solutions of a SPARQL query over the triples with their consequences."""
    return SparqlSubset(inferred_triples(triples, rules)).select(text)


def conclusions(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``statement, depth, rule_id``: given statements (depth 0, no rule) and those that rules conclude from them.

    ``rules`` (rule_id, conclusion, premise) has a row for each premise. A rule applies once all its premises are
    known; a statement has its least depth and, among the rules of that depth, the least. Rounds join the last round's
    statements with the premises that wait for them; counts of premises are kept for each rule, so a rule with many
    premises is an aggregate and not a list.
    """
    known = facts.select("statement").distinct().select("statement", F.lit(0).alias("depth"), F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule_id"))
    links = rules.select("rule_id", "conclusion", "premise").distinct()
    open_rules = links.groupBy("rule_id", "conclusion").agg(F.count(F.lit(1)).alias("missing"))
    fresh = known
    for depth in count(1):
        met = links.join(fresh.select(F.col("statement").alias("premise")), "premise").groupBy("rule_id", "conclusion").agg(F.count(F.lit(1)).alias("met"))
        left = open_rules.join(met, ["rule_id", "conclusion"], "left").select("rule_id", "conclusion", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing"))
        left = cut(left)
        found = left.where("missing = 0").groupBy(F.col("conclusion").alias("statement")).agg(F.min("rule_id").alias("rule_id"))
        fresh = cut(found.join(known, "statement", "left_anti").select("statement", F.lit(depth).alias("depth"), "rule_id"))
        if fresh.isEmpty():
            return known
        open_rules = left.where("missing > 0")
        known = cut(known.union(fresh))


def explain(derived: DataFrame, rules: DataFrame) -> DataFrame:
    """``statement, depth, rule_id, premise, premise_depth``: the last step of each derivation, a row for each premise."""
    known = derived.select(F.col("statement").alias("premise"), F.col("depth").alias("premise_depth"))
    steps = derived.where("rule_id IS NOT NULL").join(rules.select("rule_id", F.col("conclusion").alias("statement"), "premise").distinct(), ["rule_id", "statement"])
    return steps.join(known, "premise").select("statement", "depth", "rule_id", "premise", "premise_depth")


def activations(facts: dict[str, DataFrame], fresh: dict[str, DataFrame], rule: str, priority: int = 0) -> DataFrame:
    """The bindings of a rule's variables that new facts make possible, with the rule's head and ``priority``.

    Incremental matching by sets: one body atom reads the new facts, the atoms before it the old ones and those after
    it both, so each match is found in one place only and nothing that matched before comes again.
    """
    (head, _), body = reasoning.parse_rule(rule)
    both = {p: facts[p].unionByName(fresh[p]) if p in facts and p in fresh else facts.get(p, fresh.get(p)) for p, _ in body}
    found = []
    for i, (name, _) in enumerate(body):
        if name not in fresh or any(p not in facts for p, _ in body[:i]):
            continue
        sides = [fresh[p] if j == i else facts[p] if j < i else both[p] for j, (p, _) in enumerate(body)]
        matched = reasoning._join([reasoning.atom_frame(s, args) for s, (_, args) in zip(sides, body, strict=True)])
        found.append(matched.distinct())
    if not found:
        raise ValueError(f"no new facts for {rule!r}")
    return reduce(DataFrame.unionByName, found).distinct().withColumns({"head": F.lit(head), "priority": F.lit(priority)})


def graph_retrieve(nodes: DataFrame, edges: DataFrame, words: list[str], hops: int = 2, decay: float = 0.5) -> DataFrame:
    """``id, seed_score, hops, score``: nodes named by one of ``words``, and what lies within ``hops`` of them either way.

    A seed scores the share of the words that its name holds; a node scores the best of its seeds' scores times
    ``decay`` to its distance.
    """
    share = reduce(lambda a, b: a + b, [F.lower("name").contains(w.lower()).cast("double") for w in words]) / len(words)
    seeds = cut(nodes.select("id", share.alias("seed_score")).where("seed_score > 0"))
    und = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    near = bfs_levels(und, seeds.select("id"), hops).withColumnRenamed("id", "node")
    scored = near.join(seeds.select(F.col("id").alias("origin"), "seed_score"), "origin")
    worth = F.col("seed_score") * F.pow(F.lit(decay), F.col("hops"))
    return scored.groupBy(F.col("node").alias("id")).agg(F.max("seed_score").alias("seed_score"), F.min("hops").alias("hops"), F.max(worth).alias("score"))


def retrieve_at(results: DataFrame, validity: DataFrame, t: Column) -> DataFrame:
    """Retrieved rows (``id``, ...) whose item is alive at ``t`` (``validity``: id, valid_from, valid_until); items without a span always are."""
    spans = validity.select("id", F.lit(True).alias("__has"), active_at(F.col("valid_from"), F.col("valid_until"), t).alias("__alive"))
    alive = spans.groupBy("id").agg(F.max("__alive").alias("__alive"), F.max("__has").alias("__has"))
    return results.join(alive, "id", "left").where(F.col("__has").isNull() | F.col("__alive")).drop("__alive", "__has")


def temporal_intent(text: Column) -> Column:
    """Struct ``intent, at_time, start_time, end_time, rest`` of a question with ISO dates: between two, or before, after, since, during, at or on one."""
    date = r"(\d{4}-\d{2}-\d{2})"
    between, single = rf"(?i)\s*\bbetween\s+{date}\s+and\s+{date}", rf"(?i)\s*\b(before|after|since|during|at|on)\s+{date}"
    day = lambda c: F.nullif(c, F.lit("")).try_cast("date")
    two = F.regexp_like(text, F.lit(between))
    word = F.lower(F.regexp_extract(text, single, 1))
    return F.struct(
        F.when(two, "between").otherwise(F.nullif(word, F.lit(""))).alias("intent"),
        F.when(~two, day(F.regexp_extract(text, single, 2))).alias("at_time"),
        F.when(two, day(F.regexp_extract(text, between, 1))).alias("start_time"),
        F.when(two, day(F.regexp_extract(text, between, 2))).alias("end_time"),
        F.when(two, F.regexp_replace(text, between, "")).otherwise(F.regexp_replace(text, single, "")).alias("rest"),
    )
