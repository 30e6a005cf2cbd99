"""Rules over facts: Datalog by semi-naive iteration, forward and backward chaining."""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.storage import cut

_ATOM = re.compile(r"\s*([A-Za-z_]\w*)\s*\(([^)]*)\)\s*")


def parse_atom(text: str) -> tuple[str, tuple[str, ...]]:
    """``pred(a, X)`` as name and arguments. Arguments that begin with a capital or ``?`` are variables."""
    m = _ATOM.fullmatch(text)
    if not m:
        raise ValueError(f"no atom: {text!r}")
    return m[1], tuple(a.strip().strip("'\"") for a in m[2].split(","))


def parse_rule(text: str) -> tuple[tuple[str, tuple], list[tuple[str, tuple]]]:
    """``head(X, Y) :- a(X, Z), b(Z, Y).`` or ``IF a(..) AND b(..) THEN head(..)``."""
    text = text.strip().rstrip(".")
    if text.upper().startswith("IF "):
        body, head = re.split(r"\s+THEN\s+", text[3:], flags=re.I)
        parts = re.split(r"\s+AND\s+", body, flags=re.I)
    else:
        head, body = text.split(":-")
        parts = re.findall(r"[A-Za-z_]\w*\s*\([^)]*\)", body)
    return parse_atom(head), [parse_atom(p) for p in parts]


def is_variable(arg: str) -> bool:
    return arg[:1] == "?" or arg[:1].isupper()


def atom_frame(facts: DataFrame, args: tuple[str, ...]) -> DataFrame:
    """Bindings of an atom's variables: constants and repeated variables filter, columns are named after variables."""
    seen: dict[str, str] = {}
    for i, a in enumerate(args):
        if not is_variable(a):
            facts = facts.where(F.col(f"a{i}") == F.lit(a))
        elif a in seen:
            facts = facts.where(F.col(f"a{i}") == F.col(seen[a]))
        else:
            seen[a] = f"a{i}"
    return facts.select(*(F.col(c).alias(v) for v, c in seen.items())) if seen else facts.limit(1).select(F.lit(True).alias("__true"))


def _join(frames: list[DataFrame]) -> DataFrame:
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)

    return reduce(two, frames)


def datalog(facts: dict[str, DataFrame], rules: list[str], max_rounds: int | None = None) -> dict[str, DataFrame]:
    """Fixpoint of positive rules over ``facts`` (predicate to a frame with text columns a0, a1, ...).

    Semi-naive: a round joins each rule with one body atom restricted to the last round's new facts. New facts are
    those that an anti-join doesn't find among the known ones. Set semantics. Without ``max_rounds`` until nothing is
    new; an error if rounds run out before.
    """
    parsed = [parse_rule(r) for r in rules]
    known = {p: df.distinct() for p, df in facts.items()}
    delta = dict(known)
    for done in count():
        if done == max_rounds:
            raise RuntimeError(f"facts are still new after {max_rounds} rounds")
        fresh: dict[str, list[DataFrame]] = {}
        for (head, head_args), body in parsed:
            for i, (pred, _) in enumerate(body):
                if pred not in delta or any(p not in known for p, _ in body):
                    continue
                joined = _join([atom_frame(delta[p] if j == i else known[p], args) for j, (p, args) in enumerate(body)])
                fresh.setdefault(head, []).append(joined.select(*((F.col(a) if is_variable(a) else F.lit(a)).alias(f"a{k}") for k, a in enumerate(head_args))))
        delta = {}
        for pred, frames in fresh.items():
            found = reduce(DataFrame.union, frames).distinct()
            if pred in known:
                found = found.join(known[pred], found.columns, "left_anti")
            found = cut(found)
            if not found.isEmpty():
                delta[pred] = found
        if not delta:
            return known
        for pred, found in delta.items():
            known[pred] = (known[pred].union(found) if done % 8 else cut(known[pred].union(found))) if pred in known else found


def ask(facts: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Distinct bindings of a pattern such as ``ancestor(tom, ?x)``; a ground pattern gives a row if it holds."""
    pred, args = parse_atom(pattern)
    return atom_frame(facts[pred], args).distinct()


def graph_facts(edges: DataFrame) -> dict[str, DataFrame]:
    """One frame (a0, a1) for each edge type. The types are listed on the driver."""
    kinds = [r[0] for r in edges.select("type").distinct().collect()]
    return {k: edges.where(F.col("type") == k).select(F.col("src").cast("string").alias("a0"), F.col("dst").cast("string").alias("a1")) for k in kinds}


def prove(facts: dict[str, DataFrame], rules: list[str], goal: str, max_depth: int | None = None) -> bool:
    """Whether a ground goal follows, with only the rules that its predicate can reach."""
    parsed = [(r, parse_rule(r)) for r in rules]
    wanted, grown = {parse_atom(goal)[0]}, True
    while grown:
        more = {p for _, ((head, _), body) in parsed if head in wanted for p, _ in body} - wanted
        grown = bool(more)
        wanted |= more
    closed = datalog({p: f for p, f in facts.items() if p in wanted}, [r for r, ((head, _), _) in parsed if head in wanted], max_depth)
    pred, _ = parse_atom(goal)
    return pred in closed and not ask(closed, goal).isEmpty()


def hypotheses(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Abduction: ``observation, rule_id, score`` for rules (rule_id, conclusion, premises, plausibility) that would explain an observation; fewer premises score higher."""
    simple = 1 / (1 + F.size("premises"))
    return observations.join(rules, observations["observation"] == rules["conclusion"]).select("observation", "rule_id", (0.3 * simple + 0.7 * F.col("plausibility")).alias("score"))


def recursive_closure(spark: SparkSession, edges: DataFrame, max_depth: int = 20) -> DataFrame:
    """``src, dst``: pairs joined by a path of at most ``max_depth`` edges, as one recursive SQL query (``datalog`` gives the closure without a bound).

    ``LIMIT ALL`` lifts the session's bound on the rows of a recursion (a million by default).
    """
    edges.select("src", "dst").createOrReplaceTempView("loomgraph_edges")
    return spark.sql(f"WITH RECURSIVE c(src, dst, depth) AS (SELECT src, dst, 1 FROM loomgraph_edges UNION ALL SELECT c.src, e.dst, depth + 1 FROM c JOIN loomgraph_edges e ON c.dst = e.src WHERE depth < {max_depth}) SELECT DISTINCT src, dst FROM (SELECT src, dst FROM c LIMIT ALL)")
