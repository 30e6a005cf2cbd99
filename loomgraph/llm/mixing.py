"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

DataFrame and SQL functions only. Documents fall into cells (source, language, topic). The cells' token weights are
raked, one marginal after another, until sources, languages and topics have their target shares. Each document is
then kept with its cell's probability, by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm.storage import store

AXES = ("source", "lang", "topic")
#: Target shares are the marginals to these powers, made to sum to 1: below 1 they lift what is rare.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
ROUNDS = 12
#: Expected share of all tokens that the sample keeps.
BUDGET = 0.7
UNKNOWN = "unknown"


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's form: table, code, listing, records or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    count = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    return (
        F.when(count("|") * 50 > size, "table")
        .when((count("{") + count(";")) * 100 > size, "code")
        .when(count("\n") * 25 > size, "listing")
        .when(count("@") > 0, "records")
        .otherwise("prose")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Multiply ``w`` until each axis has its target sums; ``targets``: axis to a table (axis, share). Shares sum to 1."""
    at = cells
    for axis, table in targets.items():
        at = at.join(table.select(axis, F.col("share").alias(f"share_{axis}")), axis)
    at = store(at, "mix-cells").frame
    for r in range(rounds):
        for axis in targets:
            at = at.withColumn("w", F.col("w") * F.col(f"share_{axis}") / F.sum("w").over(W.partitionBy(axis)))
        if r % 4 == 3:
            at = store(at, "mix-cells").frame
    return at


def mix(
    docs: DataFrame,
    *,
    powers: dict[str, float] | None = None,
    rounds: int = ROUNDS,
    budget: float = BUDGET,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """``id, source, lang, topic, tokens, probability, kept`` (and the columns of ``keep``) for every row of ``docs``.

    A token is a run without white space; a null or empty text has none. A null source or language is ``unknown``.
    Cells without tokens get probability 1 (their documents add nothing). Rows with equal ids share their draw, a null
    id draws as the empty text does. Other columns are ignored, whatever their names; no rows in, none out.

    Probabilities are the raked weights over the cells' tokens, scaled so that ``budget`` of all tokens is expected;
    a cell that would need more than all its documents gives all, and the others make up for it. Only the cell table
    (sources x languages x topics) is raked; documents are pre-aggregated before the shuffle and never shuffled
    themselves while that table is small enough for the engine to broadcast.
    """
    kept = [c for c in keep or [] if c not in (id_col, *AXES)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
        (topic if topic is not None else topic_of(text)).alias("topic"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), *(F.col(c).alias(f"kept_{c}") for c in kept),
    )
    cells = store(rows.groupBy(*AXES).agg(F.sum("tokens").alias("t")), "mix-counts").frame
    filled = cells.where("t > 0").withColumn("w", F.col("t") / F.sum("t").over(W.partitionBy(F.lit(1))))
    targets = {}
    for axis in AXES:
        sums = cells.where("t > 0").groupBy(axis).agg(F.pow(F.sum("t").cast("double"), F.lit((powers or POWERS)[axis])).alias("p"))
        targets[axis] = sums.select(axis, (F.col("p") / F.sum("p").over(W.partitionBy(F.lit(1)))).alias("share"))
    raked = rake(filled, targets, rounds).select(*AXES, "t", (F.col("w") / F.col("t")).alias("ratio"))
    chances = store(calibrate(raked, budget).select(*AXES, "probability"), "mix-chances").frame
    draw = (F.conv(F.substring(F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("double")) / F.lit(float(1 << 48))
    out = rows.join(chances, [*AXES], "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select(id_col, *AXES, "tokens", F.round("probability", 9).alias("probability"), (draw < F.col("probability")).alias("kept"), *(F.col(f"kept_{c}").alias(c) for c in kept))


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """``probability`` = min(1, c * ratio), with c such that the expected tokens are ``budget`` of all."""
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("ratio"), *AXES)
    whole = W.partitionBy(F.lit(1))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    c = cells.withColumns({
        "spent": F.coalesce(F.sum("t").over(before), F.lit(0)),
        "left": F.sum(F.col("ratio") * F.col("t")).over(whole) - F.coalesce(F.sum(F.col("ratio") * F.col("t")).over(before), F.lit(0.0)),
        "all": F.sum("t").over(whole),
    })
    # if the cells before this one give all, the others share what is left of the budget
    c = c.withColumn("c", (F.col("all") * budget - F.col("spent")) / F.col("left"))
    c = c.withColumn("scale", F.coalesce(F.first(F.when(F.col("c") * F.col("ratio") <= 1, F.col("c")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.lit(float("inf"))))
    return c.withColumn("probability", F.least(F.lit(1.0), F.col("scale") * F.col("ratio")))


def oracle_sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The DuckDB statement for ``mix`` with default parameters over ``documents``."""
    steps, at = [], "c0"
    for r in range(rounds):
        for axis in AXES:
            new = f"c{r}_{axis}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, t, w * s.share / sum(w) OVER (PARTITION BY {axis}) AS w FROM {at} JOIN share_{axis} s USING ({axis}))")
            at = new
    shares = ", ".join(f"share_{a} AS MATERIALIZED (SELECT {a}, p / sum(p) OVER () AS share FROM (SELECT {a}, pow(sum(t)::DOUBLE, {POWERS[a]}) AS p FROM cells WHERE t > 0 GROUP BY {a}))" for a in AXES)
    return rf"""
WITH texts AS (SELECT *, coalesce(text, '') AS x, greatest(length(coalesce(text, '')), 1) AS size FROM documents),
docs AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang, len(regexp_extract_all(x, '\S+'))::BIGINT AS tokens,
  CASE WHEN (length(x) - length(replace(x, '|', ''))) * 50 > size THEN 'table'
       WHEN (2 * length(x) - length(replace(x, '{{', '')) - length(replace(x, ';', ''))) * 100 > size THEN 'code'
       WHEN (length(x) - length(replace(x, chr(10), ''))) * 25 > size THEN 'listing'
       WHEN contains(x, '@') THEN 'records' ELSE 'prose' END AS topic FROM texts),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS t FROM docs GROUP BY ALL), {shares},
c0 AS MATERIALIZED (SELECT source, lang, topic, t, t / sum(t) OVER () AS w FROM cells WHERE t > 0),
{", ".join(steps)},
r AS MATERIALIZED (SELECT source, lang, topic, t, w / t AS ratio FROM {at}),
b AS (SELECT *, row_number() OVER o AS i, coalesce(sum(t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
  sum(ratio * t) OVER () - coalesce(sum(ratio * t) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(t) OVER () AS total FROM r WINDOW o AS (ORDER BY ratio DESC, source, lang, topic)),
k AS (SELECT *, (total * {budget} - spent) / rest AS c FROM b),
chance AS (SELECT source, lang, topic, least(1.0, ratio * (SELECT c FROM k WHERE c * ratio <= 1 ORDER BY i LIMIT 1)) AS p FROM k)
SELECT doc_id, source, lang, topic, tokens, round(coalesce(p, 1.0), 9) AS probability,
  ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < coalesce(p, 1.0) AS kept
FROM docs LEFT JOIN chance USING (source, lang, topic)"""
