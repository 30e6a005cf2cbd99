"""Bi-temporal facts and interval algebra. An open end is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import cut


def active_at(start: Column, end: Column, t: Column, closed: bool = False) -> Column:
    """start <= t < end (half-open) or start <= t <= end (closed); null bounds are open."""
    after = t <= end if closed else t < end
    return (start.isNull() | (start <= t)) & (end.isNull() | after)


def point_in_time(nodes: DataFrame, edges: DataFrame, t: Column, axis: str = "valid") -> DataFrame:
    """Edges active at ``t`` on the ``valid``, ``transaction`` or ``both`` axes whose two ends are active nodes."""
    on = {"valid": ["valid"], "transaction": ["recorded"], "both": ["valid", "recorded"]}[axis]
    bounds = {"valid": ("valid_from", "valid_until"), "recorded": ("recorded_at", "superseded_at")}

    def at(df: DataFrame) -> DataFrame:
        for k in on:
            lo, hi = bounds[k]
            if lo in df.columns:
                df = df.where(active_at(F.col(lo), F.col(hi), t))
        return df

    alive = at(nodes).select("id").distinct()
    return at(edges).join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dst"), "dst", "left_semi")


# Allen's relations of intervals that share more than an end, by the signs of a's start against b's and of a's end against b's.
SHARING = {
    (-1, -1): "overlaps", (-1, 0): "finished_by", (-1, 1): "contains",
    (0, -1): "starts", (0, 0): "equals", (0, 1): "started_by",
    (1, -1): "during", (1, 0): "finishes", (1, 1): "overlapped_by",
}


def allen(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The one of Allen's thirteen relations that holds between two closed-bound intervals; null if a bound is.

    Looked up by the signs of the bounds' comparisons. Intervals that share at most an end are told first, so that a
    point at another interval's bound meets it.
    """
    sign = lambda x, y: (x > y).cast("int") - (x < y).cast("int")
    grid = F.create_map(*(F.lit(v) for (s, e), name in SHARING.items() for v in (3 * s + e, name)))
    inside = F.element_at(grid, 3 * sign(a_start, b_start) + sign(a_end, b_end))
    gap = F.when(a_end <= b_start, F.element_at(F.array(F.lit("before"), F.lit("meets")), sign(a_end, b_start) + 2))
    gap = F.coalesce(gap, F.when(a_start >= b_end, F.element_at(F.array(F.lit("met_by"), F.lit("after")), sign(a_start, b_end) + 1)))
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    return F.when(known, F.coalesce(gap, inside))


def merge_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``key, start, end, parts``: overlapping and touching intervals of a key become one (gaps and islands)."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("island", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("island", F.sum("island").over(order))
    return marked.groupBy(key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("island")


def interval_gaps(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """``key, gap_start, gap_end`` between a key's merged intervals."""
    merged = merge_intervals(df, key, start, end)
    following = F.lead(start).over(W.partitionBy(key).orderBy(start))
    return merged.select(key, F.col(end).alias("gap_start"), following.alias("gap_end")).where("gap_end IS NOT NULL")


def coverage(df: DataFrame, key: str, lo: Column, hi: Column, start: str = "start", end: str = "end") -> DataFrame:
    """``key, coverage``: share of [lo, hi] that a key's intervals cover, between 0 and 1."""
    merged = merge_intervals(df, key, start, end)
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    part = F.greatest(F.lit(0.0), seconds(F.greatest(start, lo), F.least(end, hi)))
    return merged.groupBy(key).agg(F.least(F.lit(1.0), F.sum(part) / F.first(seconds(lo, hi))).alias("coverage"))


def interval_join(left: DataFrame, right: DataFrame, key: str, bucket_seconds: int) -> DataFrame:
    """Pairs of rows of one key with overlapping [l_start, l_end] and [r_start, r_end].

    Both sides are put into time buckets and joined on them, so no nested loop is planned; a pair is kept only in the
    bucket where the later of its starts lies, so it comes once.
    """
    slot = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    a = left.withColumn("slot", F.explode(F.sequence(slot(F.col("l_start")), slot(F.col("l_end")))))
    b = right.withColumn("slot", F.explode(F.sequence(slot(F.col("r_start")), slot(F.col("r_end")))))
    hit = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    return a.join(b, [key, "slot"]).where(hit & (F.col("slot") == slot(F.greatest("l_start", "r_start")))).drop("slot")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """Each left row with the last ``value`` of its key at or before its time: one union, one window, no range join."""
    kept = [c for c in left.columns if c not in (key, time)]
    a = left.select(key, time, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), *kept)
    b = right.select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__v"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in kept))
    order = W.partitionBy(key).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(out, F.last("__v", ignorenulls=True).over(order))
    return both.where("__side = 1").drop("__side", "__v")


def bucket_evolution(facts: DataFrame, unit: str, start: str = "start", end: str = "end") -> DataFrame:
    """``bucket, n_facts, n_types``: facts and distinct types alive in each calendar bucket."""
    buckets = F.explode(F.sequence(F.date_trunc(unit, F.col(start)), F.date_trunc(unit, F.col(end)), F.expr(f"interval 1 {unit}")))
    return facts.withColumn("bucket", buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("type").alias("n_types"))


def consistency_issues(facts: DataFrame) -> DataFrame:
    """``src, dst, type, issue``: inverted intervals, overlaps and gaps of equal edges."""
    order = W.partitionBy("src", "type", "dst").orderBy("start", "end")
    prior = facts.withColumn("prior", F.lag("end").over(order))
    issue = F.array_compact(F.array(F.when(F.col("start") > F.col("end"), F.lit("inverted_interval")), F.when(F.col("start") < F.col("prior"), F.lit("overlapping_same_edge")), F.when(F.col("start") > F.col("prior"), F.lit("gap_after_restart"))))
    return prior.select("src", "dst", "type", F.explode(issue).alias("issue"))


def temporal_paths(edges: DataFrame, source, target, max_edges: int = 4, ordering: str = "strict") -> DataFrame:
    """``path, n``: simple paths whose edges follow one another in time (strict: start >= the last start; overlap: start <= the last end)."""
    order = {"strict": "start >= last_start", "overlap": "start <= last_end", "loose": "true"}[ordering]
    links = edges.select("src", "dst", "start", "end")
    at = links.where(F.col("src") == F.lit(source)).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"), F.col("start").alias("last_start"), F.col("end").alias("last_end"))
    done = at.where(F.col("at") == F.lit(target))
    for _ in range(max_edges - 1):
        at = at.where(F.col("at") != F.lit(target)).join(links, at["at"] == links["src"]).where(order).where(~F.array_contains("path", F.col("dst")))
        at = at.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), F.col("start").alias("last_start"), F.col("end").alias("last_end"))
        done = done.union(at.where(F.col("at") == F.lit(target)))
    return done.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def time_cycles(edges: DataFrame, most: int = 7, gap_seconds: int | None = None) -> DataFrame:
    """``path, n``: closed walks of at most ``most`` edges (``src, dst, start, end``), each edge beginning when the last one has ended or later.

    As in sequence patterns, an edge is followed by the earliest one at its end node only (ties: the least node), so a
    step gives at most one row for each walk. ``n`` counts the walks with the same nodes.
    """
    following = sequences(edges, gap_seconds if gap_seconds is not None else 1 << 40)
    ends = edges.groupBy("src", "dst", "start").agg(F.min("end").alias("end"))
    step = following.select("src", "dst", "start", "end", F.col("next_dst").alias("to"), F.col("next_start").alias("to_start"))
    step = step.join(ends.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("start").alias("to_start"), F.col("end").alias("to_end")), ["dst", "to", "to_start"])
    at = edges.select(F.array("src", "dst").alias("path"), F.col("src").alias("p_src"), F.col("dst").alias("p_dst"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    closed = None
    for _ in range(most - 1):
        hit = (F.col("p_src") == F.col("src")) & (F.col("p_dst") == F.col("dst")) & (F.col("p_start") == F.col("start")) & (F.col("p_end") == F.col("end"))
        at = at.join(step, hit).select(F.concat("path", F.array("to")).alias("path"), F.col("dst").alias("p_src"), F.col("to").alias("p_dst"), F.col("to_start").alias("p_start"), F.col("to_end").alias("p_end"))
        done = at.where(F.col("path")[0] == F.col("p_dst")).select("path")
        closed = done if closed is None else closed.union(done)
        at = cut(at.where((F.col("path")[0] != F.col("p_dst")) & (F.size(F.array_distinct("path")) == F.size("path"))))
    return closed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def sequences(edges: DataFrame, gap_seconds: int) -> DataFrame:
    """Each edge with the earliest edge that starts at its end node within the gap after its end."""
    nxt = edges.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), F.col("start").alias("n_start"))
    hit = (F.col("n_start") >= F.col("end")) & (F.unix_seconds("n_start") - F.unix_seconds("end") <= gap_seconds)
    joined = edges.join(nxt, (F.col("dst") == F.col("n_src")) & hit)
    return joined.groupBy("src", "dst", "start", "end").agg(F.min(F.struct("n_start", "n_dst")).alias("nx")).select("src", "dst", "start", "end", F.col("nx.n_dst").alias("next_dst"), F.col("nx.n_start").alias("next_start"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, change, changed``: added, removed and modified rows with the names of their changed fields."""
    a = old.select(F.col(key).alias("ka"), F.struct(*fields).alias("a"))
    b = new.select(F.col(key).alias("kb"), F.struct(*fields).alias("b"))
    joined = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(F.size(changed) > 0, "modified")
    both = F.when(F.col("ka").isNotNull() & F.col("kb").isNotNull(), F.array_join(changed, ",")).otherwise("")
    return joined.select(F.coalesce("ka", "kb").alias(key), change.alias("change"), both.alias("changed")).where("change IS NOT NULL")


def apply_revision(facts: DataFrame, revisions: DataFrame, key: str) -> DataFrame:
    """Close the current fact of each revised key at its ``recorded_at`` and append the revision; nothing is deleted."""
    when = revisions.select(key, F.col("recorded_at").alias("closed"))
    old = facts.join(when, key, "left").withColumn("superseded_at", F.when(F.col("superseded_at").isNull(), F.col("closed")).otherwise(F.col("superseded_at"))).drop("closed")
    return old.unionByName(revisions, allowMissingColumns=True)


def timeline(facts: DataFrame, key: str) -> DataFrame:
    """``key, at, change``: a fact's start, revisions and end as ordered events."""
    events = F.explode(F.array(F.struct(F.col("valid_from").alias("at"), F.lit("added").alias("change")), F.struct(F.col("superseded_at").alias("at"), F.lit("modified").alias("change")), F.struct(F.col("valid_until").alias("at"), F.lit("removed").alias("change"))))
    return facts.select(key, events.alias("e")).select(key, "e.at", "e.change").where("at IS NOT NULL")


def retroactive(start: Column, end: Column, r_start: Column, r_end: Column) -> Column:
    """How a revision's span meets a fact's: affected (fact covers it), partial or unaffected."""
    return F.when((start <= r_start) & (end >= r_end), "affected").when((start < r_end) & (r_start < end), "partial").otherwise("unaffected")
