"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.storage import Stored, store


def _least(edges: DataFrame) -> Stored:
    """``u, m``: the least neighbour of each node. Stored, so that the join on ``u`` reads two plain shuffles and adaptive execution can split a hub."""
    return store(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")


def _large(edges: DataFrame) -> Stored:
    """Each node's greater neighbours, linked to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    out = store(both.where("v > u").join(least.frame, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "cc-large")
    least.drop()
    return out


def _small(edges: DataFrame) -> Stored:
    """Each node's lesser neighbours (``edges`` run from greater to lesser), and the node, linked to the least of them."""
    least = _least(edges)
    moved = edges.join(least.frame, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = store(moved.union(least.frame.select("u", F.col("m").alias("v"))).distinct(), "cc")
    least.drop()
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> Stored:
    """``u, v``: each id in ``edges`` (columns ``u``, ``v``) that isn't its component's least one, with that least one.

    Self-loops, repeated edges and null ends are ignored; no edges give no rows. Every step is an aggregation and an
    equi-join of the edge list, stored in the shared folder; only a row count and a checksum reach the driver.
    """
    now = store(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(now.frame)
    while state[0]:
        grown = _large(now.frame)
        after = _small(grown.frame)
        grown.drop()
        now.drop()
        now, before, state = after, state, _state(after.frame)
        if state == before:
            break
    return now
