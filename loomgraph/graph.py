"""A graph as two tables, and its common shapes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes(id, ...)`` and ``edges(src, dst, ...)``."""

    nodes: DataFrame
    edges: DataFrame


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` in both directions, without self-loops."""
    pair = edges.select("src", "dst").where("src <> dst")
    return pair.union(pair.select(F.col("dst"), F.col("src"))).distinct()


def simple_pairs(edges: DataFrame) -> DataFrame:
    """Each connected pair once, ``src < dst``."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
