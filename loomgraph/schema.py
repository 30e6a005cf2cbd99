"""Canonical tables and the alias step that brings heterogeneous records to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_DDL = "id string, type string, name string, content string, confidence double, properties map<string,string>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp"
EDGE_DDL = "id string, src string, dst string, type string, weight double, confidence double, properties map<string,string>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp"
ENTITY_DDL = "id string not null, text string, type string, confidence double, start bigint, end bigint, metadata struct<keys:array<string>,values:array<string>>"
RELATION_DDL = "id string not null, source_id string not null, target_id string not null, type string, confidence double, metadata struct<keys:array<string>,values:array<string>>"

# The names under which records carry the same field, first match first.
ALIASES = {
    "id": ("id", "entity_id", "node_id", "name", "text"),
    "type": ("type", "entity_type", "label", "relationship_type"),
    "src": ("src", "source_id", "source", "subject", "from"),
    "dst": ("dst", "target_id", "target", "object", "to"),
}


def canonicalize(df: DataFrame, wanted: tuple[str, ...] = ("id", "type")) -> DataFrame:
    """Add each wanted field as the first non-null of its aliases that ``df`` has (as text); null if it has none."""
    out = df
    for name in wanted:
        present = [F.col(f"`{a}`").cast("string") for a in ALIASES[name] if a in df.columns]
        out = out.withColumn(name, F.coalesce(*present) if present else F.lit(None).cast("string"))
    return out
