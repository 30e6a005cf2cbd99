"""Bounded, repeatable samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def hashed_unit(*cols: str) -> Column:
    """A number in [0, 1) that follows from the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def rates(rows: DataFrame, class_col: str, most: dict | int) -> dict:
    """Share of each class to draw, so that about ``most`` rows of it are expected. One row a class reaches the driver."""
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    want = (lambda c: most.get(c, 0)) if isinstance(most, dict) else (lambda c: most)
    return {c: min(1.0, 1.1 * want(c) / n) for c, n in counts.items()}


def drawn(rows: DataFrame, class_col: str, by: dict, *key: str) -> DataFrame:
    """Rows whose hash lies under their class's rate: a filter, no shuffle."""
    rate = F.lit(0.0)
    for c, r in by.items():
        rate = F.when(F.col(class_col) == F.lit(c), F.lit(r)).otherwise(rate)
    return rows.where(hashed_unit(*key) < rate)


def trimmed(frame: pd.DataFrame, class_col: str, key: str, most: dict | int) -> pd.DataFrame:
    """At most ``most`` rows of each class, in an order that doesn't depend on partitions."""
    frame = frame.sort_values([class_col, key], kind="stable")
    want = frame[class_col].map(most) if isinstance(most, dict) else most
    return frame[frame.groupby(class_col).cumcount() < want].reset_index(drop=True)
