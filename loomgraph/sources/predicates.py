"""Row predicates compiled to columns, so that Catalyst pushes them to the scan."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def comparison(name: str, op: str, value) -> Column:
    col = F.col(name)
    if op in _COMPARE:
        return _COMPARE[op](col, F.lit(value))
    if op == "in":
        return col.isin(list(value))
    if op in ("not in", "not_in"):
        return ~col.isin(list(value))
    raise ValueError(f"unknown operator {op!r}")


def dnf(filters) -> Column:
    """A tuple, a list of tuples (all must hold) or a list of such lists (one must hold)."""
    if isinstance(filters, tuple):
        return comparison(*filters)
    if not filters:
        return F.lit(True)
    if isinstance(filters[0], tuple):
        return reduce(operator.and_, (comparison(*f) for f in filters))
    return reduce(operator.or_, (dnf(group) for group in filters))


def metadata_filter(conditions: Sequence[tuple[str, str, object]], column=F.col) -> Column:
    """All of eq, ne, gt, gte, lt, lte, in, contains. A missing field fails every operator, ``ne`` too.

    ``contains`` is a substring test on text and membership on arrays (``column`` must give the right type).
    """
    ops = {
        "eq": lambda c, v: c == F.lit(v), "ne": lambda c, v: c != F.lit(v), "gt": lambda c, v: c > F.lit(v), "gte": lambda c, v: c >= F.lit(v),
        "lt": lambda c, v: c < F.lit(v), "lte": lambda c, v: c <= F.lit(v), "in": lambda c, v: c.isin(list(v)),
        "contains": lambda c, v: c.contains(F.lit(v)), "has": lambda c, v: F.array_contains(c, F.lit(v)),
    }
    terms = []
    for name, op, value in conditions:
        if op not in ops:
            raise ValueError(f"unknown operator {op!r}")
        c = column(name)
        terms.append(c.isNotNull() & F.coalesce(ops[op](c, value), F.lit(False)))
    return reduce(operator.and_, terms, F.lit(True))
