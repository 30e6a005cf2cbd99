"""String and vector similarities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    a, b = clean(a), clean(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _jaro(s: str, t: str) -> float:
    """Jaro with whole transpositions: an odd character out of order doesn't count (Winkler's definition, and DuckDB's)."""
    if s == t:
        return 1.0
    if not s or not t:
        return 0.0
    reach = max(0, max(len(s), len(t)) // 2 - 1)
    hit, found = [False] * len(t), []
    for i, c in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not hit[j] and t[j] == c:
                hit[j] = True
                found.append(c)
                break
    if not found:
        return 0.0
    other = [c for c, h in zip(t, hit, strict=True) if h]
    swaps = sum(a != b for a, b in zip(found, other, strict=True)) // 2
    m = len(found)
    return (m / len(s) + m / len(t) + (m - swaps) / m) / 3


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro with 0.1 for each of up to four equal leading characters, whatever the Jaro value."""

    def one(s: str | None, t: str | None) -> float | None:
        if s is None or t is None:
            return None
        j = _jaro(s, t)
        prefix = 0
        for x, y in zip(s[:4], t[:4]):
            if x != y:
                break
            prefix += 1
        return j + 0.1 * prefix * (1 - j)

    return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)])


def char_bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 2, F.array(c)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))))


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def bigram_similarity(a: Column, b: Column) -> Column:
    return set_jaccard(char_bigrams(clean(a)), char_bigrams(clean(b)))


def word_jaccard(a: Column, b: Column) -> Column:
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    return set_jaccard(words(a), words(b))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def pearson(a: Column, b: Column) -> Column:
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    ca, cb = F.transform(a, lambda x: x.cast("double") - mean(a)), F.transform(b, lambda x: x.cast("double") - mean(b))
    return dot(ca, cb) / (norm(ca) * norm(cb) + F.lit(1e-10))
