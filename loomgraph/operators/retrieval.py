"""Exact vector search, fusion of rankings, pooling and hybrid retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.similarity import cosine, norm
from loomgraph.storage import cut

#: Bands of scores in which a ranked list is numbered.
BANDS = 4096
#: Most query vectors that are broadcast.
BROADCAST_QUERIES = 20_000


def search(vectors: DataFrame, query: list[float], k: int, *, where: Column | None = None, id_col: str = "id", vector_col: str = "vector", measure=cosine) -> DataFrame:
    """The k rows most like a query vector; metadata filters come before the ranking. One scan and a top-k."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", measure(F.col(vector_col), q)).orderBy(F.desc("score"), id_col).limit(k)


def search_batch(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``query_id, id, score, rank`` for a set of queries (``query_id, query``) against all vectors.

    Up to ``BROADCAST_QUERIES`` queries are sent to the vectors' partitions, more are compared block by block; either way
    partitions keep only ``k`` rows a query before the shuffle.
    """
    few = queries.count() <= BROADCAST_QUERIES
    pairs = vectors.select(id_col, vector_col).crossJoin(F.broadcast(queries) if few else queries).where(F.col("query_id") != F.col(id_col))
    scored = pairs.select("query_id", id_col, cosine(F.col(vector_col), F.col("query")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col))).where(F.col("rank") <= k)


def rank_lists(lists: dict[str, DataFrame], id_col: str = "id") -> DataFrame:
    """Ranked lists (id, score) as one frame ``list, id, score, rank``; ties by id, null scores last.

    Lists of any length: scores are dealt into bands between a list's least and largest, rows are numbered within
    their band, and the rows of the bands above are counted (at most ``BANDS`` counts a list, broadcast).
    """
    all_ = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("list"), id_col, "score") for name, df in lists.items()))
    all_ = cut(all_)  # three readers; the scores are worked out once
    ends = all_.groupBy("list").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    banded = all_.join(F.broadcast(ends), "list").withColumn("band", F.when(F.col("score").isNull(), -1).otherwise(F.floor(share * (BANDS - 2)).cast("int"))).drop("lo", "hi")
    counts = banded.groupBy("list", "band").agg(F.count(F.lit(1)).alias("c"))
    above = counts.withColumn("above", F.coalesce(F.sum("c").over(W.partitionBy("list").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    within = F.row_number().over(W.partitionBy("list", "band").orderBy(F.desc("score"), id_col))
    return banded.withColumn("r", within).join(F.broadcast(above), ["list", "band"]).select("list", id_col, "score", (F.col("above") + F.col("r")).cast("int").alias("rank"))


def reciprocal_rank_fusion(ranked: DataFrame, k: int = 60, id_col: str = "id") -> DataFrame:
    return ranked.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted_fusion(ranked: DataFrame, weights: dict[str, float], id_col: str = "id") -> DataFrame:
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return ranked.groupBy(id_col).agg(F.sum(F.try_element_at(w, F.col("list")) * F.col("score")).alias("score"))


def minmax_by(df: DataFrame, group: str, value: str = "score") -> DataFrame:
    """``value`` scaled to [0, 1] inside each group; unchanged where all are equal."""
    ends = df.groupBy(F.col(group).alias("__g")).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col(value))
    return df.join(ends, F.col(group).eqNullSafe(F.col("__g"))).withColumn(value, scaled).drop("__g", "__lo", "__hi")


def hybrid_merge(ranked: DataFrame, alpha: float = 0.5, id_col: str = "id") -> DataFrame:
    """Lists ``vector``, ``graph`` and ``memory``, scaled each, weighted 1 - alpha, alpha and 0.3, summed by id."""
    return weighted_fusion(minmax_by(ranked, "list"), {"vector": 1 - alpha, "graph": alpha, "memory": 0.3}, id_col)


def pool(vectors: DataFrame, group: str, how: str = "mean", vector_col: str = "vector") -> DataFrame:
    """``group, vector``: element-wise mean, max or the first row's vector."""
    if how == "first":
        return vectors.groupBy(group).agg(F.min_by(vector_col, "id").alias("vector"))
    agg = {"mean": F.avg, "max": F.max}[how]
    parts = vectors.select(group, F.posexplode(vector_col).alias("pos", "x")).groupBy(group, "pos").agg(agg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))


def normalized(c: Column) -> Column:
    n = norm(c)
    return F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)


def hashed_embedding(c: Column, dims: int = 32) -> Column:
    """A deterministic text embedding: counts of hashed words, L2-normalised."""
    slots = F.transform(F.filter(F.split(F.lower(c), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    return normalized(counts)


def keyword_search(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """``score``: share of the query's words that a text contains; rows without any are dropped."""
    hits = sum((F.lower(F.col(text_col)).contains(w.lower()).cast("int") for w in words), F.lit(0))
    return docs.withColumn("score", hits / len(words)).where("score > 0")


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``token, id, n``."""
    tokens = F.explode(F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return docs.select(id_col, tokens.alias("token")).groupBy("token", id_col).agg(F.count(F.lit(1)).alias("n"))


def history(messages: DataFrame, conversation: str, order: str, k: int) -> DataFrame:
    """The last ``k`` messages of each conversation."""
    return messages.withColumn("r", F.row_number().over(W.partitionBy(conversation).orderBy(F.desc(order)))).where(F.col("r") <= k).drop("r")


def retention(items: DataFrame, time: str, cutoff: Column) -> DataFrame:
    return items.where(F.col(time) >= cutoff)
