"""Vector search, fusion and pooling on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators import retrieval as R
from loomgraph.queries import query, table

DOT = "list_sum(list_transform(generate_series(1, len(a)), lambda i: a[i]::DOUBLE * b[i]::DOUBLE))"
COS = "list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[])) + 1e-10)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(spark, d, label: int):
    """The mean vector of a label, as the query."""
    m = R.pool(_vectors(spark, d).where(F.col("label") == label), "label")
    return m.select("label", F.col("vector").alias("query"))


_MEAN = "(SELECT list(x ORDER BY i) AS b FROM (SELECT i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i) WHERE label = {} GROUP BY i))"


def _scored(spark, d, label: int, measure=S.cosine):
    q = F.broadcast(_query_vector(spark, d, label).select("query"))
    return _vectors(spark, d).crossJoin(q).withColumn("score", F.round(measure(F.col("vector"), F.col("query")), 6))


@query(f"SELECT id, score FROM (SELECT vec_id AS id, round({COS}, 6) AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings, {_MEAN.format(1)})) ORDER BY score DESC, id LIMIT 20")
def topk_cosine(spark, d):
    return _scored(spark, d, 1).orderBy(F.desc("score"), "id").limit(20).select("id", "score")


@query(f"SELECT id, score FROM (SELECT vec_id AS id, round({COS}, 6) AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings, {_MEAN.format(1)} WHERE label IN (2, 3))) ORDER BY score DESC, id LIMIT 10")
def topk_prefiltered(spark, d):
    return _scored(spark, d, 1).where("label IN (2, 3)").orderBy(F.desc("score"), "id").limit(10).select("id", "score")


@query(f"SELECT label, id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM (SELECT label, vec_id AS id, round({COS}, 6) AS score FROM (SELECT label, vec_id, embedding AS a, b FROM embeddings, {_MEAN.format(0)}))) WHERE r <= 5")
def topk_by_label(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy(F.desc("score"), "id")
    return _scored(spark, d, 0).withColumn("r", F.row_number().over(w)).where("r <= 5").select("label", "id", "score", "r")


@query("SELECT label, list(x ORDER BY i) AS vector FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i) GROUP BY label")
def pool_mean_by_label(spark, d):
    return R.pool(_vectors(spark, d), "label").select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("SELECT label, list(x ORDER BY i) AS vector FROM (SELECT label, i, round(max(embedding[i]::DOUBLE), 6) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i) GROUP BY label")
def pool_max_by_label(spark, d):
    return R.pool(_vectors(spark, d), "label", "max").select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


_LISTS = f"""va AS (SELECT vec_id AS id, round({COS}, 6) AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings, {_MEAN.format(1)})), vb AS (SELECT vec_id AS id, round({COS}, 6) AS score FROM (SELECT vec_id, embedding AS a, b FROM embeddings, {_MEAN.format(2)})),
ranked AS (SELECT 'vector' AS list, id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM va UNION ALL SELECT 'graph', id, score, row_number() OVER (ORDER BY score DESC, id) FROM vb)"""


def _ranked(spark, d):
    return R.rank_lists({"vector": _scored(spark, d, 1), "graph": _scored(spark, d, 2)})


@query(f"WITH {_LISTS} SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ranked GROUP BY id")
def rrf_fusion(spark, d):
    return R.reciprocal_rank_fusion(_ranked(spark, d)).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {_LISTS} SELECT id, round(sum(CASE list WHEN 'vector' THEN 0.7 ELSE 0.3 END * score::DOUBLE), 8) AS score FROM ranked GROUP BY id")
def weighted_fusion(spark, d):
    return R.weighted_fusion(_ranked(spark, d), {"vector": 0.7, "graph": 0.3}).select("id", F.round("score", 8).alias("score"))


@query(f"WITH {_LISTS}, s AS (SELECT list, id, (score - min(score) OVER (PARTITION BY list)) / (max(score) OVER (PARTITION BY list) - min(score) OVER (PARTITION BY list)) AS score FROM ranked) SELECT id, round(sum(0.5 * score), 6) AS score FROM s GROUP BY id")
def hybrid_alpha_merge(spark, d):
    return R.hybrid_merge(_ranked(spark, d)).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, round({COS}, 6) AS cosine, round(sqrt(list_sum(list_transform(list_zip(a, b), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 6) AS l2, round(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 6) AS l1 FROM (SELECT vec_id AS id, embedding AS a, b FROM embeddings, {_MEAN.format(4)})")
def vector_metrics(spark, d):
    q = F.broadcast(_query_vector(spark, d, 4).select("query"))
    v, x = F.col("vector"), F.col("query")
    return _vectors(spark, d).crossJoin(q).select("id", F.round(S.cosine(v, x), 6).alias("cosine"), F.round(S.euclidean(v, x), 6).alias("l2"), F.round(S.manhattan(v, x), 6).alias("l1"))


@query("SELECT label, round(avg(n), 6) AS mean_norm, count(*) AS n FROM (SELECT label, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) GROUP BY label")
def vector_norm_stats(spark, d):
    return _vectors(spark, d).groupBy("label").agg(F.round(F.avg(S.norm(F.col("vector"))), 6).alias("mean_norm"), F.count(F.lit(1)).alias("n"))


@query()
def hashed_text_embeddings(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.hashed_embedding(F.col("text"), 16).alias("vector"))
