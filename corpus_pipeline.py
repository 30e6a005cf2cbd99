"""The corpus pipeline: toxicity, language, near-duplicates, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns the columns of
``documents``; the last one returns packed pieces. ``run`` writes every stage's result and hands on the reread table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, minhash, mixing, packing, toxicity
from loomgraph.llm.storage import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose likeliest language has less than this share of its words has no language of its own.
LEAST_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled rows, doesn't predict toxic.

    Null and empty texts score as a middling clean document and stay; repeated rows are each judged, alike; long texts
    are read whole; other columns than those of ``documents`` are left out; no rows in, none out.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(COLUMNS)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and one language that has at least half of their words.

    So null and empty texts go, and so does everything if no document names its language. Repeated rows are each
    judged, alike; long texts are read whole; other columns are left out; no rows in, none out.
    """
    found = language.identify(docs, language.train(docs), keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select(COLUMNS)


def _ids(frame: DataFrame, label: str) -> DataFrame:
    """The ids, stored; marked for a broadcast up to a counted size, so that joins with them don't shuffle the texts."""
    stored = store(frame, label).frame
    return F.broadcast(stored) if stored.count() <= minhash.BROADCAST_IDS else stored


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one of least id.

    Rows without an id take part under a hash of their text that lies above all other ids. Rows of one id are one
    document; of those with equal texts one stays. Texts without words have no duplicates. Other columns are left
    out; no rows in, none out.
    """
    own = F.coalesce(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)).alias("own")
    keyed = docs.select(*COLUMNS, own)
    gone = _ids(minhash.near_duplicates(keyed, words=5, percent=80, id_col="own").where("NOT kept").select("own").distinct(), "gone")
    left = keyed.join(gone, "own", "left_anti")
    repeated = _ids(keyed.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("own"), "repeated")
    once = left.join(repeated, "own", "left_anti").select(COLUMNS)
    return once.union(left.join(repeated, "own", "left_semi").dropDuplicates(["own", "text"]).select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that rake tokens to the target shares.

    Null sources and languages are a value of their own; texts without words always stay; rows of one id share their
    draw; other columns are left out; no rows in, none out.
    """
    whole = docs.select(*COLUMNS, F.struct(*COLUMNS).alias("document"))
    return mixing.mix(whole, keep=["document"]).where("kept").select("document.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of at most 2048 tokens.

    A null or empty text is its end token alone; repeated rows and null ids are packed as rows of their own; long
    texts are cut into pieces; other columns are left out; no rows in, none out.
    """
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), fast_vocabulary=path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and packing aren't SQL: the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        done = store(stage(spark, docs, sf_dir), f"stage-{name}")
        if held:
            held.drop()
        docs, held = done.frame, done
    return docs
