"""Document fingerprints: quartile bucket digests over hashed byte triplets.

Every window of five bytes gives six triplets that hold its first byte; each is hashed into one of 256 buckets. A
bucket's count is written as two bits: the quartile of all counts it lies in. A header has a checksum of the bytes,
their length on a log scale and two quartile ratios. Digests compare by a difference score that is cut off at a
bound, so likeness lies in [0, 1].
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 256
#: Places of a triplet's second and third byte in the window; the first byte is the window's first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: The difference score at which likeness is 0; two unrelated digests differ by about 1.6 a bucket.
MOST = 2 * BUCKETS
LENGTH_WEIGHT, RATIO_WEIGHT = 6, 2
#: Bytes hashed at a time: bounds the memory of a very long text.
BLOCK = 1 << 20
#: Bytes of input (as the planner knows it, compressed in files) for a range of ids, and most ranges.
RANGE_BYTES, MOST_RANGES = 16 << 20, 8192


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Three random byte permutations, for tabulation hashing of a triplet."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(256) for _ in range(3)]).astype(np.uint8)


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket. Texts of one to four bytes are filled up with zero bytes to one window."""
    counts = np.zeros(BUCKETS, np.int64)
    if not data:
        return counts
    one, two, three = _tables()
    whole = np.frombuffer(data.ljust(5, b"\0"), np.uint8)
    for at in range(0, len(whole) - 4, BLOCK):
        x = whole[at : at + BLOCK + 4]
        n = len(x) - 4
        first, second, third = one[x[:n]], two[x], three[x]
        for k, (i, j) in enumerate(TRIPLETS):
            counts += np.bincount(first ^ second[i : i + n] ^ third[j : j + n] ^ np.uint8(41 * k), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Hex digest: checksum, length, quartile ratios (a byte each), then two bits a bucket."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return bytes((hashlib.blake2s(data, digest_size=1).digest()[0], length, ratios)).hex() + packed.astype(np.uint8).tobytes().hex()


@lru_cache(maxsize=1)
def _code_gap() -> np.ndarray:
    """Summed difference of two bytes of codes; opposite quartiles count double."""
    codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    gap = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(gap == 3, 6, gap).sum(axis=2).astype(np.int32)


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most what the header and the buckets can give."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    head = int(x[0] != y[0]) + LENGTH_WEIGHT * abs(x[1] - y[1]) // 2 + RATIO_WEIGHT * (abs((x[2] >> 4) - (y[2] >> 4)) + abs((x[2] & 15) - (y[2] & 15)))
    body = _code_gap()[np.frombuffer(x, np.uint8, offset=3), np.frombuffer(y, np.uint8, offset=3)].sum()
    return int(head + body)


def likeness(a: str, b: str) -> float:
    return 1.0 - min(difference(a, b), MOST) / MOST


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the first of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and likeness to the edited and to the next document's.

    Columns: ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next
    document is the one that follows by descending id (rows with equal ids: by text; null ids come last); after the
    last comes the first, so a single row is followed by itself. A null text is an empty one. Other columns are
    ignored. No rows in, none out.

    Rows are dealt into id ranges and sorted there, so one shuffle moves each text once; a range's first document is
    also sent to the range before it. A task reads its rows as a stream and holds two documents and one Arrow batch.
    Only the ranges' bounds (one or two ids a range, at most ``MOST_RANGES``) reach the driver; their number follows from
    the size of the input. Texts of any length are read whole. Rows of one id lie in one range.
    """
    spark = docs.sparkSession
    parts = partitions or _ranges(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType
    probs = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("id", probs, 100 * parts)).first()[0] if probs else []
    cuts = sorted(set(cuts or []), reverse=True)
    # range 0 has the largest ids: an id's range is the number of bounds above it; null ids lie below all
    array = F.array(*map(F.lit, cuts)).cast(T.ArrayType(kind)) if cuts else F.array().cast(T.ArrayType(kind))
    span = F.when(F.col("id").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(array, lambda c: c > F.col("id"))))
    rows = rows.withColumn("span", span.cast("int"))
    heads = rows.groupBy("span").agg(F.max("id").alias("head")).orderBy("span").collect()
    if not heads:
        return docs.sparkSession.createDataFrame([], _schema(id_col, kind))
    # a head (with rows of equal id) is sent to the range before its own as well; the first range's head ends the last range
    goes = {r["head"]: heads[i - 1]["span"] for i, r in enumerate(heads)}
    extra = F.lit(None).cast("int")
    if known := [(x, to) for x, to in goes.items() if x is not None]:
        before = F.create_map(*(F.lit(v) for pair in known for v in pair))
        extra = F.when(F.col("id").isin([x for x, _ in known]), F.element_at(before, F.col("id")))
    if None in goes:
        extra = F.coalesce(extra, F.when(F.col("id").isNull(), F.lit(goes[None])))
    place = lambda span, ahead: F.struct(span.cast("int").alias("span"), F.lit(ahead).alias("ahead"))
    dealt = rows.withColumn("to", F.when(extra.isNull(), F.array(place(F.col("span"), False))).otherwise(F.array(place(F.col("span"), False), place(extra, True))))
    dealt = dealt.select("id", "text", F.explode("to").alias("to")).select("id", "text", "to.span", "to.ahead")
    dealt = dealt.repartition(len(heads), "span").sortWithinPartitions("span", "ahead", F.col("id").desc_nulls_last(), F.xxhash64("text").desc(), F.length("text").desc())
    return dealt.select("id", "text", "span", "ahead").mapInArrow(_pairs(id_col, kind), _schema(id_col, kind))


def _ranges(docs: DataFrame) -> int:
    """As many ranges as there are shuffle partitions, and more if the planner's estimate of the input gives each over ``RANGE_BYTES``."""
    least, size = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 50 else min(MOST_RANGES, max(least, -(-size // RANGE_BYTES)))


def _schema(id_col: str, kind: T.DataType) -> T.StructType:
    return T.StructType.fromDDL(f"{id_col} {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _pairs(id_col: str, kind: T.DataType):
    """Reads ranges in order; a row is written when the one after it is known."""

    schema = to_arrow_schema(_schema(id_col, kind))

    def stream(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in groupby(stream(batches), key=lambda r: r[2]):
            held, ended = None, False
            for doc, text, _, ahead in rows:
                if ended:
                    continue  # copies of a range's head: one is enough
                digest = fingerprint(text.encode("utf-8"))
                if held is not None:
                    last, mine, own = held
                    other = edited(mine, text).encode("utf-8")
                    changed = fingerprint(other)
                    out.append((last, len(mine), hashlib.sha256(other).hexdigest(), own, changed, likeness(own, changed), likeness(own, digest)))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                held, ended = (doc, text, digest), bool(ahead)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run
