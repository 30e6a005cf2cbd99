"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random directions, shifts them by a random offset and orders them along a
Hilbert curve. Spark range-partitions each order into blocks of neighbouring keys. A query goes to the blocks around
its own place, each of which answers with its nearest by exact inner product; the answers of all windows and curves
merge.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.storage import store

#: Most vectors, by hash of their id, on which the projections' ranges are fitted.
FIT_ROWS = 10_000
#: Bits of a curve's key, over all axes; the rest of the 63 are a hash that parts equal places.
KEY_BITS = 46
#: Most blocks of a curve (their bounds reach the driver); beyond it blocks are dealt into sub-blocks by hash. Small tables have up to ``FINE`` blocks, so that windows come near their share.
MOST_BLOCKS, FINE, LEAST_ROWS = 4096, 72, 256
#: Queries that a task answers for its block.
QUERIES_A_TASK = 16_384


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows) with ``bits`` bits an axis: bit-wise, over all rows at once."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    # from the highest bit down, undo the reflections and exchanges of axes that the curve makes in each sub-cube
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        flip ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class Curves:
    """Projections, scales and shifts of several curves; keys of vectors on all of them."""

    def __init__(self, fitted: np.ndarray, width: int, curves: int, dims: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = min(dims, width)
        self.dims, self.bits = dims, min(11, KEY_BITS // dims)
        self.turns = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims] for _ in range(curves)]
        self.shifts = rng.random((curves, dims))
        self.low, self.span = [], []
        for turn in self.turns:
            p = fitted @ turn if len(fitted) else np.zeros((1, dims))
            lo, hi = np.quantile(p, [0.001, 0.999], axis=0)
            self.low.append(lo)
            self.span.append(np.where(hi > lo, hi - lo, 1.0))

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(rows, curves) keys: the curve's place, then bits of the id's hash, so that equal places can be parted."""
        salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
        out = np.empty((len(vectors), len(self.turns)), np.int64)
        for c, turn in enumerate(self.turns):
            unit = np.clip((vectors @ turn - self.low[c]) / self.span[c], 0, 1) * 0.5 + self.shifts[c] * 0.5
            cells = np.minimum((unit * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
            out[:, c] = (hilbert_keys(cells, self.bits) << np.uint64(17) | salt).view(np.int64)
        return out


def _usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(x, lambda v: v != 0)


def _stack(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 20,
    curves: int = 16,
    dims: int = 8,
    window: float = 0.055,
    block_rows: int = 4096,
    seed: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, id, score``: for each row of ``vectors`` with ``queries`` its ``k`` nearest other rows found.

    Nearness is the largest inner product in double precision, ties to the smaller id. A query finds fewer than ``k``
    only if fewer take part. Vectors that are null, empty or zero, or hold null or non-finite components, take no part,
    nor do rows without an id, nor those whose length isn't the most frequent one (ties: the longer). Rows that share
    an id count as one (the one whose vector sorts first). Other columns are ignored; no rows in, none out.

    ``window`` is the share of each curve's order that a query sees, so recall doesn't fall as the table grows (how
    narrow it can be depends on the vectors, see the README); the windows of all curves together are less than the
    table. Blocks are of bounded size. Equal vectors (one may fill a third of the table) are indexed and searched
    once: their ``k + 1`` least ids stand for them, which is all that any answer can use. A query's row is sent to the
    blocks of its window, the others to one block a curve.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    named = f"{id_col}" if id_col != "query_id" else "neighbour_id"
    result = f"query_id {kind}, rank int, {named} {kind}, score double"
    rows = vectors.where(_usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    # negative zero equals zero, and must as a grouping key
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(element)).otherwise(x)))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return spark.createDataFrame([], result)
    width = widths["width"]
    rows = rows.where(F.size("v") == width).groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.v", "r.q")
    held = [store(rows, "ann-rows")]
    rows = held[0].frame
    # one row for each distinct vector, with its k + 1 least ids: the limit acts before the shuffle, as one vector may be hot
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    ids = least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    unique = ids.join(rows.groupBy("v").agg(F.max("q").alias("q")), "v")
    held.append(store(unique.select(F.xxhash64(F.element_at("ids", 1)).alias("h"), F.element_at("ids", 1).alias("id"), "ids", "v", "q"), "ann-unique"))
    unique = held[-1].frame
    count = unique.count()
    sample = unique.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < min(1.0, 1.1 * FIT_ROWS / count)).select("id", "v").orderBy("id").limit(FIT_ROWS).toPandas()
    index = Curves(np.array(sample["v"].tolist(), np.float64).reshape(len(sample), -1), width, curves, dims, seed)
    sent = spark.sparkContext.broadcast(index)

    def keyed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = sent.value.keys(_stack(b.column(1)), np.asarray(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, c]) for c in range(curves)], names=[f"k{c}" for c in range(curves)])

    blocks = min(MOST_BLOCKS, max(1, math.ceil(count / block_rows), min(FINE, math.ceil(count / LEAST_ROWS))))
    subs = math.ceil(count / (blocks * block_rows))
    probs = [i / blocks for i in range(1, blocks)]
    if probs:
        keys = unique.select("h", "v").mapInArrow(keyed, ", ".join(f"k{c} bigint" for c in range(curves)))
        cuts = np.array(keys.agg(*(F.percentile_approx(f"k{c}", probs, 20 * blocks) for c in range(curves))).first(), np.int64)
    else:
        cuts = np.zeros((curves, 0), np.int64)
    ends = spark.sparkContext.broadcast(cuts)
    reach = min(blocks, max(1, math.ceil(window * blocks)))
    # a block's queries go to several tasks, each with the block's vectors, once they are more than a task should hold
    parts = max(1, math.ceil(unique.where("q").count() * reach / blocks / QUERIES_A_TASK))

    def dealt(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, q = sent.value.keys(_stack(b.column(2)), np.asarray(b.column(0))), np.asarray(b.column(3))
            h = np.asarray(b.column(0))
            for c in range(curves):
                at = np.searchsorted(ends.value[c], keys[:, c], side="right")
                first = np.clip(at - reach // 2, 0, blocks - reach)[q]
                own = at * subs + h % subs
                index = [*(np.arange(len(at)) for _ in range(parts)), *(np.flatnonzero(q) for _ in range(reach * subs))]
                to = np.concatenate([*(own * parts + i for i in range(parts)), *((first * subs + i) * parts + h[q] // subs % parts for i in range(reach * subs))])
                ask = np.arange(len(to)) >= len(at) * parts
                take = pa.array(np.concatenate(index))
                yield pa.RecordBatch.from_arrays([pa.array((to + c * blocks * subs * parts).astype(np.int64)), pa.array(ask), b.column(1).take(take), b.column(2).take(take)], names=["block", "ask", "id", "v"])

    near = "array<struct<s:double,id:" + kind + ">>"

    def search(block: pa.Table) -> pa.Table:
        ask, ids, v = np.asarray(block.column("ask")), block.column("id").to_pandas().to_numpy(), _stack(block.column("v"))
        here, x = ids[~ask], v[~ask]
        order = np.argsort(here, kind="stable")
        here, x = here[order], x[order]
        found, most = [], min(k + 1, len(here))
        asked = np.flatnonzero(ask)
        for at in range(0, len(asked) if most else 0, 256):
            q = v[asked[at : at + 256]]
            s = q @ x.T
            least = -np.partition(-s, most - 1, axis=1)[:, most - 1]
            for i, row in enumerate(s):
                # a hair below the bound: the product's sums may round otherwise than the exact ones
                near_ = np.flatnonzero(row >= least[i] - 1e-9 * (1 + abs(least[i])))
                exact = (x[near_] * q[i]).sum(axis=1)
                best = np.lexsort((near_, -exact))[:most]
                found.append([{"s": -float(exact[j]), "id": here[near_[j]]} for j in best])
        asked = asked if most else asked[:0]
        return pa.table({"id": pa.array(ids[asked], block.schema.field("id").type), "near": pa.array(found, pa.list_(pa.struct([("s", pa.float64()), ("id", block.schema.field("id").type)])))})

    placed = unique.select("h", "id", "v", "q").mapInArrow(dealt, f"block bigint, ask boolean, id {kind}, v array<{element}>")
    answers = placed.groupBy("block").applyInArrow(search, f"id {kind}, near {near}")
    # a vector is found by several curves and counts once; the limit acts before the shuffle too
    found = answers.select("id", F.inline("near").alias("s", "rep")).groupBy("id", "rep").agg(F.min("s").alias("s"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("s", "rep"))).where(F.col("n") <= k + 1)
    held.append(store(best.select("id", "s", "rep"), "ann-near"))
    # each found vector stands for its least ids
    others = held[-1].frame
    others = others.join(unique.select(F.col("id").alias("rep"), "ids"), "rep")
    lists = others.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s").alias("s"), i.alias("id")))))), 1, k + 1).alias("near"))
    asked = rows.where("q").select(F.col("id").alias("query_id"), "v").join(unique.select("id", "v"), "v").select("query_id", "id")
    final = asked.join(lists, "id").select("query_id", F.posexplode(F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, k)).alias("pos", "n"))
    out = store(final.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.id").alias(named), (-F.col("n.s")).alias("score")), "ann-out").frame
    for x in held:
        x.drop()
    return out


def brute_force(frame: pd.DataFrame, query_ids: list[int], k: int) -> pd.DataFrame:
    """The exact answer on a small frame (``id``, ``v``), for measuring recall."""
    ids, x = frame["id"].to_numpy(), np.array(frame["v"].tolist(), np.float64)
    out = []
    for q in query_ids:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out += [(q, r + 1, int(ids[i]), float(s[i])) for r, i in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "id", "score"])
