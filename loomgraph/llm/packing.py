"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each input partition packs its pieces best-fit (longest first) and closes the bins that are nearly full. The
underfull bins then go up a tree as items: each node takes the bins of ``fan_in`` children, packs them best-fit
into one another, closes what has become nearly full and hands the rest on, until one node is left. Only bin
sizes travel, never tokens.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe_counts import SPLIT_PATTERN
from loomgraph.llm.batches import slices
from loomgraph.llm.storage import Stored, store

CAPACITY = 2048
#: Longer runs of white space aren't given to tiktoken (its pattern backtracks over them; it fails near a million).
LONG_RUN = 50_000
_long_run = re.compile(r"\s{%d}" % LONG_RUN).search


class BestFit:
    """Best-fit into bins of integer capacity: a bit for each residual that some open bin has, so a fit is one bit scan."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.mask = 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def put(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item: the fullest open bin that holds it, else a new one."""
        if fit := self.mask >> size:
            left = size + (fit & -fit).bit_length() - 1
            at = self.open[left]
            k = at.pop()
            if not at:
                self.mask ^= 1 << left
        else:
            k, left = len(self.fill), self.capacity
            self.fill.append(0)
        offset = self.fill[k]
        self.fill[k] += size
        if rest := left - size:
            self.open[rest].append(k)
            self.mask |= 1 << rest
        return k, offset


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin. Ties keep the items' order."""
    fit, bins, offsets = BestFit(capacity), np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        bins[i], offsets[i] = fit.put(int(sizes[i]))
    return bins, offsets, np.array(fit.fill, np.int64)


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, as little-endian 32-bit bytes.

    ``fast`` names the same vocabulary as plain ranks: tiktoken then encodes, about four times as fast and with
    equal ids (tests compare code points and texts); texts that hold a special token's string, and texts with so long a run
    of white space that tiktoken's pattern would run out of stack, still go to ``tokenizers``.
    """

    def __init__(self, path: str, fast: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if fast:
            import tiktoken

            with open(fast, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.specials) or (len(text) > LONG_RUN and _long_run(text)):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4")


@lru_cache(maxsize=2)
def load_encoder(path: str, fast: str | None) -> Encoder:
    return Encoder(path, fast)


_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, fill bigint"


def _local(docs: DataFrame, encode, capacity: int, id_col: str, text_col: str, id_type: str, block_pieces: int) -> DataFrame:
    """Pieces with the bin and offset that their own partition gave them; a partition is packed in blocks of ``block_pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, held, n_bins = TaskContext.get().partitionId() << 40, [], 0

        def block() -> pd.DataFrame:
            nonlocal held, n_bins
            ids, piece, start, length, crc = zip(*held, strict=True)
            bins, offsets, fill = pack(np.array(length), capacity)
            out = pd.DataFrame({id_col: pd.Series(ids, dtype=object), "piece": piece, "start": start, "length": length, "ids_crc32": crc, "bin": bins + n_bins + first, "offset": offsets, "fill": fill[bins]})
            held, n_bins = [], n_bins + len(fill)
            return out

        enc = encode()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc(text), np.uint32(0)).astype("<u4")
                cut = len(ids) % capacity
                at = [0, *range(cut, len(ids), capacity)] if cut and len(ids) > capacity else [*range(0, len(ids), capacity)]
                for k, a in enumerate(at):
                    part = ids[a : at[k + 1] if k + 1 < len(at) else len(ids)]
                    held.append((doc, k, a, len(part), zlib.crc32(part.tobytes())))
            if len(held) >= block_pieces:
                yield pa.RecordBatch.from_pandas(block(), schema=arrow, preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(block(), schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"{id_col} {id_type}, {_PIECE}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    *,
    fast_vocabulary: str | None = None,
    capacity: int = CAPACITY,
    nearly_full: float = 0.995,
    fan_in: int = 8,
    block_pieces: int = 200_000,
    node_bins: int = 200_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row of ``docs``.

    A document is its ids and one id 0 at its end (a null or empty text: that id alone). Longer ones than
    ``capacity`` are cut, the first piece taking what is left over. Repeated rows and null ids are packed as rows of
    their own; other columns are ignored; no rows in, none out. Sequences are gapless from offset 0.

    Bounds: a task holds ``block_pieces`` sizes (not tokens). A node whose open bins are more than ``node_bins`` deals
    them in turn, by fill, into lanes of that size, and lanes of the same number meet in the next node: every open bin
    goes on to the root, and no task holds more than ``fan_in * node_bins``. The number of tree levels is
    log(partitions) to base ``fan_in``. Bin ids follow from partition and order and are stored before anything reads
    them, so a task that runs again changes nothing. Texts of any length are read whole.
    """
    encode = lambda: load_encoder(vocabulary, fast_vocabulary).encode
    held = [store(_local(docs, encode, capacity, id_col, text_col, docs.schema[id_col].dataType.simpleString(), block_pieces), "pack-leaf")]
    leaf = held[0].frame
    closed = int(capacity * nearly_full)
    bins = leaf.where(F.col("offset") == 0).select("bin", "fill")
    open_bins = bins.where(F.col("fill") < closed).withColumn("node", F.shiftright("bin", 40)).withColumn("lane", F.lit(0))
    width = int(open_bins.agg(F.max("node")).first()[0] or 0) + 1
    moves: list[DataFrame] = []
    level: Stored | None = None
    while True:
        width = -(-width // fan_in)

        def node(key, frame):
            frame = frame.sort_values(["fill", "bin"], ascending=False, kind="stable")
            names, sizes = frame["bin"].to_numpy(), frame["fill"].to_numpy()
            to, offset, fill = pack(sizes, capacity)
            head = np.full(len(fill), -1, np.int64)
            at_start = offset == 0
            head[to[at_start]] = names[at_start]
            order = np.lexsort((head, -fill))
            rest = order[fill[order] < closed]
            lane = np.full(len(fill), -1, np.int32)
            lane[rest] = np.arange(len(rest)) % max(1, -(-len(rest) // node_bins))
            return pd.DataFrame({"bin": names, "to_bin": head[to], "shift": offset, "fill": fill[to], "lane": lane[to], "node": key[0]})

        grouped = open_bins.withColumn("node", F.floor(F.col("node") / fan_in).cast("long")).groupBy("node", "lane")
        level = store(grouped.applyInPandas(node, "bin bigint, to_bin bigint, shift bigint, fill bigint, lane int, node bigint"), "pack-level")
        held.append(level)
        moves.append(level.frame.select("bin", "to_bin", "shift"))
        if width <= 1:
            break
        open_bins = level.frame.where((F.col("lane") >= 0) & (F.col("shift") == 0)).select(F.col("to_bin").alias("bin"), "fill", "node", "lane")
    placed = leaf.join(_compose(moves), "bin", "left").select(
        id_col, "piece", "start", "length", "ids_crc32", F.coalesce("to_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
    out = store(placed, "pack-out").frame
    for x in held:
        x.drop()
    return out


def _compose(moves: list[DataFrame]) -> DataFrame:
    """Where each leaf bin lies at the end: the levels' moves, one after another, from the root down."""
    last = moves[-1]
    for m in reversed(moves[:-1]):
        up = last.select(F.col("bin").alias("to_bin"), F.col("to_bin").alias("top"), F.col("shift").alias("more"))
        last = m.join(up, "to_bin", "left").select("bin", F.coalesce("top", "to_bin").alias("to_bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    return last
