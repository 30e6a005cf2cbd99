"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per UTF-8 byte, held in a doubly linked list. A heap holds the adjacent pairs
that can merge, by rank and then place; the lowest is popped, its two symbols become one, and the pairs at both
sides are pushed anew. The count is the initial symbols minus the merges: no token identifiers are emitted.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The split pattern of byte-level BPE vocabularies in this file format (ByteLevel, use_regex).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pre-tokens whose counts a worker remembers, in two generations of half as many each.
MEMO_ENTRIES = 600_000
#: Longer pre-tokens are counted each time, so that the memo's bytes are bounded too.
MEMO_CHARS = 48


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others move past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


class HeapBpe:
    """Merge ranks of one byte-level vocabulary and the counts that follow from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in reversed([*enumerate(pairs)])}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.split = regex.compile(SPLIT_PATTERN)
        self.memo = _Memo(self)

    def merge_count(self, piece: str) -> int:
        """Tokens of one pre-token."""
        sym: list[bytes | None] = [bytes((b,)) for b in piece.encode("utf-8")]
        n, ranks = len(sym), self.ranks
        if n < 2:
            return n
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            a = sym[i]
            if a is None or (j := after[i]) < 0 or ranks.get((a, sym[j])) != rank:
                continue  # one of the two has merged meanwhile
            sym[i], sym[j] = (a := a + sym[j]), None
            merges += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((a, sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((sym[h], a))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string inside it counts as that one token."""
        if self.split_special is not None and any(s in text for s in self.specials):
            parts = self.split_special.split(text)
            return len(parts) - 1 + sum(self._count(p) for p in parts)
        return self._count(text)

    def _count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.split.findall(text)))


class _Memo(dict):
    """Counts by pre-token, in two generations, so that frequent ones outlive the clearing."""

    def __init__(self, bpe: HeapBpe):
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.bpe.merge_count(piece)
            if len(piece) > MEMO_CHARS:
                return n
        if len(self) >= MEMO_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


@lru_cache(maxsize=2)
def load_bpe(path: str) -> HeapBpe:
    """One per worker process: tasks of a reused worker share its memo."""
    return HeapBpe(path)


def count_tokens(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id, n_bytes long, n_tokens long, over_limit boolean`` for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids each give a row; other columns are
    ignored, whatever their names; no rows in, none out. One narrow pass: no shuffle, one Arrow batch in memory.
    ``vocabulary`` is a path that each worker can open (an installed file).
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(map(bpe.count, texts), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text: Column = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    return docs.select(F.col(id_col), text).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
