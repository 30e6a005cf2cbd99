"""Chunkers: a text column to an array of ``struct(idx, start, end, text)``; ``end`` is exclusive, offsets are code points."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

CHUNK = "array<struct<idx:int,start:int,end:int,text:string>>"


def fixed_chunks(c: Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` after the last; no chunk lies wholly in the one before."""
    step, n = size - overlap, F.length(c)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct((s / step).cast("int").alias("idx"), s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end"), F.substring(c, s + 1, F.lit(size)).alias("text")))
    return F.when(n == 0, F.array().cast(CHUNK)).otherwise(cut)


def word_chunks(c: Column, size: int, overlap: int = 0) -> Column:
    """Arrays of ``struct(idx, text)`` of ``size`` words joined by blanks."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - overlap - 1), F.lit(step))
    return F.when(F.size(words) == 0, F.array().cast("array<struct<idx:int,text:string>>")).otherwise(F.transform(starts, lambda s: F.struct((s / step).cast("int").alias("idx"), F.array_join(F.slice(words, s + 1, F.lit(size)), " ").alias("text"))))


def sentences(c: Column) -> Column:
    """Sentences: text up to ``.``, ``!`` or ``?`` before white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def pack_parts(parts: Column, size: int, joiner: str = " ") -> Column:
    """Greedy packing of parts, in order, into texts of at most ``size`` characters (a longer part stands alone)."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + len(joiner) + F.length(part) <= size)
        grown = F.when(acc["now"] == "", part).otherwise(F.concat(acc["now"], F.lit(joiner), part))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(fits, grown).otherwise(part).alias("now"))

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def recursive_chunks(size: int, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")):
    """An Arrow UDF: a chunk that isn't the last ends after a separator that lies whole in its second half, the coarsest kind there and of these the last; without any at its size.

    All separators' ends are found first; a chunk's end is then looked up among them.
    """
    kinds = [(len(s), re.compile(f"(?={re.escape(s)})")) for s in separators]

    def spans(text: str) -> Iterator[tuple[int, int]]:
        ends = [np.fromiter((m.start() for m in pattern.finditer(text)), np.int64) + width for width, pattern in kinds]
        begin = 0
        while begin < len(text):
            full = begin + size
            if full >= len(text):
                yield begin, len(text)
                return
            last = ((int(e[k - 1]), width) for e, (width, _) in zip(ends, kinds, strict=True) if (k := np.searchsorted(e, full, side="right")))
            full = next((at for at, width in last if at - width >= begin + size // 2), full)
            yield begin, full
            begin = max(begin + 1, full - overlap)

    @pandas_udf(CHUNK)
    def chunk(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"idx": i, "start": a, "end": b, "text": t[a:b]} for i, (a, b) in enumerate(spans(t or ""))])

    return chunk


def token_chunks(c: Column, size: int, overlap: int = 0) -> Column:
    """Arrays of ``struct(idx, n, text)``: windows of ``size`` tokens (runs of letters, digits and ``_``, or single other signs), joined by blanks."""
    tokens = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), F.lit(0))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - overlap - 1), F.lit(step))
    cut = F.transform(starts, lambda s: F.struct((s / step).cast("int").alias("idx"), F.least(F.lit(size), F.size(tokens) - s).alias("n"), F.array_join(F.slice(tokens, s + 1, F.lit(size)), " ").alias("text")))
    return F.when(F.size(tokens) == 0, F.array().cast("array<struct<idx:int,n:int,text:string>>")).otherwise(cut)


def hierarchical_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, section, paragraph, sentence, text``: sections begin at headings, paragraphs at blank lines, sentences at their marks."""
    sections = df.select(id_col, F.posexplode(F.filter(F.split(text_col, r"(?m)^(?=#{1,6} )"), lambda s: F.trim(s) != "")).alias("section", "__s"))
    parts = sections.select(id_col, "section", F.posexplode(paragraphs(F.col("__s"))).alias("paragraph", "__p"))
    return parts.select(id_col, "section", "paragraph", F.posexplode(sentences(F.col("__p"))).alias("sentence", "text"))


def span_safe_chunks(df: DataFrame, spans: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, idx, start, end, text``: windows of ``size`` characters whose inner bounds move to the end of any span (``id, start, end``: an entity, a
    relation) that they would cut. A span that covers several bounds makes one chunk of them."""
    bounds = df.select(id_col, F.explode(F.sequence(F.lit(0), F.length(text_col), F.lit(size))).alias("at"), F.length(text_col).alias("__n"))
    # a bound meets the spans of its own stretch of text only: the spans are dealt to the multiples of ``size`` inside them
    crossed = spans.select(F.col(id_col), F.col("end").alias("__end"), F.explode(F.filter(F.sequence(F.floor(F.col("start") / size) + 1, F.greatest(F.floor(F.col("start") / size) + 1, F.floor((F.col("end") - 1) / size))), lambda k: k * size < F.col("end"))).alias("__k"))
    crossed = crossed.groupBy(id_col, (F.col("__k") * size).cast("int").alias("at")).agg(F.max("__end").alias("__end"))
    moved = bounds.join(crossed, [id_col, "at"], "left").select(id_col, F.least(F.coalesce("__end", "at"), "__n").cast("int").alias("at")).distinct()
    w = W.partitionBy(id_col).orderBy("at")
    cut = moved.select(id_col, F.col("at").alias("start"), F.lead("at").over(w).alias("end"))
    whole = df.select(id_col, F.col(text_col).alias("__t"), F.length(text_col).alias("__n"))
    out = cut.join(whole, id_col).withColumn("end", F.coalesce("end", "__n")).where("start < end")
    return out.select(id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("start")) - 1).alias("idx"), "start", "end", F.expr("substring(__t, start + 1, end - start)").alias("text"))


def structural_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, kind, section``: lines as heading, list, table, code fence or paragraph, with their running section number."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    kind = (
        F.when(F.trim("text") == "", "blank").when(F.col("text").rlike(r"^#{1,6} "), "heading").when(F.col("text").rlike(r"^\s*([-*+]|\d+\.) "), "list")
        .when(F.col("text").contains("|"), "table").when(F.col("text").startswith("```"), "fence").otherwise("paragraph")
    )
    return lines.withColumn("kind", kind).withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(W.partitionBy(id_col).orderBy("line"))).select(id_col, "line", "kind", "section")


def table_chunks(df: DataFrame, group: str, order: str, rows: int) -> DataFrame:
    """The rows of a table with ``chunk``: groups of so many rows, in the order of ``order``, within each ``group`` (a source table, a file)."""
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / rows))


def adjacent_chunks(chunks: DataFrame, doc: str, idx: str) -> DataFrame:
    """Chunks with the indices of their neighbours in the document."""
    w = W.partitionBy(doc).orderBy(idx)
    return chunks.withColumns({"previous": F.lag(idx).over(w), "following": F.lead(idx).over(w)})


def semantic_breaks(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``id, sentence, chunk``: a new chunk starts where the word Jaccard with the sentence before is under the threshold."""
    from loomgraph.functions.similarity import word_jaccard

    s = df.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("sentence", "text"))
    w = W.partitionBy(id_col).orderBy("sentence")
    before = F.lag("text").over(w)
    cut = s.withColumn("cut", F.when(before.isNull(), 0).otherwise((word_jaccard(before, F.col("text")) < threshold).cast("int")))
    return cut.withColumn("chunk", F.sum("cut").over(w)).select(id_col, "sentence", "chunk")
