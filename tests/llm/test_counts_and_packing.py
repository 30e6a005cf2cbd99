import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm.bpe_counts import HeapBpe, count_tokens
from loomgraph.llm.packing import Encoder, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
FAST = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(PATH)
BPE = HeapBpe(PATH)
ODD = [None, "", " ", "\n\n", "a" * 3000, "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>", "I'LL don't we've", "日本語 😀👍🏽", "½² ١٢٣", "  \t a  b\r\n", "word " * 2500]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library(text):
    assert BPE.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_every_code_point_splits_as_in_the_library():
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c}! {c}" for c in chars]
    fast = Encoder(PATH, FAST)
    for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert BPE.count(t) == len(e.ids)
        assert fast.encode(t).tolist() == e.ids


def test_count_tokens_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "x"), (None, "a b", "y")]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None:
            t = ODD[r.doc_id] or ""
            n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_bins(sizes):
    bins, offsets, fill = pack(np.array(sizes, np.int64), 64)
    assert (fill <= 64).all() and fill.sum() == sum(sizes)
    for b in range(len(fill)):
        at = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert all(x + n == y for (x, n), (y, _) in zip(at, at[1:], strict=False))


@pytest.mark.parametrize("partitions", [1, 20])
def test_packed_documents(spark, sf, partitions):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(3, "abc", 1), (None, "abc", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int").repartition(partitions)
    check(docs, pack_documents(docs, PATH, fast_vocabulary=FAST, block_pieces=3))


def test_packs_a_table_close_to_the_bound(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(10)
    out = pack_documents(docs, PATH, fast_vocabulary=FAST)
    frame = check(docs, out)
    assert frame.sequence_id.nunique() <= np.ceil(frame.length.sum() / 2048) + 3


def test_lanes_take_every_open_bin(spark):
    docs = spark.createDataFrame([(i, "word " * (1 + 37 * i % 900)) for i in range(200)], "doc_id long, text string").repartition(12)
    frame = check(docs, pack_documents(docs, PATH, fast_vocabulary=FAST, block_pieces=20, node_bins=3, fan_in=2))
    whole = check(docs, pack_documents(docs, PATH, fast_vocabulary=FAST))
    assert frame.sequence_id.nunique() <= 1.1 * whole.sequence_id.nunique()


def test_very_long_runs(spark):
    texts = [" " * 2_000_000, "a" + "\n" * 1_200_000 + "b", "\t" * 60_000 + "x " * 60_000, "z" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, pack_documents(docs, PATH, fast_vocabulary=FAST))


def test_nothing_to_pack(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def check(docs, out):
    frame = out.toPandas()
    expected = []
    for doc, text in docs.select("doc_id", "text").collect():
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cut = len(ids) % 2048
        starts = [0, *range(cut, len(ids), 2048)] if cut and len(ids) > 2048 else list(range(0, len(ids), 2048))
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((-1 if doc is None else doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    found = [tuple(int(v) for v in r) for r in frame.assign(doc_id=frame.doc_id.fillna(-1))[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(found) == sorted(expected)
    for _, g in frame.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    return frame
