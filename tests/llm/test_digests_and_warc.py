import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import digests, warc


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_likeness_bounds_and_symmetry(a, b):
    x, y = digests.fingerprint(a), digests.fingerprint(b)
    assert digests.likeness(x, x) == 1.0 and 0.0 <= digests.likeness(x, y) <= 1.0
    assert digests.likeness(x, y) == digests.likeness(y, x)


def test_counts_equal_a_plain_loop():
    one, two, three = digests._tables()
    data = bytes(range(256)) * 3 + b"abc"
    want = [0] * 256
    for i in range(len(data) - 4):
        for k, (p, q) in enumerate(digests.TRIPLETS):
            want[int(one[data[i]] ^ two[data[i + p]] ^ three[data[i + q]]) ^ (41 * k) & 255] += 1
    assert digests.bucket_counts(data).tolist() == want


def test_blocks_of_long_texts_count_as_one(monkeypatch):
    data = bytes(range(256)) * 40
    whole = digests.fingerprint(data)
    for block in (1, 5, 999, len(data) - 4, len(data)):
        monkeypatch.setattr(digests, "BLOCK", block)
        assert digests.fingerprint(data) == whole


def test_texts_beyond_a_block(spark):
    rows = [(3, "abc def " * 200_000), (2, "é" * 1_500_000), (1, "short")]
    out = {r.doc_id: r for r in digests.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), partitions=2).collect()}
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert out[i].n_chars == len(t) and out[i].fingerprint == digests.fingerprint(t.encode())
        assert out[i].edited_sha256 == hashlib.sha256(digests.edited(t, f).encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_texts(spark, sf, partitions):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(10_000, None), (10_001, ""), (-5, "ab"), (-6, "日本語" * 5000)]
    out = digests.fingerprint_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, span int"), partitions=partitions).toPandas().set_index("doc_id")
    assert len(out) == len(rows)
    rows.sort(key=lambda r: -r[0])
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        e = digests.edited(t or "", f or "").encode()
        assert out.edited_sha256[i] == hashlib.sha256(e).hexdigest()
        assert out.fingerprint[i] == digests.fingerprint((t or "").encode())
        assert out.near_next[i] == digests.likeness(out.fingerprint[i], digests.fingerprint((f or "").encode()))
    assert (out.near_edited > out.near_next).mean() > 0.95


def test_few_rows(spark):
    assert digests.fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = digests.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string"), partitions=5).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    same = digests.fingerprint_documents(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "d")], "doc_id long, text string"), partitions=3)
    assert same.count() == 4


def test_archive_round_trip(spark, sf, tmp_path):
    rows = [(i, f"http://h/{i}", "x" * 150) for i in range(40)] + [(40 + i, None, "short") for i in range(5)] + [(60, "u", None), (61, "u", ""), (62, "u\r\nX: y", "é" * 60), (63, "u", "é" * 60)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    out = {r.page_id: r for r in warc.archive_round_trip(pages, folder=str(tmp_path / "w"), archive_bytes=3000).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(k for k, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 100 and i != first
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (out[i].record_type, out[i].refers_to) == (("revisit", first) if again else ("response", None))
    texts = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert texts[62].decode() == "é" * 60
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 3
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


class Slow(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_frames_and_checks():
    good = warc.record_bytes([("WARC-Type", "resource"), ("X", "1")], b"body\r\n\r\nmore")
    assert [r.block for r in warc.read_records(Slow(good * 3))] == [b"body\r\n\r\nmore"] * 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(good[:-5])))
    import gzip

    raw = gzip.decompress(good)
    for bad in (raw.replace(b"body", b"bodx"), raw.replace(b"Length: 12", b"Length: 11"), b"GET / HTTP"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_null_and_repeated_page_ids(spark):
    rows = [(None, "x" * 200), (None, "x" * 200), (5, "x" * 200), (5, "x" * 200), (6, "x" * 200), (7, "y" * 200), (None, "z" * 200)]
    out = warc.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    assert len(out) == len(rows) and sorted(r.page_id or 0 for r in out) == [0, 0, 0, 5, 5, 6, 7]
    by = {i: {(r.record_type, r.refers_to) for r in out if r.page_id == i} for i in (5, 6, 7)}
    assert by == {5: {("response", None)}, 6: {("revisit", 5)}, 7: {("response", None)}}
