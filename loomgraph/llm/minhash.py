"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters shingles over a universe of 2**32 places, the
second, shifted circularly by one place a coordinate, gives the values whose minimum is kept. Bands of coordinates
are bucket keys; documents that share a bucket are candidates, and each link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.storage import Stored, store

COORDINATES, BANDS = 288, 48
#: Candidates whose signatures agree on a share of their coordinates that is this much under the similarity asked for
#: aren't confirmed: at 0.8, five standard deviations (288 coordinates, one byte each).
SLACK = 0.12
#: A bucket is compared as pairs of blocks, each of about so many members or so many shingles, whichever is less.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000
#: Up to so many document ids (8 bytes each) are broadcast to pick texts to confirm; beyond it they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Word hashes that a worker remembers.
MEMO_ENTRIES = 300_000

_U64 = np.uint64
_words: dict[bytes, int] = {}


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words: the first permutation."""
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words, in place: the second permutation."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``words`` words.

    A to Z are lower-cased; words are runs without space, tab, LF, VT, FF and CR. With fewer words the whole sequence is
    the one shingle; without words the set is empty.
    """
    tokens = text.encode("utf-8").lower().split()
    if not tokens:
        return np.zeros(0, _U64)
    if len(_words) > MEMO_ENTRIES:
        _words.clear()
    h = np.empty(len(tokens), _U64)
    for i, t in enumerate(tokens):
        x = _words.get(t)
        if x is None:
            x = xxhash.xxh3_64_intdigest(t)
            if len(t) <= 40:
                _words[t] = x
        h[i] = x
    n = min(words, len(tokens))
    total = np.zeros(len(tokens) - n + 1, _U64)
    for j in range(n):
        total = _mix64(total + h[j : j + len(total)] + _U64(0x9E3779B97F4A7C15 + j))
    if n < words:
        total = _mix64(total + _U64(n))
    return np.unique(total)


def signature(found: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least second permutation of (first permutation + k) mod 2**32."""
    places = _mix64(found + _U64(0x632BE59BD9B4E019)).astype(np.uint32)
    shifts, best = np.arange(coordinates, dtype=np.uint32), np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(best, _mix32(places[at : at + 512, None] + shifts).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of coordinates."""
    rows = sig.astype(_U64).reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=_U64)
    for j in range(rows.shape[1]):
        key = _mix64(key * _U64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def sketch(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, digest, bands, sig`` of every row; the last three are null for empty sets. One narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, texts = b.column(0).slice(at, 1000), b.column(1).slice(at, 1000).to_pylist()
                n, digest, bands, sig = [], [], [], []
                for t in texts:
                    found = shingles(t, words)
                    n.append(len(found))
                    if not len(found):
                        digest.append(None), bands.append(None), sig.append(None)
                        continue
                    s = signature(found)
                    digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_keys(s))
                    sig.append(s.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "n", "digest", "bands", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, n bigint, digest binary, bands array<bigint>, sig binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal coordinates; ``a`` and ``b`` broadcast against each other."""
    return (a == b).mean(axis=-1)


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int, kind: str) -> DataFrame:
    """Pairs ``u, v`` of (u, nu, v) whose sizes allow the similarity and whose signatures come near it."""
    least = percent / 100 - SLACK
    sized = pairs.join(reps.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv")), "v")
    sized = sized.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    sized = sized.join(reps.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su")), ["u", "nu"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_agreement(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return sized.select("u", "v", "su", "sv").mapInArrow(run, f"u {kind}, v {kind}")


def _sets(ids: DataFrame, texts: DataFrame, words: int, kind: str) -> Stored:
    """``id, set``: the full shingle sets of the documents in ``ids``. ``texts`` (id, text) is shuffled only if they are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), pa.array([shingles(t, words).tobytes() for t in b.column(1).slice(at, 500).to_pylist()], pa.binary())], names=["id", "set"])

    wanted = store(ids.select("id").distinct(), "minhash-wanted")
    few = wanted.frame.count() <= BROADCAST_IDS
    out = store(texts.join(F.broadcast(wanted.frame) if few else wanted.frame, "id", "left_semi").mapInArrow(run, f"id {kind}, set binary"), "minhash-sets")
    wanted.drop()
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int, kind: str) -> Stored:
    """Pairs whose full shingle sets have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard_at_least(np.frombuffer(x.as_buffer(), _U64), np.frombuffer(y.as_buffer(), _U64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    found = _sets(pairs.select(F.col("u").alias("id")).union(pairs.select("v")), texts, words, kind)
    left, right = (found.frame.select(F.col("id").alias(x), F.col("set").alias(s)) for x, s in (("u", "su"), ("v", "sv")))
    links = store(pairs.join(left, "u").join(right, "v").select("u", "v", "su", "sv").mapInArrow(check, f"u {kind}, v {kind}"), "minhash-links")
    found.drop()
    return links


def _members(reps: DataFrame) -> Stored:
    """``key, id, n, size, center`` of each bucket that holds several sets: ``center`` is the bucket's least id."""
    placed = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = store(placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("center")).where("size > 1"), "minhash-buckets")
    out = store(placed.join(buckets.frame, "key"), "minhash-members")
    buckets.drop()
    return out


def _blocks(members: DataFrame, labels: DataFrame, reps: DataFrame) -> Stored:
    """Rows ``key, i, j, outer, inside, id, label, n, sig, prints`` of the buckets that hold several components.

    The members outside a bucket's largest component are dealt into blocks ``i``, all its members into blocks ``j``, by
    their hash; a member goes to each pair of blocks that it is part of. So no task holds more than two blocks.
    """
    named = members.where("size > 2").join(labels.select(F.col("u").alias("id"), F.col("v").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = store(named.select("key", "id", "n", "label"), "minhash-named")
    by_label = named.frame.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    whole = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("c").alias("top")).where("k > 1")
    largest = by_label.join(whole.select("key", F.col("top").alias("c")), ["key", "c"]).groupBy("key").agg(F.min("label").alias("largest"))
    outside = by_label.withColumnsRenamed({"c": "oc", "s": "os"}).join(largest, "key").where("label <> largest").groupBy("key", "largest").agg(F.sum("oc").alias("oc"), F.sum("os").alias("os"))
    parts = lambda c, s: F.ceil(F.greatest(F.col(c) / BLOCK_ROWS, F.col(s) / BLOCK_SHINGLES)).cast("int")
    dealt = store(outside.join(whole, "key").select("key", "largest", parts("oc", "os").alias("ni"), parts("c", "s").alias("nj")), "minhash-dealt")
    rows = named.frame.join(dealt.frame, "key").withColumn("inside", F.col("label") == F.col("largest"))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    copies = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: F.struct(F.lit(False).alias("outer"), i.alias("i"), at("nj").alias("j")))
    outer = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: F.struct(F.lit(True).alias("outer"), at("ni").alias("i"), j.alias("j")))
    spots = F.when(F.col("inside"), copies).otherwise(F.concat(copies, outer))
    rows = rows.select("key", "id", "n", "label", "inside", F.inline(spots))
    prints = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("prints")
    out = store(rows.join(reps.select("id", "n", "sig", prints), ["id", "n"]), "minhash-blocks")
    named.drop()
    dealt.drop()
    return out


def _candidates(block: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (outer, member) of a pair of blocks, and their agreement: of different components, by sizes and
    signatures near the similarity. A pair of documents is taken up in one bucket only, the one of its first common band."""
    outer, inside, n = (block.column(c).to_numpy() for c in ("outer", "inside", "n"))
    ids, (_, code) = block.column("id").to_numpy(), np.unique(block.column("label").to_numpy(), return_inverse=True)
    sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    prints = np.array(block.column("prints").combine_chunks().flatten()).reshape(len(n), -1)
    here = block.column("key")[0].as_py() >> 32
    rows, cols, least = np.flatnonzero(outer), np.flatnonzero(~outer), percent / 100 - SLACK
    found, step = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))], max(1, 50_000 // max(1, len(cols)))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        fits = (code[i, None] != code[cols]) & (np.minimum(n[i, None], n[cols]) * 100 >= percent * np.maximum(n[i, None], n[cols])) & (inside[cols] | (ids[i, None] > ids[cols]))
        x, y = np.nonzero(fits)
        x, y = i[x], cols[y]
        near = _agreement(sig[x], sig[y])
        x, y, near = x[near >= least], y[near >= least], near[near >= least]
        first = (prints[x] == prints[y]).argmax(axis=1)
        mine = prints[x, first] == here
        found.append((x[mine].astype(np.int32), y[mine].astype(np.int32), near[mine].astype(np.float32)))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _across(blocks: DataFrame, texts: DataFrame, words: int, percent: int, kind: str) -> Stored:
    """Links ``u, v`` between different components of a bucket: enough of them to join all that are linked there.

    First the rows that have a candidate are found by sizes and signatures alone; only they get their full sets. Then
    the candidates of a pair of blocks are confirmed, likeliest first, unless links found before already join them: so
    a pair of blocks gives fewer links than it has members, however many of its pairs are alike.
    """
    schema = f"key bigint, i int, j int, outer boolean, inside boolean, id {kind}, label {kind}, n bigint, sig binary, prints array<int>"
    names = ["key", "i", "j", "outer", "inside", "id", "label", "n", "sig", "prints"]

    def busy(block: pa.Table) -> pa.Table:
        x, y, _ = _candidates(block, percent)
        return block.take(pa.array(np.unique(np.concatenate((x, y))).astype(np.int64))).select(names)

    def run(block: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), _U64) for x in block.column("set")]
        ids, code = block.column("id").to_numpy(), np.unique(block.column("label").to_numpy(), return_inverse=True)[1]
        up = list(range(len(ids)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        x, y, near = _candidates(block, percent)
        us, vs = [], []
        for k in np.argsort(-near, kind="stable"):
            a, b = top(code[x[k]]), top(code[y[k]])
            if a != b and jaccard_at_least(sets[x[k]], sets[y[k]], percent):
                up[max(a, b)] = min(a, b)
                us.append(x[k])
                vs.append(y[k])
        u, v = ids[np.array(us, np.int64)], ids[np.array(vs, np.int64)]
        kind_ = block.schema.field("id").type
        return pa.table({"u": pa.array(np.where(u > v, u, v), kind_), "v": pa.array(np.where(u > v, v, u), kind_)})

    near = store(blocks.groupBy("key", "i", "j").applyInArrow(busy, schema), "minhash-busy")
    sets = _sets(near.frame, texts, words, kind)
    links = store(near.frame.join(sets.frame, "id").groupBy("key", "i", "j").applyInArrow(run, f"u {kind}, v {kind}"), "minhash-across")
    near.drop()
    sets.drop()
    return links


def _repeated(linkable: DataFrame, sketches: DataFrame, reps: DataFrame) -> DataFrame:
    """Links ``u, v`` that tie the rows of one id together where they hold different texts."""
    several = sketches.groupBy("id").agg(F.min(F.coalesce("digest", F.lit(b""))).alias("lo"), F.max(F.coalesce("digest", F.lit(b""))).alias("hi")).where("lo <> hi")
    return linkable.select("digest", F.col("id").alias("u")).join(several.select(F.col("id").alias("u")), "u").join(reps.select("digest", F.col("id").alias("v")), "digest").select("u", "v")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets; a component is named
    after its least id, and the document of that id is kept. Null and empty texts, and texts without words, have no
    shingles and no links. Rows that share an id are one document. Rows without an id link with nothing: their
    component is null and they are kept. Other columns are ignored; no rows in, none out. Texts of any length are read whole.

    Documents with equal sets (a group of copies may hold a third of all rows) meet first, in a pre-aggregated
    group-by, and only one of them goes on; the others take its component in the end. A bucket links its members to
    its least one, so a bucket of m members gives m pairs, not m * m. What can remain are links between components
    that share a bucket but not its least member: buckets that still hold several components are compared as pairs of
    bounded blocks, the members outside the largest component with all, whatever the bucket's size. With 48 bands of
    six, a pair of similarity 0.8 shares no bucket with probability 5e-7.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = [store(sketch(docs, words, id_col, text_col), "minhash")]
    sketches = held[0].frame
    linkable = sketches.where("n > 0 AND id IS NOT NULL")
    held.append(store(linkable.groupBy("digest").agg(F.min_by(F.struct("id", "n", "bands", "sig"), "id").alias("r")).select("digest", "r.*"), "minhash-reps"))
    reps = held[-1].frame
    held.append(_members(reps))
    members = held[-1].frame
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stars = members.where("id <> center").select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("center").alias("v")).distinct()
    held.append(store(_agreeing(stars, reps, percent, kind), "minhash-near"))
    held.append(_confirmed(held[-1].frame, texts, words, percent, kind))
    held.append(components(held[-1].frame.union(_repeated(linkable, sketches, reps))))
    labels = held[-1].frame
    held.append(_blocks(members, labels, reps))
    held.append(_across(held[-1].frame, texts, words, percent, kind))
    last = components(labels.union(held[-1].frame))
    root = last.frame.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    held.append(store(reps.select("digest", "id").join(root, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id")), "minhash-roots"))
    full = linkable.select("id", "n", "digest").join(held[-1].frame, "digest").select("id", "n", "component_id")
    alone = sketches.where("n = 0 OR id IS NULL").select("id", "n").join(root, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = store(full.union(alone), "minhash-out")
    for x in [*held, last]:
        x.drop()
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")
    return out.frame.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept)
