import random

import numpy as np
import pytest

from loomgraph.llm import minhash
from loomgraph.llm.components import components


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    up = {i: i for i in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    rng = random.Random(words)
    pool = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            t = [rng.choice(pool) if rng.random() < rng.choice([0, 0.01, 0.05, 0.2]) else w for w in base]
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "ONE two"), (n + 5, "one two"), (None, "one two")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, key int")
    out = minhash.near_duplicates(docs, words=words).collect()
    assert len(out) == len(rows)
    want = brute(rows, words, 80)
    for r in out:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)


def test_one_large_group_of_copies_and_near_copies(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(300 + i, " ".join([*base[:60], f"x{i}", *base[61:]])) for i in range(200)]
    rows += [(500 + i, " ".join(f"u{i}_{j}" for j in range(30))) for i in range(50)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).toPandas()
    assert (out[out.doc_id < 500].component_id == 0).all()
    assert (out[out.doc_id >= 500].component_id == out[out.doc_id >= 500].doc_id).all()
    assert out.kept.sum() == 51


@pytest.mark.parametrize("rows_, shingles_", [(4, 2_000_000), (1024, 500)])
def test_buckets_are_compared_in_blocks(spark, monkeypatch, rows_, shingles_):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles_)
    base = [f"t{i}" for i in range(100)]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + w if rng.random() < 0.07 else w for w in base)) for i in range(60)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = brute(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in out} == want


def test_buckets_above_the_block_size(spark):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(70)]
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in base)) for i in range(3600)]
    sets = [minhash.shingles(t, 2) for _, t in rows]
    keys, sizes = np.unique(np.concatenate([minhash.band_keys(minhash.signature(s)) for s in sets]), return_counts=True)
    assert sizes.max() > minhash.BLOCK_ROWS
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    names, seen = np.unique(np.concatenate(sets), return_counts=True)
    names = names[seen > 1]
    grid = np.stack([np.isin(names, s) for s in sets]).astype(np.float32)
    size = np.array([len(s) for s in sets])
    common = grid @ grid.T
    linked = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, True)
    want = np.arange(len(rows))
    while True:
        least = np.where(linked, want[None, :], len(rows)).min(1)
        if (least == want).all():
            break
        want = least
    assert out == dict(enumerate(want.tolist()))
    assert len(set(out.values())) > 5


def test_signature_is_an_unbiased_estimate():
    a, b = np.arange(0, 400, dtype=np.uint64), np.arange(100, 500, dtype=np.uint64)
    share = np.mean(minhash.signature(a, 2048) == minhash.signature(b, 2048))
    assert abs(share - 0.6) < 0.06


def test_empty_and_components(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    out = {r.u: r.v for r in components(chain).frame.collect()}
    assert out == {**{i: 0 for i in range(1, 41)}, 101: 100}
