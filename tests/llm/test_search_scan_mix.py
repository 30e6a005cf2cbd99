import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import curves, licenses, mixing


def test_hilbert_curve_is_a_walk_through_all_cells():
    bits, dims = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = curves.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_recall_and_scores(spark, block_rows):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(np.float32(a)) for a in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, block int")
    out = curves.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=block_rows).toPandas()
    frame = df.toPandas().rename(columns={"vec_id": "id", "embedding": "v"})
    exact = curves.brute_force(frame[["id", "v"]], list(range(0, 3000, 20)), 20)
    both = exact.merge(out, left_on=["query_id", "id"], right_on=["query_id", "vec_id"])
    assert len(both) / len(exact) >= 0.9 and np.allclose(both.score_x, both.score_y, atol=1e-12)
    assert out.groupby("query_id")["rank"].agg(["min", "max", "count"]).eq([1, 20, 20]).all().all()
    assert not (out.query_id == out.vec_id).any()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = curves.nearest(df, F.col("vec_id") % 20 == 0, k=20).toPandas()
    frame = df.toPandas().rename(columns={"vec_id": "id", "embedding": "v"})
    queries = [int(i) for i in frame.id if i % 20 == 0]
    exact = curves.brute_force(frame[["id", "v"]], queries, 20)
    both = exact.merge(out, left_on=["query_id", "id"], right_on=["query_id", "vec_id"])
    assert len(both) / len(exact) >= 0.9


def test_sub_blocks_answer_as_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(600, 6)).tolist())], "vec_id long, embedding array<double>")
    monkeypatch.setattr(curves, "MOST_BLOCKS", 3)
    want = curves.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    monkeypatch.setattr(curves, "QUERIES_A_TASK", 2)
    got = curves.nearest(df, F.col("vec_id") % 20 == 0, k=5, block_rows=50).collect()
    assert sorted(got) == sorted(want) and len(got) == 150


def test_ties_hot_vectors_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(100 + i, [0.0, 1.0 + i]) for i in range(5)]
    rows += [(200, None), (201, []), (202, [0.0, 0.0]), (203, [nan, 1.0]), (204, [inf, 1.0]), (205, [None, 1.0]), (206, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (104, [0.0, 5.0])]
    out = curves.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).toPandas()
    assert sorted(out.query_id.unique()) == [0, 20, 40, 60, 80, 100]
    for q, g in out.groupby("query_id"):
        got = g.sort_values("rank").vec_id.tolist()
        assert got == ([104, 103, 102, 101, 0] if q == 100 else [i for i in range(6) if i != q][:5])
    assert curves.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0
    few = curves.nearest(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>"), F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"], r.score) for r in few) == [(1, 2, 1, 2.0), (2, 1, 1, 2.0)]


def plain_scan(text):
    """Licenses whose best notice has at least 0.8 of its shingles somewhere in a stretch of three windows."""
    import re

    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    found = set()
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            t = [w for w in re.split(r"[^\w]+|_", notice.lower()) if w]
            grams = set(zip(t, t[1:], strict=False))
            if any(len(grams & set(zip(words[i : i + len(t) + 4], words[i + 1 : i + len(t) + 4], strict=False))) >= len(grams) for i in range(len(words))):
                found.add(name)
    return found


def test_license_scan_finds_every_whole_notice(spark, sf):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for notices in licenses.TEMPLATES.values():
        for notice in notices:
            for lead in (0, 1, 5, 23):
                filler = [f"w{rng.integers(1000)}" for _ in range(60)]
                rows.append((n, " ".join([*filler[:lead], notice.upper() if lead == 1 else notice, *filler[lead:]])))
                n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "license"), (n + 3, "the " * 50_000), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    got = {}
    for r in licenses.scan_licenses(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, t in rows:
        want = plain_scan(t) if i is not None else set()
        assert want <= got.get(i, set()) if want else i not in got, (i, t)
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    names = {(r.doc_id, r.license) for r in licenses.scan_licenses(whole).collect()}
    assert names == {(r.doc_id, k) for r in whole.collect() for k in plain_scan(r.text)}
    assert licenses.scan_licenses(whole.limit(0)).count() == 0


def test_license_scan_finds_long_notices_with_replaced_words(spark):
    rng = np.random.default_rng(9)
    split = lambda t: [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w]
    rows, want = [], {}
    for name, i in (("MIT", 2), ("Apache-2.0", 1), ("GPL-3.0", 1), ("GPL-2.0", 1), ("BSD", 1), ("ISC", 0)):
        notice = split(licenses.TEMPLATES[name][i])
        parts = [notice[c : c + licenses.WINDOW] for c in range(0, len(notice) - 1, licenses.WINDOW - 1)]
        size = sum(len(set(zip(p, p[1:], strict=False))) for p in parts)
        for replaced in (1, 2, 3):
            for _ in range(12):
                text = list(notice)
                for at in rng.choice(len(text), replaced, replace=False):
                    text[at] = f"q{at}"
                text = [f"w{rng.integers(1000)}" for _ in range(rng.integers(0, 30))] + text + [f"w{rng.integers(1000)}" for _ in range(30)]
                grams = set(zip(text, text[1:], strict=False))
                share = sum(len(set(zip(p, p[1:], strict=False)) & grams) for p in parts) / size
                if share >= licenses.CONTAINMENT:
                    want[len(rows)] = (name, share)
                rows.append((len(rows), " ".join(text)))
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 100
    # the version may be among the replaced words: then the other version's share is as high
    assert not [(i, w, rows[i][1]) for i, w in want.items() if abs(got.get((i, w[0]), 0) - w[1]) > 1e-9]
    assert {i for i, _ in got} == set(want) and {k for _, k in got} == {k for k, _ in want.values()}
    # an intact notice still keeps out the one that differs from it by the version
    whole = spark.createDataFrame([(0, "a b c " + licenses.TEMPLATES["GPL-3.0"][1] + " d e f")], "doc_id long, text string")
    assert [r.license for r in licenses.scan_licenses(whole).collect()] == ["GPL-3.0"]


def test_mixture_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 50)), str(rng.choice(["en", "de"], p=[0.8, 0.2])), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])), 0.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability double")
    powers = {"source": 0.8, "lang": 0.8, "topic": 1.0}
    out = mixing.mix(docs, powers=powers, budget=0.4, rounds=12).toPandas()
    assert len(out) == len(rows) and out.probability.between(0, 1).all()
    weight = out.tokens * out.probability
    assert abs(weight.sum() / out.tokens.sum() - 0.4) < 1e-6
    for axis in ("source", "lang"):
        share = out.groupby(axis).tokens.sum() / out.tokens.sum()
        target = share**0.8 / (share**0.8).sum()
        assert np.allclose(weight.groupby(out[axis]).sum() / weight.sum(), target, atol=1e-3)
    assert abs((out.kept * out.tokens).sum() / weight.sum() - 1) < 0.1


def test_mixture_of_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "x y", None, "a"), (3, "x y", None, "a"), (4, "z " * 100_000, "en", None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), budget=1.0).collect()
    assert len(out) == 6 and all(r.kept and r.probability == 1.0 for r in out)
    assert {r.lang for r in out} == {"en", "unknown"}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
