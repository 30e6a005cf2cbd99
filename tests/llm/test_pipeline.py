import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import language, toxicity
from tests.llm.test_counts_and_packing import check
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_and_columns(frames):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "near_duplicates", "mixture", "packing"]
    assert all(f.columns == cp.COLUMNS for f in frames[1:-1])
    counts = [f.count() for f in frames[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    for a, b in zip(frames[:-2], frames[1:-1], strict=True):
        assert b.exceptAll(a.select(cp.COLUMNS)).isEmpty()


def test_decisions_take_effect(spark, frames):
    model = toxicity.train(frames[0], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score_documents(frames[0], model).where("predicted = 1").collect()}
    assert rejected and rejected == {r.doc_id for r in frames[0].join(frames[1], "doc_id", "left_anti").collect()}
    found = language.identify(frames[1], language.train(frames[1]))
    gone = {r.doc_id for r in found.where((F.col("lang_pred") == "und") | (F.col("score") < cp.LEAST_SHARE)).collect()}
    assert gone == {r.doc_id for r in frames[1].join(frames[2], "doc_id", "left_anti").collect()}


def test_near_duplicates_against_brute_force(frames):
    rows = [(r.doc_id, r.text) for r in frames[2].collect()]
    want = {i for i, c in brute_fast(rows).items() if i == c}
    assert want == {r.doc_id for r in frames[3].collect()}


def test_near_duplicates_shuffle_no_texts_for_few_ids(spark, frames, monkeypatch):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = cp.drop_near_duplicates(spark, frames[2], SF)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(cp.minhash, "BROADCAST_IDS", 0)
        many = cp.drop_near_duplicates(spark, frames[2], SF)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == sorted(many.collect()) == sorted(frames[3].collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def brute_fast(rows):
    """The brute-force components, of documents that share a shingle only."""
    by: dict = {}
    for i, t in rows:
        w = t.encode().lower().split()
        for s in {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ():
            by.setdefault(s, set()).add(i)
    texts, near = dict(rows), {i: i for i, _ in rows}
    groups = {frozenset(g) for g in by.values() if len(g) > 1}
    linked = set()
    for g in groups:
        linked |= g
    out = brute([(i, texts[i]) for i in sorted(linked)], 5, 80)
    return near | out


def test_packing_is_whole(frames):
    check(frames[4], frames[5])


def test_mixture_follows_its_draws(frames):
    import hashlib

    from loomgraph.llm import mixing

    chance = {r.doc_id: r.probability for r in mixing.mix(frames[3]).collect()}
    draw = lambda i: int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) / (1 << 48)
    assert {r.doc_id for r in frames[4].collect()} == {i for i, p in chance.items() if draw(i) < p}


def test_near_duplicates_among_repeated_rows_and_null_ids(spark):
    a, b, c = ("word%d other%d more%d " * 8 % tuple(range(k, k + 24)) for k in (0, 100, 200))
    rows = [(5, a), (5, a), (6, a), (None, a), (None, b), (None, b), (7, c), (7, c), (8, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_near_duplicates(spark, docs, SF)
    assert got.columns == cp.COLUMNS
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted([(5, a), (-1, b), (7, c), (8, ""), (-1, "")])


def test_empty_and_null_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), *[(7, "the and of that " * 5, "en", None, 80)] * 2, *[(8, "the and of that " * 5, "en", None, 80)] * 2, (None, "the and of", None, "b", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    counts = {}
    for rows in ("all", "none"):
        at, counts[rows] = docs if rows == "all" else docs.limit(0), []
        for k, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{k}-{rows}")
            stage(spark, at, SF).write.parquet(path)
            at = spark.read.parquet(path)
            counts[rows].append(at.count())
    # two rows without letters go; ids 7 and 8 hold copies of one text
    assert counts["all"][:3] == [7, 5, 2] and counts["none"] == [0] * 5
