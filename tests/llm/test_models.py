import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language, toxicity
from loomgraph.llm.sampling import fold


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    score = {p: sum(emit[0, i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in itertools.product(range(3), repeat=4)}
    z = sum(np.exp(s) for s in score.values())
    gamma, pairs, log_z = language.forward_backward(emit, trans, np.ones((1, 4), bool))
    for i, k in itertools.product(range(4), range(3)):
        assert np.isclose(gamma[0, i, k], sum(np.exp(s) for p, s in score.items() if p[i] == k) / z)
    for a, b in itertools.product(range(3), repeat=2):
        assert np.isclose(pairs[a, b], sum(np.exp(s) * sum(x == a and y == b for x, y in zip(p, p[1:], strict=False)) for p, s in score.items()) / z)
    assert np.isclose(log_z, np.log(z))


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(1, 3, 2)), rng.normal(size=(2, 2))
    a, pa_, za = language.forward_backward(emit, trans, np.ones((1, 3), bool))
    long = np.concatenate([emit, rng.normal(size=(1, 2, 2))], axis=1)
    b, pb, zb = language.forward_backward(long, trans, np.array([[True] * 3 + [False] * 2]))
    assert np.allclose(a, b[:, :3]) and np.allclose(b[:, 3:], 0) and np.allclose(pa_, pb) and np.isclose(za, zb)


def test_language_held_out_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language.train(docs)
    out = language.identify(docs, crf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count()
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.95
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "123 --- !!", 0), (4, "x" * 100_000, 0), (5, "der die und das " * 3, 0), (5, "der die und das " * 3, 0)], "doc_id long, text string, score int")
    got = language.identify(odd, crf).collect()
    assert len(got) == 6 and all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id <= 3)
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id == 5} == {"de"}
    mixed = language.label_words(crf, "the and of the that with " + "der die und das von nicht")
    assert mixed[0][1] == "en" and mixed[-1][1] == "de"
    assert language.language_id(docs.limit(0)).count() == 0
    untaught = language.language_id(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_language_reads_long_tokens_to_their_end():
    en, de = ["the", "and", "with", "that", "which", "there"], ["der", "und", "nicht", "werden", "durch", "zwischen"]
    rng = np.random.default_rng(3)
    text = lambda words, n=40: [str(w) for w in rng.choice(words, n)]
    crf = language.fit([" ".join(text(words)) for words in (en, de) for _ in range(25)], ["en"] * 25 + ["de"] * 25)
    for mark in ",_/-1":
        joined = mark.join(text(en, 15) + text(de, 150))
        assert language.predict(crf, [joined])[0][0] == "de", mark
        assert language.label_words(crf, "the " + joined)[1][1] == "de"
    # every letter of a run counts, marks on letters don't part it, shorter tokens stay one word
    for n in (40, 41, 80, 81, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        assert "".join(language.words_of(run)) == run and max(map(len, language.words_of(run))) <= 40
        assert len(language.words_of("".join(c + chr(0x0301) for c in run))) == -(-n // 40)
    assert language.words_of("don't") == ["dont"] and language.words_of("12--") == []


def test_toxicity_held_out_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    held = labels.where(fold("doc_id", 5) == 0).select("doc_id", "toxic")
    out = toxicity.score_documents(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    assert out.held_out.all() and toxicity.evaluate(out)["accuracy"] > 0.96
    words = ["idiot", "moron", "worthless", "pathetic"]
    spelled = spark.createDataFrame([(1, "the and of to in " + " ".join(words)), (2, "the and of to in " + " ".join(w + w[-1] for w in words)), (3, "the and of to in with this that"), (4, None), (5, ""), (6, "... !!"), (7, "the and of " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(spelled, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 1
    assert all(got[i].predicted == 0 for i in (3, 4, 5, 6, 7)) and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_reads_long_tokens_to_their_end():
    clean, bad = [f"plain words number {i} here" for i in range(40)], [f"plain words idiot{'s' * (i % 2)} here {i}" for i in range(40)]
    model = toxicity.fit(clean + bad, [0] * 40 + [1] * 40)
    score = lambda t: model.score(t, toxicity._Memo(model.weights))
    for mark in ",_/-":
        lead = mark.join(["plain", "words", "here"] * 20)
        assert score(lead) < 0.5 < score(f"{lead}{mark}idiot"), mark
    run = "plainwordshere" * 20
    assert score(run + "idiots") > score(run) and score(run + "idiots" + run) > score(run + run)
    # every character lies in some word, and no n-gram is lost
    for n in (40, 41, 59, 60, 61, 200):
        t = "".join(chr(0x4E00 + i) for i in range(n))
        found = toxicity.words_of(t)
        assert all(len(w) <= 40 for w in found) and {t[i : i + 5] for i in range(n - 4)} <= {w[i : i + 5] for w in found for i in range(len(w) - 4)}


def test_a_passage_begins_at_any_word():
    s = np.array([0.1, -0.2, 3.0, 2.0, -0.5, 0.0, 0.3])
    assert np.allclose(toxicity._passages(s), (s[:-1] + s[1:]) / 2) and np.allclose(toxicity._passages(s[:1]), s[:1])
    assert toxicity._worst(s)[0] == toxicity._worst(s[1:])[0] == 2.5


def test_scores_equal_the_plain_formula(spark):
    """A document's score from each n-gram's weight, word by word, without memo, arrays or partitions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    for doc, text in docs.select("doc_id", "text").limit(150).collect():
        shares = [sum(model.weights[g] for g in grams) / len(grams) for w in toxicity.words_of(text or "") if (grams := toxicity.grams(w))]
        pairs = sorted((sum(shares[i : i + 2]) / 2 for i in range(len(shares) - 1)), reverse=True) or shares[:1]
        x = [pairs[0], sum(pairs[:4]) / len(pairs[:4])] if pairs else model.floor
        z = x[0] * model.slopes[0] + x[1] * model.slopes[1] + model.shift
        assert abs(got[doc].score - 1 / (1 + np.exp(-z))) < 1e-9 and got[doc].predicted == int(got[doc].score >= 0.5)


def test_predictions_equal_summed_word_labels(spark):
    """A document's language from the word labels of its chains, one text at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, crf).collect()}
    for doc, text in docs.select("doc_id", "text").limit(150).collect():
        words = [w for t in (text or "").split() for w in language.words_of(t)]
        total = np.zeros(len(crf.labels))
        for at in range(0, len(words), language.CHAIN):
            emit = crf.emissions(words[at : at + language.CHAIN])
            total += language.forward_backward(emit[None], crf.trans, np.ones((1, len(emit)), bool))[0][0].sum(axis=0)
        want = (crf.labels[int(total.argmax())], total.max() / len(words)) if words else ("und", 0.0)
        assert got[doc].lang_pred == want[0] and abs(got[doc].score - want[1]) < 1e-4


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the and of", 0.5, "x"), (2, None, 0.5, "y")], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert language.language_id(docs).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert language.language_id(docs.limit(0)).isEmpty() and toxicity.toxicity(docs.limit(0), labels).isEmpty()


@pytest.mark.parametrize("values", [[], [0], [1]])
def test_one_class_or_none(spark, values):
    docs = spark.createDataFrame([(i, "some words here") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i in range(30) for v in values], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 30 and {r.predicted for r in out} == {values[0] if values else 0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_slices_keep_all_rows_in_order():
    from loomgraph.llm.batches import slices

    sizes = [0, 3, 7]
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(10 * k, 10 * k + n), pa.int64())}) for k, n in enumerate(sizes)]
    cut = list(slices(iter(batches), 3))
    assert [b.num_rows for b in cut] == [3, 3, 3, 1]
    assert [x for b in cut for x in b.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
