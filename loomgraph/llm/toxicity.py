"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (and of the whole word), so a misspelling that
was never seen shares most of its vector with the words it resembles. A passage of ``WINDOW`` words is the mean of
its words' vectors, put through a linear softmax. A document scores as its worst passage, because a few words in
thousands would vanish in a mean over the whole text; training alternates between finding each document's worst
passages under the present model and fitting on them. A last logistic step maps the worst passage's logit to the
share of toxic documents.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import slices
from loomgraph.llm.sampling import drawn, fold, rates, trimmed

BUCKETS, DIM, WINDOW, WORST = 1 << 17, 8, 2, 4
#: Most labelled documents that training takes, toxic and other.
SAMPLE = {1: 3000, 0: 4000}
ROUNDS, STEPS, RATE, DECAY = 8, 10, 0.05, 3e-5
#: Documents' worth of doubt about an n-gram that is picked by.
PRIOR = 4.0
#: Distinct words whose scores a worker remembers, in two generations.
MEMO_ENTRIES = 400_000


#: Marks that may stand around a word.
MARKS = "\"'`.,;:!?()[]{}<>*&%$#@|/\\-_+=~^"


_BREAKS = str.maketrans(dict.fromkeys(MARKS, " "))
#: Most characters of a word; longer tokens are several words.
LONGEST = 40


def words_of(text: str) -> list[str]:
    """The tokens of a text. Those of more than ``LONGEST`` characters are broken at marks, and what is still longer into pieces that overlap by half."""
    tokens = text.lower().split()
    if max(map(len, tokens), default=0) <= LONGEST:
        return tokens
    return [w for t in tokens for w in ((t,) if len(t) <= LONGEST else _broken(t))]


def _broken(token: str) -> list[str]:
    if len(word := token.strip(MARKS)) <= LONGEST:
        return [word]
    half = LONGEST // 2
    return [w[i : i + LONGEST] for w in word.translate(_BREAKS).split() for i in range(0, max(1, len(w) - half), half)]


def grams(token: str) -> list[int]:
    """Buckets of a token: the stripped word and its n-grams of three to five characters between marks."""
    word = token.strip(MARKS)
    if not word:
        return []
    w = f"<{word}>"
    found = [w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))]
    return [zlib.crc32(g.encode("utf-8")) & (BUCKETS - 1) for g in found]


@dataclass
class Model:
    """What scoring needs: each bucket's share of the logit, the calibration and what a text without words has."""

    weights: np.ndarray
    slopes: np.ndarray
    shift: float
    floor: np.ndarray

    def score(self, text: str, memo: dict) -> float:
        tokens = words_of(text)
        s = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
        s = s[~np.isnan(s)]
        return float(_sigmoid((_worst(s) if len(s) else self.floor) @ self.slopes + self.shift))


def _passages(s: np.ndarray) -> np.ndarray:
    """Means of each ``WINDOW`` neighbouring words, wherever they begin (of all words, if they are fewer)."""
    n = len(s) - WINDOW + 1
    return sum(s[k : k + n] for k in range(WINDOW)) / WINDOW if n > 0 else s.mean(keepdims=True)


def _worst(s: np.ndarray) -> np.ndarray:
    """The largest passage and the mean of the ``WORST`` largest (all, if fewer)."""
    p = _passages(s)
    top = np.partition(p, len(p) - WORST)[-WORST:] if len(p) > WORST else p
    return np.array([top.max(), top.mean()])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class _Memo(dict):
    """Logit shares by token; tokens without a word are NaN and don't count."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.old = weights.tolist(), {}

    def __missing__(self, token: str) -> float:
        s = self.old.get(token)
        if s is None:
            g = grams(token)
            s = sum(map(self.weights.__getitem__, g)) / len(g) if g else float("nan")
        if len(self) >= MEMO_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[token] = s
        return s


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Train on labelled texts. With no text, or one class alone, every score is that class's share (0 for none)."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        level = 30.0 if len(y) and y[0] else -30.0
        return Model(np.zeros(BUCKETS), np.zeros(2), level, np.zeros(2))
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = []
    for t in texts:
        words = [w for w in words_of(t) if w.strip(MARKS)]
        docs.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    flat_grams, counts = array("i"), array("i")
    for w in vocab:
        g = grams(w)
        flat_grams.extend(g)
        counts.append(len(g))
    del vocab
    index, sizes = np.frombuffer(flat_grams, np.int32), np.frombuffer(counts, np.int32)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Adam, over the buckets that occur
    used = np.flatnonzero(np.bincount(index, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    index = place[index]
    del flat_grams
    # the first passages are picked by how much oftener toxic documents hold their n-grams
    seen = np.zeros((2, len(used)))
    for d, k in zip(docs, y, strict=True):
        if len(d):
            seen[k, np.unique(np.concatenate([index[starts[w] : starts[w] + sizes[w]] for w in np.unique(d)]))] += 1
    share = np.array([[(y == 0).mean()], [(y == 1).mean()]])
    odds = np.log((seen[1] + PRIOR * share[1]) / share[1]) - np.log((seen[0] + PRIOR * share[0]) / share[0])
    table = (rng.normal(size=(len(used), DIM)) / DIM).astype(np.float32)
    soft, bias = (rng.normal(size=DIM) * 0.1).astype(np.float32), 0.0
    moments = [np.zeros_like(table), np.zeros_like(table), np.zeros(DIM), np.zeros(DIM), 0.0, 0.0]
    step = 0
    filled = [i for i, d in enumerate(docs) if len(d)]
    for r in range(ROUNDS):
        logit = np.add.reduceat((table @ soft if r else odds)[index], starts) / sizes
        picked, label = [], []
        for i in filled:
            d = docs[i]
            p = _passages(logit[d])
            order = np.argsort(-p, kind="stable")[:WORST]
            # a toxic document's worst passage, and others that the model holds toxic; any document's worst two and two more
            at = order[: 1 + int((p[order[1:]] + bias > 0).sum() if r else 0)] if y[i] else np.unique([*order[:2], *rng.integers(0, len(p), 2)])
            for a in at:
                w = d[a : a + WINDOW]
                picked.append(np.pad(w, (0, WINDOW - len(w)), constant_values=-1))
                label.append(y[i])
        windows, target = np.stack(picked), np.array(label, np.float64)
        here = windows >= 0
        size = here.sum(axis=1, keepdims=True)
        row = np.repeat(np.arange(len(windows)), size[:, 0])
        # the words of these passages alone, and their n-grams
        words, flat = np.unique(windows[here], return_inverse=True)
        grams_of = np.concatenate([index[starts[w] : starts[w] + sizes[w]] for w in words])
        n_grams = sizes[words]
        begin = np.concatenate(([0], np.cumsum(n_grams)[:-1]))
        by_word = np.argsort(flat, kind="stable")
        word_begin = np.searchsorted(flat[by_word], np.arange(len(words)))
        by_bucket = np.argsort(grams_of, kind="stable")
        touched, bucket_begin = np.unique(grams_of[by_bucket], return_index=True)
        word_of = np.repeat(np.arange(len(words)), n_grams)[by_bucket]
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
        for _ in range(STEPS):
            step += 1
            vectors = np.add.reduceat(table[grams_of], begin, axis=0) / n_grams[:, None]
            bag = np.add.reduceat(vectors[flat], np.concatenate(([0], np.cumsum(size[:-1, 0]))), axis=0) / size
            err = (_sigmoid(bag @ soft + bias) - target) * weight
            g_soft, g_bias = bag.T @ err, err.sum()
            # the softmax is linear, so a word's gradient is a multiple of the class vector
            share = np.add.reduceat((err / size[:, 0])[row][by_word], word_begin) / n_grams
            g_table = DECAY * table
            g_table[touched] += np.add.reduceat(share[word_of], bucket_begin)[:, None] * soft
            for k, (name, grad) in enumerate((("table", g_table), ("soft", g_soft), ("bias", g_bias))):
                moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
                moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad * grad
                move = RATE * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-6)
                if name == "table":
                    table = (table - move).astype(np.float32)
                elif name == "soft":
                    soft = (soft - move).astype(np.float32)
                else:
                    bias = float(bias - move)
    weights = np.zeros(BUCKETS)
    weights[used] = table @ soft
    memo = _Memo(weights)
    found = [_worst(x) if len(x) else np.full(2, np.nan) for x in (np.array([s for s in map(memo.__getitem__, words_of(t)) if s == s]) for t in texts)]
    x = np.array(found)
    floor = np.nanmedian(x[y == 0], axis=0) if np.isfinite(x[y == 0]).any() else np.zeros(2)
    slopes, shift = _calibrate(np.where(np.isnan(x), floor, x), y)
    return Model(weights, slopes, shift, floor)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve by damped Newton steps, on smoothed targets."""
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, z.T @ (p - t) + 0.1 * w), -1, 1)
    slopes = w[:-1] / scale
    return slopes, float(w[-1] - slopes @ centre)


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 5, sample: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample (``sample`` rows a class) of the labelled rows outside the held-out fold (fold 0).

    Null labels and texts don't train; a document with several labels counts as toxic if one says so. The sampled
    ids (bounded, so small enough to broadcast) meet the texts in one scan.
    """
    most = sample or SAMPLE
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
    marked = marked.groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("y"))
    few = drawn(marked, "y", rates(marked, "y", most), id_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text")).join(F.broadcast(few), id_col)
    frame = trimmed(rows.select(id_col, "text", "y").toPandas().drop_duplicates(id_col), "y", id_col, most)
    return fit(frame["text"].tolist(), frame["y"].tolist())


def score_documents(docs: DataFrame, model: Model, *, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id, held_out, score, predicted`` (and the columns of ``keep``) for every row of ``docs``.

    Scores lie in [0, 1] and follow from the whole text alone, also where it has no spaces; null and empty texts, and texts without a word, score as the
    middle one of the clean training documents. Repeated rows each give a row; other columns than those of ``keep`` are ignored, whatever their names; no rows in, none out. One narrow pass; the model (1 MB, whatever the corpus) is
    broadcast.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = keep or []
    fields = [docs.schema[c] for c in (id_col, *kept)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value  # one object for all tasks of a worker, so its memo serves them all
        memo = m.__dict__.get("memo") or m.__dict__.setdefault("memo", _Memo(m.weights))
        for b in slices(batches):
            scores = [m.score(t, memo) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "score"])

    out = docs.select(*(F.col(f.name) for f in fields), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
    return out.select(id_col, (fold(id_col, folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *kept)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on ``labels`` and score every document: see ``train`` and ``score_documents`` for nulls, long texts, repeated rows and empty tables."""
    return score_documents(docs, train(docs, labels, **options))


def evaluate(frame: pd.DataFrame) -> dict[str, float]:
    """Accuracy, precision and recall of scored rows that have a ``toxic`` column."""
    t, p = frame["toxic"] == 1, frame["predicted"] == 1
    return {"accuracy": float((t == p).mean()), "precision": float((t & p).sum() / max(1, p.sum())), "recall": float((t & p).sum() / max(1, t.sum()))}
