"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has affix, n-gram and lexicon features; learned transitions tie neighbouring words' labels, so that a
text which switches language is labelled span by span. Forward-backward gives each word's label probabilities; a
document's language is the one with the largest summed probability. Training sequences are single-language spans of
the documents, spliced into code-switched ones, so that transitions between languages are learned too.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import slices
from loomgraph.llm.sampling import drawn, fold, rates, trimmed

#: Hashed features; words in a chain (a longer text is several chains, all of which count).
FEATURES, CHAIN = 1 << 16, 64
#: Most labelled documents that training takes, over all languages, and at least for each.
SAMPLE, LEAST = 2400, 20
#: A word is in a language's lexicon if the sample has it this often and so large a share of it is in that language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
STEPS, BATCH, RATE, DECAY = 150, 192, 0.08, 1e-6
MEMO_ENTRIES = 300_000
#: Chains that are scored together.
SCORED = 512
#: Most letters of a word; a longer token is several words.
LONGEST = 40
UNDETERMINED = "und"


def word_of(token: str) -> str:
    """The token's letters, lower-cased; empty if it has none."""
    return token.lower() if token.isalpha() else "".join(c for c in token if c.isalpha()).lower()


def words_of(token: str) -> list[str]:
    """The token's words: its letters are one, but if they are more than ``LONGEST`` each run of letters (marks on them left out) is, in pieces of at most that."""
    if len(word := word_of(token)) <= LONGEST:
        return [word] if word else []
    runs = "".join(c if c.isalpha() else "" if unicodedata.category(c)[0] == "M" else " " for c in token).lower().split()
    return [run[i : i + LONGEST] for run in runs for i in range(0, len(run), LONGEST)]


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed prefixes and suffixes (1 to 4), trigrams, length and lexicon of a word."""
    w = word
    found = [f"p{w[:n]}" for n in (1, 2, 3, 4) if len(w) >= n] + [f"s{w[-n:]}" for n in (1, 2, 3, 4) if len(w) >= n]
    m = f"<{w}>"
    found += ["g" + m[i : i + 3] for i in range(len(m) - 2)]
    found += [f"n{min(len(w), 12)}", f"l{lexicon.get(word, -1)}", f"a{w.isascii()}"]
    return [zlib.crc32(f.encode("utf-8")) & (FEATURES - 1) for f in found]


def forward_backward(emit: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals (B, T, L), summed pair marginals (L, L) and log partition of scored chains.

    ``emit`` (B, T, L) are word scores, ``trans`` (L, L) transition scores, ``real`` (B, T) marks the words that are
    there: chains are filled up at their ends.
    """
    b, t, n = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(trans - trans.max())
    alpha, scale = np.empty((b, t, n)), np.empty((b, t))
    for i in range(t):
        x = e[:, i] if i == 0 else (alpha[:, i - 1] @ a) * e[:, i]
        if i:
            x = np.where(real[:, i, None], x, alpha[:, i - 1])
        scale[:, i] = x.sum(axis=1)
        alpha[:, i] = x / scale[:, i, None]
    beta = np.ones((b, t, n))
    for i in range(t - 2, -1, -1):
        x = (beta[:, i + 1] * e[:, i + 1]) @ a.T
        x = np.where(real[:, i + 1, None], x / x.sum(axis=1, keepdims=True), beta[:, i + 1])
        beta[:, i] = x
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    after = np.where(real[:, 1:, None], beta[:, 1:] * e[:, 1:], 0)
    norm = np.einsum("bti,ij,btj->bt", alpha[:, :-1], a, after)
    pairs = np.einsum("bti,btj->ij", alpha[:, :-1] / np.where(norm > 0, norm, 1)[:, :, None], after) * a
    log_z = float(((np.log(scale) + top[:, :, 0]) * real).sum() + trans.max() * real[:, 1:].sum())
    return gamma * real[:, :, None], pairs, log_z


@dataclass
class Crf:
    """Feature weights (hashed features, labels), transitions, labels and lexicon."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores (words, labels)."""
        per_word = [features(w, self.lexicon) for w in words]
        if not per_word:
            return np.zeros((0, len(self.labels)))
        starts = np.concatenate(([0], np.cumsum([len(f) for f in per_word])[:-1]))
        return np.add.reduceat(self.weights[np.concatenate(per_word)], starts, axis=0)

    def marginals(self, emit: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Summed label probabilities (documents, labels); ``emit`` holds the documents' words one after another."""
        total = np.zeros((len(sizes), len(self.labels)))
        owner = np.repeat(np.arange(len(sizes)), [-(-n // CHAIN) for n in sizes])
        if not len(owner):
            return total
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - n, e, CHAIN) for e, n in zip(ends, sizes, strict=True)])
        lengths = np.minimum(CHAIN, ends[owner] - starts)
        for at in range(0, len(starts), SCORED):
            s, n = starts[at : at + SCORED], lengths[at : at + SCORED]
            real = np.arange(CHAIN) < n[:, None]
            index = np.where(real, s[:, None] + np.arange(CHAIN), 0)
            gamma, _, _ = forward_backward(emit[index], self.trans, real)
            np.add.at(total, owner[at : at + SCORED], gamma.sum(axis=1))
        return total


def fit(texts: list[str], langs: list[str], seed: int = 11) -> Crf:
    """Maximise the chains' log likelihood with Adam. Texts without letters are skipped; no text: no labels."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    docs: list[tuple[int, list[str]]] = []
    seen: dict[str, Counter] = {}
    for t, g in zip(texts, langs, strict=True):
        k = labels.index(g)
        if words := [w for token in t.split() for w in words_of(token)]:
            docs.append((k, words))
            for w in words:
                seen.setdefault(w, Counter())[k] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in seen.items() if (n := sum(c.values())) >= LEXICON_COUNT and max(c.values()) >= LEXICON_SHARE * n}
    n = len(labels)
    crf = Crf(labels, np.zeros((FEATURES, n)), np.zeros((n, n)), lexicon)
    if not docs:
        return crf
    by_label = [[w for k, w in docs if k == label] for label in range(n)]
    usable = [k for k in range(n) if by_label[k]]

    def chain() -> tuple[list[str], list[int]]:
        words: list[str] = []
        ks: list[int] = []
        while len(words) < CHAIN:
            k = int(rng.choice(usable))
            d = by_label[k][int(rng.integers(len(by_label[k])))]
            span = int(rng.integers(4, CHAIN + 1))
            at = int(rng.integers(0, max(1, len(d) - span + 1)))
            part = d[at : at + span]
            words += part
            ks += [k] * len(part)
        return words[:CHAIN], ks[:CHAIN]

    m = [np.zeros_like(crf.weights), np.zeros_like(crf.weights), np.zeros((n, n)), np.zeros((n, n))]
    real = np.ones((BATCH, CHAIN), bool)
    known: dict[str, np.ndarray] = {}
    for step in range(1, STEPS + 1):
        drawn_chains = [chain() for _ in range(BATCH)]
        flat = [w for words, _ in drawn_chains for w in words]
        gold = np.array([k for _, ks in drawn_chains for k in ks]).reshape(BATCH, CHAIN)
        feats = []
        for w in flat:
            f = known.get(w)
            if f is None:
                # words that are rare in the sample often go without their lexicon entry, as unseen words do
                f = known[w] = np.array(features(w, lexicon))
            feats.append(f if rng.random() < 0.8 else np.array(features(w, {})))
        sizes = np.array([len(f) for f in feats])
        index = np.concatenate(feats)
        emit = np.add.reduceat(crf.weights[index], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0).reshape(BATCH, CHAIN, n)
        gamma, pairs, _ = forward_backward(emit, crf.trans, real)
        err = (gamma - np.eye(n)[gold]).reshape(-1, n) / BATCH
        grad = np.stack([np.bincount(index, weights=np.repeat(err[:, k], sizes), minlength=FEATURES) for k in range(n)], axis=1) + DECAY * crf.weights
        true_pairs = np.zeros((n, n))
        np.add.at(true_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        for k, g in ((0, grad), (2, (pairs - true_pairs) / BATCH)):
            m[k] = 0.9 * m[k] + 0.1 * g
            m[k + 1] = 0.99 * m[k + 1] + 0.01 * g * g
            move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(m[k + 1] / (1 - 0.99**step)) + 1e-6)
            if k == 0:
                crf.weights -= move
            else:
                crf.trans -= move
    crf.weights = crf.weights.astype(np.float32)
    return crf


def train(docs: DataFrame, *, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fit on at most ``sample`` documents (at least ``LEAST`` a language) with a language, outside the held-out fold."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out)).select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n_langs = rows.select("lang").distinct().count()
    most = max(LEAST, sample // max(1, n_langs))
    few = drawn(rows, "lang", rates(rows, "lang", most), id_col)
    frame = trimmed(few.toPandas().drop_duplicates(id_col), "lang", id_col, most)
    return fit(frame["text"].tolist(), frame["lang"].tolist())


class _Memo(dict):
    """Rows of a growing emission table by token; -1 for tokens without letters."""

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf
        self.new: list[str] = []
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(crf.labels)), np.float32)

    def __missing__(self, token: str) -> int:
        word = word_of(token)
        at = -1
        if word:
            at = self.rows.get(word, -1)
            if at < 0:
                at = self.rows[word] = len(self.rows)
                self.new.append(word)
        self[token] = at
        return at

    def settle(self) -> np.ndarray:
        if self.new:
            self.table = np.concatenate([self.table, self.crf.emissions(self.new).astype(np.float32)])
            self.new = []
        return self.table

    def trim(self) -> None:
        """Between batches, when nothing refers to rows."""
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.rows.clear()
            self.table = self.table[:0]


def predict(crf: Crf, texts: list[str], memo: _Memo | None = None) -> list[tuple[str, float]]:
    """Language and its share of the words' summed probabilities; ``und`` and 0 for texts without a letter."""
    if not crf.labels:
        return [(UNDETERMINED, 0.0)] * len(texts)
    memo = memo if memo is not None else _Memo(crf)
    out: list[tuple[str, float]] = []
    at = 0
    while at < len(texts):
        memo.trim()
        rows, held = [], 0
        while at < len(texts) and held < 200_000:
            tokens = texts[at].split()
            if max(map(len, tokens), default=0) > LONGEST:
                tokens = [w for t in tokens for w in ((t,) if len(t) <= LONGEST else words_of(t))]
            r = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
            rows.append(r[r >= 0])
            held += len(r)
            at += 1
        table, sizes = memo.settle(), [len(r) for r in rows]
        total = crf.marginals(table[np.concatenate(rows)] if rows else table[:0], sizes)
        for n, p in zip(sizes, total, strict=True):
            k = int(p.argmax())
            out.append((crf.labels[k], min(1.0, float(p[k] / n))) if n else (UNDETERMINED, 0.0))
    return out


def label_words(crf: Crf, text: str) -> list[tuple[str, str, float]]:
    """Each word of a text with its most probable language: the spans of a code-switched text. A long token's words share one."""
    tokens = [(t, w) for t in text.split() if (w := words_of(t))]
    if not tokens or not crf.labels:
        return []
    emit = crf.emissions([w for _, words in tokens for w in words])
    found = []
    for at in range(0, len(emit), CHAIN):
        part = emit[at : at + CHAIN][None]
        gamma, _, _ = forward_backward(part, crf.trans, np.ones(part.shape[:2], bool))
        found.append(gamma[0])
    sizes = np.array([len(words) for _, words in tokens])
    means = np.add.reduceat(np.concatenate(found), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
    return [(t, crf.labels[int(p.argmax())], float(p.max())) for (t, _), p in zip(tokens, means, strict=True)]


def identify(docs: DataFrame, crf: Crf, *, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id, held_out, lang_pred, score`` (and the columns of ``keep``) for every row of ``docs``, from its whole text, also where it has no spaces.

    A null text, an empty one and one without a letter are ``und`` with score 0, and so is every text if there was
    nothing to learn from. Ties between languages go to the first by name. Repeated rows each give a row; other columns than those of ``keep`` are ignored, whatever their names; no rows in, none out.
    One narrow
    pass; the model (a bounded table of hashed weights and a lexicon of the sample) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    kept = keep or []
    fields = [docs.schema[c] for c in (id_col, *kept)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value  # one object for all tasks of a worker, so its memo serves them all
        memo = m.__dict__.setdefault("memo", _Memo(m))
        for b in slices(batches):
            langs, scores = zip(*predict(m, b.column(b.num_columns - 1).to_pylist(), memo), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), "lang_pred", "score"])

    out = docs.select(*(F.col(f.name) for f in fields), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, schema)
    return out.select(id_col, (fold(id_col, folds) == held_out).alias("held_out"), "lang_pred", "score", *kept)


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents' own languages (outside the held-out fold) and predict all of them."""
    return identify(docs, train(docs, **options))
