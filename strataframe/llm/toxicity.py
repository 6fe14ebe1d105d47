"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text (present or not) is trained with
numpy from two samples: confirmed toxic documents, and documents taken without
regard to any label. With class prior p and logistic loss l the risk is

    p * mean_pos l(+f) + max(0, mean_unl l(-f) - p * mean_pos l(-f)),

the non-negative estimator: when the second term falls below 0 its gradient is
stepped back, so the model cannot win by calling every unlabelled row clean.

The class prior, the share of toxic rows among all, is not known from such samples. It is a parameter, or else estimated from
them: a first model is fitted on every second document, and the others tell, for each threshold, the share of unlabelled
documents over it divided by the share of positives; the least of these, with a margin for chance, bounds the prior. Labels of clean rows are never read.

Bounds, all parameters: ``positives`` and ``unlabelled`` documents at most. Words in use are those whose shares of positive and of unlabelled documents
differ beyond chance (``TELLING`` standard errors at least). Labels are read from training folds only; scoring reads
every text whole.

Cases: null text is an empty text, whose score is that of the offset alone;
equal texts get equal scores and repeated rows are repeated; a null doc_id
keeps its row; labels other than 0 and 1 are ignored; other columns are
ignored; an empty table gives an empty result; without a positive row every
score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hash_below, sample_fraction, text_or_empty

POSITIVES = 3000
UNLABELLED = 9000
FIRST_PRIOR = 0.1
#: Standard errors between a word's two shares from which it is used.
TELLING = 5.0
ROUNDS = 300
RATE = 0.05
RIDGE = 1e-5
THRESHOLD = 0.5
#: Stripped from both ends of a word.
EDGE = ".,;:!?\"'()[]{}<>*$%&#|-_"


def word_set(text: str) -> set[str]:
    """Lower-cased words without punctuation at their ends, and the stems of the longer ones: their first 5 and 7 characters."""
    words = {w.strip(EDGE) for w in set(text.lower().split())}
    return words | {w[:5] + "*" for w in words if len(w) > 5} | {w[:7] + "*" for w in words if len(w) > 7}


def _sparse(docs: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the words in use; place: word number -> column or -1."""
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = place[np.concatenate(docs)] if docs else np.empty(0, np.int64)
    return rows[cols >= 0], cols[cols >= 0]


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str], prior: float, *, rounds: int = ROUNDS):
    """(word -> weight, offset) by Adam steps on the non-negative risk, over the whole sample in each step.

    Documents are arrays of word numbers, each once; names has the words.
    """
    n_p, n_u = len(positive), max(len(unlabelled), 1)
    in_p, in_u = (np.bincount(np.concatenate(d) if d else np.empty(0, np.int64), minlength=len(names)) for d in (positive, unlabelled))
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    telling = np.abs(in_p / n_p - in_u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    used = np.flatnonzero((telling >= TELLING) & (in_p + in_u >= 3))
    used = sorted((i for i in used.tolist() if names[i]), key=lambda i: names[i])
    words = [names[i] for i in used]
    place = np.full(len(names), -1, np.int64)
    place[used] = np.arange(len(used))
    pr, pc = _sparse(positive, place)
    ur, uc = _sparse(unlabelled, place)
    v = len(words)
    w, m, s = np.zeros(v + 1), np.zeros(v + 1), np.zeros(v + 1)
    w[-1] = math.log(prior / (1 - prior))

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for step in range(1, rounds + 1):
        fp = np.bincount(pr, w[pc], n_p) + w[-1]
        fu = np.bincount(ur, w[uc], n_u) + w[-1]
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # Gradients of the two terms with respect to f.
        good_p = -prior * sigmoid(-fp) / n_p
        rest_p, rest_u = -prior * sigmoid(fp) / n_p, sigmoid(fu) / n_u
        gp, gu = (good_p + rest_p, rest_u) if rest >= 0 else (-rest_p, -rest_u)
        g = np.empty(v + 1)
        g[:v] = np.bincount(pc, gp[pr], v) + np.bincount(uc, gu[ur], v) + RIDGE * w[:v]
        g[-1] = gp.sum() + gu.sum()
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return dict(zip(words, w[:v].tolist(), strict=True)), float(w[-1])


def prior_of(positive: list[np.ndarray], unlabelled: list[np.ndarray], names: list[str]) -> float:
    """Share of positives among the unlabelled, from both samples alone."""
    if len(positive) < 8 or len(unlabelled) < 8:
        return FIRST_PRIOR
    weights, _ = fit(positive[::2], unlabelled[::2], names, FIRST_PRIOR)
    value = np.array([weights.get(n, 0.0) for n in names])
    p, u = (np.array([value[d].sum() for d in half]) for half in (positive[1::2], unlabelled[1::2]))
    best = 1.0
    for cut in np.quantile(p, np.linspace(0.98, 0.1, 45)):
        a, b = (u >= cut).mean(), (p >= cut).mean()
        chance = math.sqrt(a * (1 - a) / len(u)) + a / b * math.sqrt(b * (1 - b) / len(p))
        best = min(best, (a + 2 * chance) / b)
    return float(min(max(best, 0.001), 0.5))


def _numbered(df: DataFrame, index: dict[str, int]) -> list[np.ndarray]:
    """Word numbers of a bounded sample, in the order of the ids. Texts become word lists on the executors, and each row
    becomes numbers as it arrives, so the driver holds a distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [sorted(word_set(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.string()))], names=["doc_id", "w"])

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, w array<string>")
    out = []
    for r in rows.toLocalIterator():
        out.append((r["doc_id"] or 0, np.array([index.setdefault(w, len(index)) for w in r["w"]], np.int32)))
    return [d for _, d in sorted(out, key=lambda x: (x[0], x[1].tobytes()))]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None):
    """(weights, offset) from docs(doc_id, text) and labels(doc_id, toxic); None without a positive row."""
    toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = toxic.count()
    if not n:
        return None
    # Rows of one id and text count once, so no id fills the sample.
    index: dict[str, int] = {}
    chosen = F.broadcast(toxic.where(hash_below("doc_id", sample_fraction(n, positives), 21)))
    pos = _numbered(docs.join(chosen, "doc_id").select("doc_id", "text").distinct(), index)
    unl = _numbered(docs.where(hash_below("doc_id", sample_fraction(docs.count(), unlabelled), 22)).select("doc_id", "text").distinct(), index)
    if not pos:
        return None
    names = list(index)
    return fit(pos, unl, names, prior_of(pos, unl, names) if prior is None else prior)


def _score_batches(weights: dict[str, float], offset: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = weights.get
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column("text")):
                z = offset + math.fsum(get(w, 0.0) for w in word_set(t.as_py()))
                scores[i] = 1 / (1 + math.exp(-min(max(z, -30), 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_fold: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels of the other folds are learnt from."""
    held = fold_of("doc_id", folds) == held_fold
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    model = train(texts.where(~held & F.col("doc_id").isNotNull()), labels.where(~held), **options)
    weights, offset = model or ({}, -30.0)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))
    return src.mapInArrow(_score_batches(weights, offset, threshold), "doc_id bigint, held_out boolean, score double, predicted int")
