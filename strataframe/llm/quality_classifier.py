"""Quality by compression: two zstandard dictionaries, one from good text and one from bad.

A text is cut into blocks of ``BLOCK`` bytes, all of it, and each block is
compressed with either dictionary. With the summed sizes g and b of n bytes of text its one
feature is the normalised difference (b - g) / n, positive where the good
dictionary saves more. It is taken over the text's own length, not over g + b, as text that repeats itself
compresses well with either: its difference is small beside its length, and so it scores as bad text does. A logistic curve fitted on
other labelled rows, weighted to the share of each class, makes a score from 0 to 1.

Dictionaries and curve are fitted on bounded samples of labelled rows
(``per_class`` documents of each class for either, chosen by a hash of the id), whose texts count whole. Scoring reads every text whole.

Cases: null text is an empty text; an empty text has the feature 0 and
gets the curve's value there; equal texts get equal scores and repeated rows are
repeated; a null doc_id keeps its row; rows with a label that is null or
neither 0 nor 1 are not learnt from; several labels of one document all count;
other columns are ignored; an empty table gives an empty result; if a class has
no row to learn from, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, hash_below, map_texts, sample_fraction, text_or_empty

PER_CLASS = 1200
DICT_BYTES = 112_640
BLOCK = 1024
LEVEL = 3
THRESHOLD = 0.7


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        def make(raw: bytes):
            d = zs.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zs.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.good, self.bad = make(good), make(bad)

    def feature(self, text: bytes) -> float:
        g = b = 0
        for block in blocks_of(text):
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
        return (b - g) / max(len(text), 1)


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little text for its trainer, the text itself."""
    import zstandard as zs

    samples = [s for t in texts for s in blocks_of(t) if len(s) >= 16]
    try:
        return zs.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except (zs.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 16


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton steps on the scaled feature."""
    scale = max(float(np.abs(x).max()), 1e-9)
    X = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (weight * (p - y)) + ridge * w
        h = (X * (weight * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, lo: float, hi: float):
    """Texts of a bounded sample of each class, and how many rows each class has; lo and hi cut the id hashes into disjoint parts for disjoint uses."""
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    part = hash_below("doc_id", hi, seed) & ~hash_below("doc_id", lo, seed) if lo else hash_below("doc_id", hi, seed)
    known = known.where(part)
    sizes = {r["y"]: r["n"] for r in known.distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = F.when(F.col("y") == y, hash_below("doc_id", sample_fraction(n, per_class), seed + 1)).otherwise(keep)
    chosen = F.broadcast(known.where(keep).distinct())  # about 2 * per_class ids
    out: dict[int, list[bytes]] = {0: [], 1: []}
    # Rows of one id and text count once.
    rows = docs.join(chosen, "doc_id").select("doc_id", "y", F.col("text").cast("binary").alias("t")).distinct().toLocalIterator()
    for r in sorted(((r["doc_id"], r["y"], bytes(r["t"])) for r in rows), key=lambda r: (r[0], r[1], r[2])):
        out[r[1]].append(r[2])
    return out, sizes


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(good dictionary, bad dictionary, slope, offset) from docs(doc_id, text) and labels(doc_id, quality)."""
    first, _ = _labelled(docs, labels, "quality", per_class, 11, 0.0, 0.5)
    second, sizes = _labelled(docs, labels, "quality", per_class, 11, 0.5, 1.0)
    seen = {y: first[y] + second[y] for y in (0, 1)}
    if not seen[0] or not seen[1]:
        share = (len(seen[1]) + 1) / (len(seen[0]) + len(seen[1]) + 2)
        return b"\0" * 16, b"\0" * 16, 0.0, math.log(share / (1 - share))
    train_on = {y: first[y] or seen[y] for y in (0, 1)}
    fit_on = {y: second[y] or seen[y] for y in (0, 1)}
    good, bad = dictionary(train_on[1]), dictionary(train_on[0])
    c = Compressors(good, bad)
    x = np.array([c.feature(t) for y in (0, 1) for t in fit_on[y]])
    y = np.array([y for y in (0, 1) for _ in fit_on[y]], float)
    weight = np.array([max(sizes.get(k, 1), 1) / len(fit_on[k]) for k in (0, 1) for _ in fit_on[k]])
    slope, offset = logistic(x, y, weight / weight.mean())
    return good, bad, slope, offset


_READY: dict[int, Compressors] = {}


def _score_batches(good: bytes, bad: bytes, slope: float, offset: float, threshold: float, whole: bool):
    key = hash((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Compressors(good, bad)
        c = _READY[key]
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column("text").cast(pa.large_binary())):
                z = slope * c.feature(t.as_py() or b"") + offset
                scores[i] = 1 / (1 + math.exp(-min(max(z, -30), 30)))
            if whole:
                yield batch.filter(pa.array(scores >= threshold))
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def _model(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, per_class: int):
    held = fold_of("doc_id", folds) == held_fold
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return train(texts.where(~held), labels.where(~held & F.col("doc_id").isNotNull()), per_class)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD, per_class: int = PER_CLASS
) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels(doc_id, quality) of the other folds are learnt from."""
    model = _model(docs, labels, folds, held_fold, per_class)
    held = fold_of("doc_id", folds) == held_fold
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), text_or_empty().alias("text"))
    return map_texts(src, _score_batches(*model, threshold, False), "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(
    docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD, per_class: int = PER_CLASS
) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    model = _model(docs, labels, folds, held_fold, per_class)
    return map_texts(docs, _score_batches(*model, threshold, True), docs.schema)
