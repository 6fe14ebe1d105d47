"""Language identification with segmentation-marginalised unigrams.

A fixed public vocabulary of pieces is given (it is never trained here). Each
language has a probability for every piece. A word's probability is the sum,
over all ways to cut it into pieces, of the product of the pieces'
probabilities; a forward pass over the word gives that sum for all languages at
once. A text's score for a language is the log prior plus the logs of its
words' probabilities.

Piece probabilities are fitted by expectation maximisation over the words of a
bounded sample (``docs_per_language`` documents of each language, of these the
``train_words`` most frequent words of each language). Words are runs between Unicode white space, lower-cased,
stripped of non-letters, and marked at their start as the vocabulary does.

Words are scored whole, whatever their length, over all their segmentations: up to ``SHORT`` letters many at once, longer ones (scripts without
spaces) position by position with a window as long as the vocabulary's longest piece. Only in training words over
``SHORT`` letters are cut into parts of that length.

Cases: text null or without a letter gives ``und`` with score 0; repeated rows
and equal texts get equal results; a null doc_id counts as an empty id for
the fold and keeps its row; other columns are ignored, ``lang`` is only read
from training rows; an empty table gives an empty result; without any training
row every text is ``und``; ties go to the language first in order. Texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold_of, sample_fraction

DOCS_PER_LANGUAGE = 1500
TRAIN_WORDS = 60_000
ROUNDS = 3
SHORT = 24
LANGUAGES = 2000
FLOOR = 1e-9
CACHE_WORDS = 800_000
CHUNK_WORDS = 100_000
#: White space of Python's split, in the JVM's terms.
_SPACE = r"\s\x1C-\x1F\x85\p{Z}"
_NOT_LETTERS = rf"[^\p{{L}}{_SPACE}]+"


def public_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of a public vocabulary file, in the order of their ids."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


class Pieces:
    """Finds which substrings of words are pieces, by a rolling hash and a probe table."""

    BITS = 21

    def __init__(self, pieces: list[str]):
        usable = sorted({p for p in pieces if p and not p.startswith("<")})
        self.longest = max(map(len, usable), default=1)
        self.pieces = usable
        self.n = len(usable)
        hashes = self._hash(usable)
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        self.hashes = hashes
        more: dict[int, int] = {}
        for i, w in enumerate(self._slot(hashes).tolist()):
            if self.slots[w] < 0:
                self.slots[w] = i
            else:
                more[int(hashes[i])] = i
        self.more_keys = np.array(sorted(more), np.uint64)
        self.more_ids = np.array([more[int(k)] for k in self.more_keys], np.int32)

    _R = np.uint64(0x9E3779B97F4A7C15)
    _SPREAD = np.uint64(0xD6E8FEB86659FD93)

    def _hash(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(strings):
                h = np.uint64(0)
                for c in s:
                    h = h * self._R + np.uint64(ord(c) + 1)
                out[i] = h
        return out

    def _slot(self, h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((h * self._SPREAD) >> np.uint64(64 - self.BITS)).view(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        got = self.slots[self._slot(h)]
        wrong = np.flatnonzero(got >= 0)
        wrong = wrong[self.hashes[got[wrong]] != h[wrong]]
        got[wrong] = -1
        if len(wrong) and len(self.more_keys):
            # Another piece has this one's place.
            at = np.minimum(np.searchsorted(self.more_keys, h[wrong]), len(self.more_keys) - 1)
            got[wrong] = np.where(self.more_keys[at] == h[wrong], self.more_ids[at], -1)
        return got

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
        """lengths, word letters, and for each (start, end) the words that have a piece there with its number."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        longest = int(lens.max(initial=0))
        letters = np.array(words, dtype=f"<U{max(longest, 1)}").view("<u4").reshape(n, -1).astype(np.uint64)
        prefix = np.zeros((longest + 1, n), np.uint64)
        powers = np.ones(longest + 1, np.uint64)
        in_order = bool((lens[1:] >= lens[:-1]).all())
        with np.errstate(over="ignore"):
            for j in range(longest):
                prefix[j + 1] = prefix[j] * self._R + letters[:, j] + np.uint64(1)
                powers[j + 1] = powers[j] * self._R
            arcs = {}
            for j in range(1, longest + 1):
                # Words by length, as in scoring, are a slice; others are picked.
                rows = slice(int(np.searchsorted(lens, j)), n) if in_order else np.flatnonzero(lens >= j)
                end = prefix[j][rows]
                for i in range(max(0, j - self.longest), j):
                    ids = self.find(end - prefix[i][rows] * powers[j - i])
                    hit = np.flatnonzero(ids >= 0)
                    if len(hit):
                        arcs[i, j] = hit + rows.start if in_order else rows[hit], ids[hit]
        return lens, letters, arcs


def forward(lens: np.ndarray, arcs: dict, table: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: probability of the letters before a position, over all segmentations.

    A single letter that is no piece counts as an unknown piece with probability FLOOR.
    """
    n, longest, k = len(lens), int(lens.max(initial=0)), table.shape[1]
    alpha = np.zeros((longest + 1, n, k))
    alpha[0] = 1.0
    ending: dict[int, list] = {}
    for (i, j), v in arcs.items():
        ending.setdefault(j, []).append((i, *v))
    for j in range(1, longest + 1):
        here = alpha[j]
        single = np.ones(n, bool)
        for i, rows, ids in ending.get(j, ()):
            gain = alpha[i].take(rows, 0)
            gain *= table.take(ids, 0)
            here[rows] += gain
            if i == j - 1:
                single[rows] = False
        alone = np.flatnonzero(single)
        here[alone] += alpha[j - 1].take(alone, 0) * FLOOR
    return alpha


def fit(words: list[str], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """table[piece, language]: piece probabilities by expectation maximisation. counts: [word, language]."""
    lens, _, arcs = pieces.lattice(words)
    k = counts.shape[1]
    n, longest = len(words), int(lens.max(initial=0))
    at_end = np.arange(n)
    table = np.full((pieces.n, k), 1.0 / pieces.n)
    starting: dict[int, list] = {}
    for (i, j), v in arcs.items():
        starting.setdefault(i, []).append((j, *v))
    for _ in range(rounds):
        alpha = forward(lens, arcs, table)
        total = alpha[lens, at_end]
        beta = np.zeros((n, longest + 1, k))
        beta[at_end, lens] = 1.0
        weight = counts / np.maximum(total, 1e-300)
        soft = np.full((pieces.n, k), 0.01)
        for i in range(longest - 1, -1, -1):
            single = lens > i
            for j, rows, ids in starting.get(i, ()):
                beta[rows, i] += table[ids] * beta[rows, j]
                if j == i + 1:
                    single[rows] = False
            if i + 1 <= longest:
                beta[single, i] += FLOOR * beta[single, i + 1]
        for (i, j), (rows, ids) in arcs.items():
            gain = alpha[i, rows] * table[ids] * beta[rows, j] * weight[rows]
            for c in range(k):
                soft[:, c] += np.bincount(ids, gain[:, c], pieces.n)
        table = soft / soft.sum(0)
    return table


def parts_of(word: str) -> list[str]:
    """The marked word, cut where it is longer than SHORT letters: for training alone."""
    marked = "▁" + word
    return [marked[i : i + SHORT] for i in range(0, len(marked), SHORT)]


def score_long(marked: str, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log p(word | language) of one word of any length: the forward pass with a rolling window, rescaled at each letter for each language."""
    letters = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n, longest = len(letters), pieces.longest
    with np.errstate(over="ignore"):
        # prefix[j] = sum of letters[i] R^(j-1-i), by powers of R and of its inverse.
        inverse = np.uint64(pow(int(pieces._R), -1, 2**64))
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, pieces._R)], dtype=np.uint64)
        back = np.cumprod(np.full(n, inverse), dtype=np.uint64)
        prefix = np.r_[np.uint64(0), np.cumsum(letters * back, dtype=np.uint64)] * powers
        found = [pieces.find(prefix[k:] - prefix[:-k] * powers[k]) for k in range(1, min(longest, n) + 1)]
    # Pieces that end at each letter, by length.
    ends: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for k, ids in enumerate(found, 1):
        for i in np.flatnonzero(ids >= 0).tolist():
            ends[i + k].append((k, int(ids[i])))
    window = np.zeros((longest + 1, table.shape[1]))  # at row k: the sum before the k-th letter back, over that of the last one
    window[1] = 1.0
    out = np.zeros(table.shape[1])
    for j in range(1, n + 1):
        total = np.zeros(table.shape[1])
        single = True
        for k, piece in ends[j]:
            total += window[k] * table[piece]
            single = single and k > 1
        if single:
            total += window[1] * FLOOR
        out += np.log(total)
        window[2:] = window[1:-1] / total
        window[1] = 1.0
    return out


def score_words(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """log p(word | language) for each word."""
    out = np.zeros((len(words), table.shape[1]))
    short = []
    for i, w in enumerate(words):
        if len(w) < SHORT:
            short.append(i)
        else:
            out[i] = score_long("▁" + w, pieces, table)
    short.sort(key=lambda i: len(words[i]))
    for at in range(0, len(short), 8192):
        rows = short[at : at + 8192]
        lens, _, arcs = pieces.lattice(["▁" + words[i] for i in rows])
        alpha = forward(lens, arcs, table)
        out[rows] = np.log(np.maximum(alpha[lens, np.arange(len(rows))], 1e-300))
    return out


class Scorer:
    """Scores whole texts; keeps the words' scores in a bounded cache, which changes no result."""

    def __init__(self, pieces: Pieces, table: np.ndarray, prior: np.ndarray):
        import regex

        self.pieces, self.table, self.prior = pieces, table, prior
        self.rows = np.zeros((CACHE_WORDS, table.shape[1]))
        self.index: dict[str, int] = {}
        self.strip = regex.compile(r"\P{L}+").sub
        self.letter = regex.compile(r"\p{L}").search

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log score of each language, or None for a text without a letter. Unseen words of all texts are scored together."""
        out: list[np.ndarray | None] = [None] * len(texts)
        run: list[tuple[int, list[str]]] = []
        held = 0
        for i, t in enumerate(texts):
            if t is None or self.letter(t) is None:
                continue
            out[i] = self.prior.copy()
            words = t.lower().split()
            for at in range(0, len(words), CHUNK_WORDS):
                part = words[at : at + CHUNK_WORDS]
                run.append((i, part))
                held += len(part)
                if held >= CHUNK_WORDS:
                    self._add(run, out)
                    run, held = [], 0
        self._add(run, out)
        return out

    def _add(self, run: list[tuple[int, list[str]]], out: list) -> None:
        fresh = [w for w in dict.fromkeys(w for _, part in run for w in part) if w not in self.index]
        if len(self.index) + len(fresh) > CACHE_WORDS:
            self.index.clear()
            fresh = list(dict.fromkeys(w for _, part in run for w in part))
        if fresh:
            pure = [w if w.isalpha() else self.strip("", w) for w in fresh]
            scores = score_words(pure, self.pieces, self.table)
            scores[[not p for p in pure]] = 0.0
            base = len(self.index)
            self.rows[base : base + len(fresh)] = scores
            self.index.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        at = self.index.__getitem__
        for i, part in run:
            out[i] += self.rows[np.fromiter(map(at, part), np.int64, len(part))].sum(0)


_SCORERS: dict[str, Scorer] = {}


def _score_batches(key: str, vocabulary: str, table: np.ndarray, prior: np.ndarray, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if langs and key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(Pieces(public_pieces(vocabulary)), table.astype(np.float64), prior)
        scorer = _SCORERS.get(key)
        for batch in batches:
            preds, scores = [], []
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column("text").slice(at, 1024).to_pylist()
                for s in scorer.texts(texts) if scorer else [None] * len(texts):
                    if s is None:
                        preds.append("und")
                        scores.append(0.0)
                    else:
                        e = np.exp(s - s.max())
                        preds.append(langs[int(s.argmax())])
                        scores.append(float(e.max() / e.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def train(docs: DataFrame, *, docs_per_language: int = DOCS_PER_LANGUAGE, train_words: int = TRAIN_WORDS, vocabulary: str = "piece_bpe_32k.model"):
    """(languages, log prior, table) from docs(doc_id, text, lang); all rows given may be learnt from."""
    counts = docs.where("lang is not null and text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A value of lang is a column of the model; a table with more of them than this has no languages there.
    if counts.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of lang")
    rows = {r["lang"]: r["n"] for r in counts.collect()}
    langs = sorted(rows)
    if not langs:
        return [], np.zeros(0), np.zeros((0, 0))
    share = docs.sparkSession.createDataFrame([(lang, int(sample_fraction(n, docs_per_language) * 2**62)) for lang, n in rows.items()], "lang string, below bigint")
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id"), F.xxhash64("text")), 2) <= F.col("below")
    sample = docs.where("text is not null").join(F.broadcast(share), "lang").where(drawn)
    clean = F.regexp_replace(F.lower("text"), _NOT_LETTERS, "")
    words = sample.select("lang", F.explode(F.split(clean, f"[{_SPACE}]+")).alias("w")).where("w <> ''")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank).where(F.col("rank") <= train_words)
    by_lang: dict[str, dict[str, int]] = {lang: {} for lang in langs}
    for r in top.orderBy("lang", "rank").select("lang", "w", "n").toLocalIterator():
        for p in parts_of(r["w"]):
            by_lang[r["lang"]][p] = by_lang[r["lang"]].get(p, 0) + r["n"]
    pieces = Pieces(public_pieces(vocabulary))
    # Each language's column depends on its own words alone.
    columns = [fit(list(found) or ["▁"], np.array([[n] for n in found.values()] or [[0]], float), pieces) for found in by_lang.values()]
    table = np.concatenate(columns, axis=1)
    prior = np.array([rows[x] for x in langs], float)
    return langs, np.log(prior / prior.sum()), table


def identify_language(docs: DataFrame, *, folds: int = 3, held_fold: int = 1, vocabulary: str = "piece_bpe_32k.model", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang); learns from the other folds only."""
    held = fold_of("doc_id", folds) == held_fold
    typed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, prior, table = train(typed.where(~held), vocabulary=vocabulary, **options)
    import hashlib

    key = hashlib.sha256(repr(langs).encode() + table.tobytes() + prior.tobytes()).hexdigest()
    src = typed.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    run = _score_batches(key, vocabulary, table.astype(np.float32), prior, langs)
    return src.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
