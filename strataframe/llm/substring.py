"""Removal of word windows that also start in an earlier document, found by level-wise doubling.

Windows of ``window`` words are found over levels: the shortest level is a
length of which two overlapping windows make the next, and so on up to
``window`` (13 words: levels 7 and 13). Only windows repeated at one level
are extended to the next; a level without survivors ends the search.

At the first level only some positions need to travel: each window of the last
level sends the shortest-level window with the least hash inside it (its
minimiser). Equal windows choose equal minimisers at equal places, so a window
that repeats has a minimiser that repeats, and none is lost.

How it runs. Documents are dealt into groups by a hash of their id and text, about
``group_docs`` documents each. For each level a group sends each distinct hash once, with
its smallest document; rows of one hash meet sorted, and a streaming pass that holds one row
sends back which hashes repeat. So a passage in a third of all documents costs
one row a group, no group of rows is collected, and the texts are exchanged once.
Equal texts are found first (two 64-bit hashes); only the one with the smallest
id takes part, the others repeat from start to end.

Hashes of windows have 64 bits, kept with no further check: two different windows
among n are confused with a chance below n^2 / 2^65.

Cases: null text has no words; texts with fewer words than the window lose
none; ids must be integers, a null doc_id ranks after all others; repeated rows
(equal id) do not remove each other; other columns are ignored; an empty table
gives an empty result. A very long text is handled in one task as a whole, some
40 bytes of memory a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, join_by_weight, mix64, text_or_empty, word_bounds

WINDOW = 13
GROUP_DOCS = 500
_LAST = 2**63 - 1


def levels_of(window: int, shortest: int = 7) -> list[int]:
    """Lengths from the shortest level to the window; each is at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


#: Odd numbers of the hashes of words and of windows, and their inverses modulo 2^64.
_BYTE_STEP, _WORD_STEP = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15
#: Bytes of a text whose words are hashed together.
BLOCK = 1 << 21
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step^0 ... step^(n-1) and the same of its inverse, modulo 2^64; kept and extended."""
    held = _POWERS.get(step)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(s))], dtype=np.uint64) for s in (step, pow(step, -1, 2**64)))
        held = up, down
        if size <= 4 * BLOCK:
            _POWERS[step] = held
    return held[0][:n], held[1][:n]


def word_hashes(joined: bytes) -> np.ndarray:
    """Hash of each word: a polynomial of its bytes, from sums over all bytes before each place, then mixed with its length."""
    starts, ends = word_bounds(joined)
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
            first, last = int(starts[at]), int(ends[to - 1])
            up, down = _powers(_BYTE_STEP, last - first + 1)
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((np.frombuffer(joined, np.uint8, last - first, first).astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (sums[e] - sums[s]) * up[s] + (e - s).astype(np.uint64) * np.uint64(_WORD_STEP)
            at = to
    return mix64(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(_WORD_STEP, len(words))
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * down, out=sums[1:])
        return mix64((sums[length:] - sums[:n]) * up[length - 1 :])


def minimisers(short: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` neighbouring short windows, the place of the least (the leftmost of equals)."""
    n = len(short) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place, width = short, np.arange(len(short)), 1
    while width < span:
        # Two runs side by side, or overlapping at the last step.
        by = min(width, span - width)
        a, b = least[:-by], least[by:]
        left = a <= b
        place = np.where(left, place[:-by], place[by:])
        least = np.where(left, a, b)
        width += by
    return place


def _joined(table: pa.Table) -> list[bytes]:
    return [b" ".join(t.split()) for t in table.column("text").cast(pa.large_binary()).to_pylist()]


class Group:
    """The documents of one group with what is known of them."""

    def __init__(self, docs: pa.Table, told: pa.Table, window: int):
        self.ids = [_LAST if i is None else i for i in docs.column("doc_id").to_pylist()]
        self.raw = docs.column("doc_id").to_pylist()
        self.joined = _joined(docs)
        kind, a, b = (told.column(c).to_numpy() for c in ("kind", "a", "b")) if told.num_rows else (np.empty(0, np.int8), *[np.empty(0, np.int64)] * 2)
        copies = set(zip(a[kind == 0].tolist(), b[kind == 0].tolist(), strict=True))
        h1 = docs.column("h1").to_numpy()
        self.copy = [(i, h) in copies for i, h in zip(self.ids, h1.tolist(), strict=True)]
        self.known = {}
        for level in np.unique(kind[kind > 0]):
            rows = kind == level
            h, least = a[rows].view(np.uint64), b[rows]
            order = np.argsort(h)
            self.known[int(level)] = h[order], least[order]
        self.levels = levels_of(window)
        self.window = window

    def find(self, level: int, h: np.ndarray) -> np.ndarray:
        """Smallest document with each hash, where it is known to repeat, else the largest number."""
        keys, least = self.known.get(level, (np.empty(0, np.uint64), np.empty(0, np.int64)))
        if not len(keys):
            return np.full(len(h), _LAST, np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, least[at], _LAST)

    def candidates(self, words: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of a level whose parts all repeat at the level below."""
        lengths = self.levels
        short = window_hashes(words, lengths[0])
        span = self.window - lengths[0] + 1
        picks = minimisers(short, span)
        if level == 1:
            at = np.unique(picks) if len(lengths) > 1 else np.arange(len(short))
            return at, short[at]
        repeats = self.find(1, short) != _LAST
        if level < len(lengths):  # a level between: windows inside a surviving span
            alive = repeats[picks]
            mask = np.zeros(len(words) + 1, np.int64)
            for s in np.flatnonzero(alive):
                mask[s] += 1
                mask[min(s + self.window, len(words))] -= 1
            inside = np.cumsum(mask)[:-1] > 0
            length = lengths[level - 1]
            at = np.flatnonzero(inside[: max(len(words) - length + 1, 0)])
        else:
            at = np.flatnonzero(repeats[picks])
            length = self.window
        if not len(at):
            return at, np.empty(0, np.uint64)
        h = window_hashes(words, length)
        for below in range(2, level):
            part = lengths[below - 1]
            ok = self.find(below, window_hashes(words, part)) != _LAST
            at = at[ok[at] & ok[at + length - part]]
        return at, h[at]


_SENT = "hash bigint, g int, least bigint, more boolean"
_TOLD = "g int, kind int, a bigint, b bigint"


def _send(window: int, level: int):
    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        parts, owners = [], []
        if docs.num_rows and (level == 1 or (told.num_rows and (told.column("kind").to_numpy() == level - 1).any())):
            group = Group(docs, told, window)
            for doc, copy, joined in zip(group.ids, group.copy, group.joined, strict=True):
                if copy:
                    continue
                words = word_hashes(joined)
                if len(words) < window:
                    continue
                h = np.unique(group.candidates(words, level)[1])
                parts.append(h)
                owners.append(np.full(len(h), doc, np.int64))
        h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        d = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
        at = np.flatnonzero(first)
        last = np.r_[at[1:], len(h)] - 1
        g = key[0].as_py()
        return pa.table(
            {
                "hash": pa.array(h[at].view(np.int64)),
                "g": pa.array(np.full(len(at), g, np.int32)),
                "least": pa.array(d[at]),
                "more": pa.array(d[at] != d[last] if len(at) else np.empty(0, bool)),
            }
        )

    return run


def _repeated(level: int):
    """Rows come sorted by (hash, least). Gives each group of a repeated hash the smallest document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the run that goes on, and whether it has been told
        for batch in batches:
            h, g, d, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "g", "least", "more"))
            if not len(h):
                continue
            if held is not None:
                h, g, d, m = (np.r_[x, y] for x, y in zip(held[:4], (h, g, d, m), strict=True))
            first = np.r_[True, h[1:] != h[:-1]]
            at = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            size = np.diff(np.r_[at, len(h)])
            tell = (size > 1)[run_of] | (m.astype(bool) & first)
            least = d[at][run_of]
            if held is not None and held[4]:
                tell[0] = False  # told with an earlier batch
                tell[1 : size[0]] = True
            out = np.flatnonzero(tell)
            i = at[-1]
            held = (h[i : i + 1], g[i : i + 1], d[i : i + 1], m[i : i + 1], bool(tell[i]) or (held is not None and held[4] and i == 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[out]), pa.array(np.full(len(out), level, np.int32)), pa.array(h[out]), pa.array(least[out])],
                names=["g", "kind", "a", "b"],
            )

    return run


def _remove(window: int):
    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept")}
        if docs.num_rows:
            group = Group(docs, told, window)
            last = len(group.levels)
            any_told = last in group.known
            for doc, raw, copy, joined in zip(group.ids, group.raw, group.copy, group.joined, strict=True):
                n = joined.count(b" ") + 1 if joined else 0
                kept, removed = joined, 0
                if n >= window and copy:
                    kept, removed = b"", n
                elif n >= window and any_told:
                    words = word_hashes(joined)
                    at, h = group.candidates(words, last)
                    at = at[group.find(last, h) < doc]
                    if len(at):
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        removed = int(gone.sum())
                        kept = b" ".join(w for w, x in zip(joined.split(b" "), gone.tolist(), strict=True) if not x)
                rows["doc_id"].append(raw)
                rows["n_words"].append(n)
                rows["n_removed"].append(removed)
                rows["kept"].append(kept)
        return pa.table(
            {
                "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "n_words": pa.array(rows["n_words"], pa.int64()),
                "n_removed": pa.array(rows["n_removed"], pa.int64()),
                "kept_text": pa.array(rows["kept"], pa.binary()).cast(pa.string()),
            }
        )

    return run


def _by_group(told: DataFrame):
    """Grouped under other names: both sides of a cogroup come from the same rows."""
    return told.select(F.col("g").alias("told_g"), "kind", "a", "b").groupBy("told_g")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) for each row of docs(doc_id, text)."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.count()
    groups = max(1, -(-rows // group_docs))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rank = F.coalesce("doc_id", F.lit(_LAST))
    # By id and text: rows without an id, or with the same one, are dealt out as others are.
    src = src.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.pmod(F.xxhash64(F.lit(1), rank, "text"), F.lit(groups)).cast("int").alias("g"))
    texts = src.groupBy("g")

    # Hashes of whole texts, kept as they are asked for three times.
    ids = src.select(rank.alias("doc"), "h1", F.xxhash64(F.lit(3), "text").alias("h2"), "g").checkpoint()
    least = ids.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").drop("most")
    copies = join_by_weight(ids, least, ["h1", "h2"], "n", rows).where("doc > least")
    told = copies.select("g", F.lit(0).alias("kind"), F.col("doc").alias("a"), F.col("h1").alias("b")).distinct().checkpoint()
    for level in range(1, len(levels_of(window)) + 1):
        sent = texts.cogroup(_by_group(told)).applyInArrow(_send(window, level), _SENT)
        back = sent.repartition("hash").sortWithinPartitions("hash", "least").mapInArrow(_repeated(level), _TOLD)
        told = told.unionByName(back)
    return texts.cogroup(_by_group(told)).applyInArrow(
        _remove(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    )


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
