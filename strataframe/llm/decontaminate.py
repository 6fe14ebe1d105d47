"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared lower-cased, with each run of white space as
one space. An item of m characters has an error budget of
k = floor(rate * m) edits. It is cut into k + 1 pieces of even length: a passage within k edits of it holds
at least one piece unchanged. One automaton over all pieces finds every exact
hit in a document; around each hit's place the distance of the item to the best
passage there is computed by Myers' bit-parallel search. Hits of one item whose places differ
by at most k share one verified stretch.

The benchmark is a stated query set: it comes to the driver and is matched
against all documents in blocks of at most ``block_chars`` characters, one pass
a block, so what is sent to the executors is bounded.

Cases: null text is an empty text and null items are ignored, as are items
without a word; equal items are matched once under all their ids; repeated rows
are judged each on its own; a null doc_id keeps its row; an empty benchmark
marks nothing; an empty table gives an empty result; other columns are left
alone. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

RATE = 0.07
BLOCK_CHARS = 4_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget_of(m: int, rate: float = RATE) -> int:
    return int(m * rate)


def pieces_of(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, k: int) -> int:
    """Least edit distance of the pattern to any stretch of the text; k + 1 if it is over k."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = where.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return min(best, k + 1)


class Matcher:
    def __init__(self, items: dict[str, list[int]], rate: float = RATE):
        import ahocorasick

        self.items = sorted(items)
        self.ids = [sorted(items[x]) for x in self.items]
        self.k = [budget_of(len(x), rate) for x in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (x, k) in enumerate(zip(self.items, self.k, strict=True)):
            for at, piece in pieces_of(x, k):
                owners.setdefault(piece, []).append((i, at + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, o in owners.items():
            self.automaton.add_word(piece, o)
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of the items that the normalised text holds within their budgets."""
        places: dict[int, list[int]] = {}
        if not self.items:
            return []
        for end, owners in self.automaton.iter(text):
            for i, off in owners:
                places.setdefault(i, []).append(end + 1 - off)
        out = []
        for i, starts in places.items():
            item, k = self.items[i], self.k[i]
            best = 0 if item in text else self._near(item, k, sorted(set(starts)), text)
            if best <= k:
                out += [(x, best) for x in self.ids[i]]
        return sorted(out)

    @staticmethod
    def _near(item: str, k: int, starts: list[int], text: str) -> int:
        best, i = k + 1, 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= k:
                j += 1
            lo, hi = max(0, starts[i] - k), starts[j] + len(item) + k
            best = min(best, myers(item, text[lo:hi], k))
            i = j + 1
        return best


def _blocks(benchmark: DataFrame, block_chars: int) -> list[dict[str, list[int]]]:
    out: list[dict[str, list[int]]] = [{}]
    held = 0
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").collect()
    for r in sorted(rows, key=lambda r: (r["text"], r["item_id"])):
        item = normalised(r["text"])
        if not item:
            continue
        if item not in out[-1] and held + len(item) > block_chars and out[-1]:
            out.append({})
            held = 0
        if item not in out[-1]:
            held += len(item)
        ids = out[-1].setdefault(item, [])
        if r["item_id"] not in ids:
            ids.append(r["item_id"])
    return out


_READY: dict[int, Matcher] = {}


def _matcher(items: dict[str, list[int]], rate: float):
    """A function that gives this block's matcher; a worker keeps the last two it made."""
    key = hash((rate, tuple((k, tuple(v)) for k, v in items.items())))

    def get() -> Matcher:
        if key not in _READY:
            while len(_READY) > 1:
                _READY.pop(next(iter(_READY)))
            _READY[key] = Matcher(items, rate)
        return _READY[key]

    return get


def _match_batches(items: dict[str, list[int]], rate: float, clean_only: bool):
    ready = _matcher(items, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready()
        for batch in batches:
            found = [m.hits(normalised(t.as_py())) for t in batch.column("text")]
            if clean_only:
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([bool(f) for f in found], pa.bool_()),
                        pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[d for _, d in f] for f in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "contaminated", "item_ids", "distances"],
                )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, contaminated, item_ids, distances for each row of docs(doc_id, text); both lists are sorted by item id."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, contaminated boolean, item_ids array<bigint>, distances array<bigint>"
    blocks = _blocks(benchmark, block_chars)
    if len(blocks) == 1:
        return map_texts(src, _match_batches(blocks[0], rate, False), schema)
    # With several blocks each adds a column of hits to the same row; rows are never joined.
    out = src
    columns = "doc_id bigint, text string"
    for n, items in enumerate(blocks):
        columns += f", hits_{n} array<struct<i:bigint,d:bigint>>"
        out = map_texts(out, _append_batches(items, rate, n), columns)
    hits = F.array_sort(F.concat(*(f"hits_{n}" for n in range(len(blocks)))))
    return out.select(
        "doc_id", (F.size(hits) > 0).alias("contaminated"), hits.getField("i").alias("item_ids"), hits.getField("d").alias("distances")
    )


def _append_batches(items: dict[str, list[int]], rate: float, n: int):
    ready = _matcher(items, rate)
    kind = pa.list_(pa.struct([("i", pa.int64()), ("d", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready()
        for batch in batches:
            found = [[{"i": i, "d": d} for i, d in m.hits(normalised(t.as_py()))] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, f"hits_{n}"])

    return run


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of docs, all columns, that hold no test item."""
    for items in _blocks(benchmark, block_chars):
        docs = map_texts(docs, _match_batches(items, rate, True), docs.schema)
    return docs
