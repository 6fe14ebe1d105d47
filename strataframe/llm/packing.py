"""Packing of tokenised documents into sequences of at most ``max_tokens``.

Shortest-pack-first over the length histogram. Each document's tokens are cut
into whole sequences and one rest; the rests are packed. The histogram of rest
lengths has at most ``max_tokens`` entries however many documents there are, so
packing happens on the driver over counts alone: lengths are placed longest
first into the open packs with the fewest tokens that they fit (the shortest pack),
and a placement moves as many packs of one pattern as there are rests. Rests that
fit no open pack fill new ones, as many of a length in each as fit. The result is a list of patterns (lengths) with counts. Patterns join back to
documents by rank: the k-th rest of a length takes the k-th slot of that length.

Ranks come from counts per (length, salt) and a running sum over the salts, so
a length that a third of all documents share is dealt over many tasks.

Cases: null text is an empty text (one token, the end mark); a null doc_id is
kept; repeated rows are packed each on its own; an empty table gives an empty
result; other columns are ignored; very long texts give many whole sequences.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BREAK_CHARS, ensure_checkpoint_dir, map_texts, text_or_empty

MAX_TOKENS = 2048
END_ID = 1
#: Tasks over which the rests of one length are ranked.
SALTS = 256
#: Entries from which a worker's word cache starts a new generation, which changes no result.
CACHE_WORDS = 400_000
#: The last character of the blocks that are cut by a spelled-out pattern; NFC changes none of them.
LATIN = 0x24F
#: Runs that are encoded as one text.
RUNS = 500
#: Bytes of text, about, that are tokenised together.
CHUNK_BYTES = 1 << 20


class WordTokenizer:
    """ids of a text by a tokenizers file that drops white space, word by word through a cache.

    The file's pre-tokenizer cuts lower-case text into runs: letters, single digits, others. A text
    of Latin characters without a special token's opening is cut into its runs by the same pattern. Any other
    is cut at white space, across which no run goes, and its words, where not plain, go to the tokenizer as
    they are. Runs and words are looked up in one cache. A run's last id, and no other, has the vocabulary's
    word end, so that many runs are encoded as one text and told apart after.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok = Tokenizer.from_file(path)
        # For runs, which are normal already and stand between spaces.
        self.run_tok = Tokenizer.from_file(path)
        self.run_tok.normalizer = None
        self.run_tok.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # The same pattern up to LATIN, spelled out for the faster module.
        latin = [chr(c) for c in range(0x80, LATIN + 1)]
        letters, numbers = ("".join(c for c in latin if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.cut_latin = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9{numbers}]|[^\t-\r \x85\xa0a-z0-9{letters}{numbers}]+").findall
        # Two generations of words and runs: a full young one becomes the old one, and those still in use come back from it.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _encode(self, strings: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit bytes, so that a text's ids are one join."""
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tok.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """The same for runs of one kind of character, many to a call."""
        if not runs:
            return []
        joined = [" ".join(runs[i : i + RUNS]) for i in range(0, len(runs), RUNS)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.run_tok.encode_batch_fast(joined, add_special_tokens=False)])
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(runs) or ends[-1] != 4 * len(ids):  # a vocabulary of another kind
            return self._encode(runs)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _known(self, strings: set[str]) -> set[str]:
        """Those not in the cache; those of the old generation come back into it."""
        strings = strings.difference(self.words)
        back = {s: self.old_words[s] for s in strings if s in self.old_words}
        self.words.update(back)
        return strings.difference(back)

    def _learn_runs(self, runs: set[str]) -> None:
        fresh = list(self._known(runs))
        self.words.update(zip(fresh, self._encode_runs(fresh), strict=True))

    def _learn_words(self, words: set[str]) -> None:
        whole: list[str] = []
        cuts: dict[str, list[str]] = {}
        for w in self._known(words):
            if len(w) > 200 or "<|" in w or (not w.isascii() and ord(max(w)) > LATIN):
                whole.append(w)
            else:
                cuts[w] = self.cut(w.lower() if w.isascii() else unicodedata.normalize("NFC", w).lower())
        self._learn_runs(set().union(*cuts.values()))
        self.words.update(zip(whole, self._encode(whole), strict=True))
        of = self.words.__getitem__
        self.words.update({w: b"".join(map(of, c)) for w, c in cuts.items()})

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each whole text, without an end mark."""
        if len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        found: list[bytes | tuple[list[str], list[bytes | None], list[int]]] = []  # a text's ids, or its strings, their ids, places without
        runs: set[str] = set()
        words: set[str] = set()
        get = self.words.get
        for t in texts:
            low = t.lower()
            if "<|" not in t and (low.isascii() or np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").max() <= LATIN):
                strings, new = self.cut_latin(low), runs
            else:
                for c in WORD_BREAK_CHARS[1:]:
                    t = t.replace(c, " ")
                strings, new = t.split(" "), words
            ids = list(map(get, strings))
            try:
                found.append(b"".join(ids))
            except TypeError:  # a string is not known yet
                gaps = [i for i, known in enumerate(ids) if known is None]
                new.update([strings[i] for i in gaps])
                found.append((strings, ids, gaps))
        self._learn_runs(runs)
        self._learn_words(words)
        out = []
        for x in found:
            if not isinstance(x, bytes):
                strings, ids, gaps = x
                for i in gaps:
                    ids[i] = self.words[strings[i]]
                x = b"".join(ids)
            out.append(np.frombuffer(x, "<u4"))
        return out


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, salt int"


def _piece_batches(tokenizer: str, max_tokens: int, end_id: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(public_path(tokenizer) if "/" not in tokenizer else tokenizer)
        turn = 0
        for batch in batches:
            ids_, rows = batch.column("doc_id").to_pylist(), {k: [] for k in ("d", "s", "n", "c", "t", "z")}
            for doc, ids in zip(ids_, _tokens(tok, batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), max_tokens):
                    part = ids[s : s + max_tokens]
                    turn += 1
                    for k, v in zip("dsnctz", (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), ((doc or 0) * 0x9E3779B1 + s) % 2**32 * salts >> 32), strict=True):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[k], pa.int64()) for k in "dsnct"] + [pa.array(rows["z"], pa.int32())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"],
            )

    return run


def _tokens(tok: WordTokenizer, column: pa.Array) -> Iterator[np.ndarray]:
    texts: list[str] = []
    held = 0
    for t in column:
        texts.append(t.as_py())
        held += len(texts[-1])
        if held >= CHUNK_BYTES:
            yield from tok.ids_of(texts)
            texts, held = [], 0
    yield from tok.ids_of(texts)


def shortest_pack_first(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of the pack) that hold every rest of the histogram exactly once."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # tokens in the pack -> pattern -> count
    totals: list[int] = []  # keys of open_, ascending
    from bisect import bisect_left, insort

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in open_:
            open_[total] = {}
            insort(totals, total)
        open_[total][pattern] = open_[total].get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not totals or totals[0] + length > max_tokens:
                # As one at a time would: a new pack is the shortest until it is full.
                most = max_tokens // length
                for copies, n in ((most, left // most), (left % most, 1)):
                    if copies and n:
                        put(copies * length, (length,) * copies, n)
                break
            shortest = totals[0]
            pattern, n = next(iter(open_[shortest].items()))
            use = min(n, left)
            if use == n:
                del open_[shortest][pattern]
                if not open_[shortest]:
                    del open_[shortest]
                    totals.pop(bisect_left(totals, shortest))
            else:
                open_[shortest][pattern] = n - use
            if shortest + length == max_tokens:
                open_.setdefault(max_tokens + 1, {})  # full packs, out of the way
                full = open_[max_tokens + 1]
                full[(*pattern, length)] = full.get((*pattern, length), 0) + use
            else:
                put(shortest + length, (*pattern, length), use)
            left -= use
    return [(n, p) for group in open_.values() for p, n in group.items()]


def pack_documents(
    docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, salts: int = SALTS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    pieces = map_texts(src, _piece_batches(tokenizer, max_tokens, end_id, salts), _PIECES).checkpoint()

    # max_tokens x salts rows at most, whatever the data or the cluster; of these only the histogram, max_tokens rows, comes to the driver.
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    prior = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(max_tokens, 0)
    slots: list[tuple[int, int, int, int, int]] = []  # length, first rank, packs, first sequence, offset
    used: dict[int, int] = {}
    sequence = whole
    if whole:
        slots.append((max_tokens, 0, whole, 0, 0))
    for n, pattern in shortest_pack_first(histogram, max_tokens):
        offset = 0
        for length, copies in Counter(pattern).items():  # longest first, as they stand in the pattern
            slots.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * copies
            offset += length * copies
        sequence += n
    by_length: dict[int, list] = {}
    for s in sorted(slots):
        by_length.setdefault(s[0], []).append(s[1:])

    # The join follows the window's partitioning, so the pieces are exchanged once.
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("number", number).join(prior, ["length", "salt"]).withColumn("rank", F.col("prior") + F.col("number") - 1)
    ranked = ranked.drop("prior", "salt", "number")
    return ranked.mapInArrow(
        _slot_batches(by_length),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def _slot_batches(by_length: dict[int, list]):
    """by_length: slots of each length by first rank; their number follows the patterns, at most a few for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.array(v, np.int64) for k, v in by_length.items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                t = tables[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                copy, pack = np.divmod(rank[at] - row[:, 0], row[:, 1])
                seq[at] = row[:, 2] + pack
                off[at] = row[:, 3] + copy * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(seq), pa.array(off)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run
