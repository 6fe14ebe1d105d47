"""SimHash near-duplicates with Golay-code fuzzy keys.

``fingerprints`` gives a 64-bit SimHash for each row, ``links`` the pairs of
different fingerprints that differ in at most 3 bits, ``near_duplicates`` one
row per input row with its fingerprint and its component.

Cases: null text is an empty text; texts without a word get fingerprint 0 and
link like any other; equal texts share a fingerprint and so a component;
repeated rows are repeated in the result; a null doc_id keeps its row, and its
component is named by the smallest other id (null if there is none); other
columns are ignored; an empty table gives an empty result. A text of any
length is read whole, some bytes a word in memory.

How links are found. The 64 bits are cut into segments of 22, 21 and 21 bits,
each read as a word of the binary Golay code [23, 12, 7]. The code is perfect:
every word lies within 3 bits of exactly one codeword, whose 12-bit index is
the word's decoded key. ``own(x)`` is the key of x; ``near(x)`` holds the keys
of x and of all words one bit away, 6 at most. If x and y differ in at most one
bit, own(y) is in near(x). Three errors in three segments leave either

* a segment without error; then one of the other two has at most one: key
  (that segment's bits, own or near of the other), or
* one error in each segment: key (near x own x own) meets (own x near x near).

Both sides are joined on these keys; the distance is verified, and each pair
is kept only under the first key pattern that fits it. Keys have 33 bits or more,
so chance meetings stay rare, and no bucket is ever expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, ensure_checkpoint_dir, join_by_weight, map_texts, maybe_in, text_or_empty, word_bounds, xxh64_slices

MAX_BITS = 3
SHINGLE = 3
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the cyclic Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text: a bit is set if it is set in over half the shingles' XXH64."""
    joined = b" ".join(text.lower().split())
    starts, ends = word_bounds(joined)
    if not len(starts):
        return 0
    if len(starts) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        s, e = starts[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        ones += _ones(xxh64_slices(joined, s, e - s))
    return _pack(ones, len(starts))


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _pack(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        out = np.zeros(len(texts), np.uint64)
        for lo, hi in _chunks(texts):
            out[lo:hi] = _fingerprints(texts[lo:hi])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, so that the vectors stay small."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _fingerprints(texts: list[bytes]) -> np.ndarray:
    """As fingerprint_of, hashing the shingles of all texts in one call."""
    if len(texts) == 1:
        return np.array([fingerprint_of(texts[0])], np.uint64)
    parts, starts, lens, sizes, base = [], [], [], [], 0
    for t in texts:
        joined = b" ".join(t.lower().split())
        s, e = word_bounds(joined)
        if len(s) and len(s) < SHINGLE:
            s, e = s[:1], e[-1:]
        elif len(s):
            s, e = s[: len(s) - SHINGLE + 1], e[SHINGLE - 1 :]
        parts.append(joined)
        starts.append(s + base)
        lens.append(e - s)
        sizes.append(len(s))
        base += len(joined)
    h = xxh64_slices(b"".join(parts), np.concatenate(starts), np.concatenate(lens))
    out = np.zeros(len(texts), np.uint64)
    at = 0
    for i, n in enumerate(sizes):
        if n:
            out[i] = _pack(_ones(h[at : at + n]), n)
            at += n
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) for each row of docs(doc_id, text)."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return map_texts(src, _fingerprint_batches, "doc_id bigint, fp bigint")


# --- Golay keys ---------------------------------------------------------------


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator: the 11-bit syndrome."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def _error_table() -> np.ndarray:
    """Syndrome -> the one error pattern of at most 3 bits that has it."""
    single = [1 << i for i in range(23)]
    errors = [0] + single
    errors += [a | b for i, a in enumerate(single) for b in single[:i]]
    errors += [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]]
    errors = np.array(errors, np.int64)
    table = np.zeros(2048, np.int64)
    table[_remainder(errors)] = errors
    return table


_ERRORS = _error_table()


def own_key(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within 3 bits of each word."""
    words = words.astype(np.int64)
    return (words ^ _ERRORS[_remainder(words)]) >> 11


def near_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for the distinct keys of each word and of its neighbours one bit away."""
    words = words.astype(np.int64)
    all_keys = np.stack([own_key(words)] + [own_key(words ^ (1 << b)) for b in range(bits)], axis=1)
    all_keys.sort(axis=1)
    fresh = np.ones(all_keys.shape, bool)
    fresh[:, 1:] = all_keys[:, 1:] != all_keys[:, :-1]
    rows, cols = np.nonzero(fresh)
    return rows, all_keys[rows, cols]


#: Key patterns with a clean segment: (clean, fuzzy). The last pattern is one error in each.
PATTERNS = tuple((i, j) for i in range(3) for j in range(3) if i != j)
TRIPLE = len(PATTERNS)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column("fp").slice(at, 4096).to_numpy().view(np.uint64)
            if len(fp):
                yield from _keys(fp)


def _emit(side: int, pattern: int, rows: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(rows), side, np.int8)),
            pa.array(key * 8 + pattern),
            pa.array(fp[rows].view(np.int64)),
        ],
        names=["side", "key", "fp"],
    )


def _keys(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    seg = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    own = [own_key(s) for s in seg]
    near = [near_keys(s, n) for s, (_, n) in zip(seg, SEGMENTS, strict=True)]
    everyone = np.arange(len(fp))
    for p, (i, j) in enumerate(PATTERNS):
        yield _emit(0, p, everyone, seg[i] << 12 | own[j], fp)
        rows, key = near[j]
        yield _emit(1, p, rows, seg[i][rows] << 12 | key, fp)
    rows, key = near[0]
    yield _emit(0, TRIPLE, rows, (key << 12 | own[1][rows]) << 12 | own[2][rows], fp)
    left, lkey = near[1]
    right, rkey = near[2]
    first = np.searchsorted(right, everyone)
    count = np.bincount(right, minlength=len(fp))
    rep = count[left]
    rows = np.repeat(left, rep)
    offset = np.arange(len(rows)) - np.repeat(np.cumsum(rep) - rep, rep)
    rk = rkey[first[rows] + offset]
    yield _emit(1, TRIPLE, rows, (own[0][rows] << 12 | np.repeat(lkey, rep)) << 12 | rk, fp)


def links(distinct_fps: DataFrame) -> DataFrame:
    """(a, b) with a < b: fingerprints of the column ``fp`` (distinct) that differ in 1 to 3 bits, each pair once."""
    keys = distinct_fps.select("fp").mapInArrow(_key_batches, "side tinyint, key bigint, fp bigint")
    left = keys.where("side = 0").select("key", F.col("fp").alias("a"))
    right = keys.where("side = 1").select("key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    wrong = [F.bit_count(F.shiftrightunsigned(diff, lo).bitwiseAND(F.lit((1 << n) - 1))) for lo, n in SEGMENTS]
    first = F.lit(TRIPLE)
    for p, (i, j) in reversed(list(enumerate(PATTERNS))):
        first = F.when((wrong[i] == 0) & (wrong[j] <= 1), F.lit(p)).otherwise(first)
    fits = (F.col("a") < F.col("b")) & (F.bit_count(diff) <= MAX_BITS) & (first == F.col("left.key").bitwiseAND(F.lit(7)))
    return left.alias("left").join(right.alias("right"), (F.col("left.key") == F.col("right.key")) & fits).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. edges: (a, b), in any order.

    Alternating large-star and small-star steps: each turns the edges into stars
    around smaller nodes, and their number never grows; the steps go on until they change nothing. A step's result is written to the checkpoint
    folder, so a lost executor costs one step, and the plan stays short.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        # Two equal states in a row: every node hangs on its component's smallest node.
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for each row."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).checkpoint()
    pairs = links(nodes).checkpoint()
    roots = components(pairs)
    linked = roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = nodes.join(linked, "fp")
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Names for fingerprints that have a link or several rows; any other row is a component of its own.
    named = linked.join(best, "root").select("fp", "n", "component_id")
    alone = nodes.where("n > 1").join(named.select("fp"), "fp", "left_anti").select("fp", "n", F.col("least").alias("component_id"))
    names = named.unionByName(alone).checkpoint()
    told = maybe_in(fps, "fp", bit_table(names.select(F.col("fp").alias("key"))), "may").checkpoint()
    rows = told.where("may").select("doc_id", "fp")
    # Of those that may have a name most have; a fingerprint that many rows share is named without an exchange.
    total = names.agg(F.sum("n")).first()[0] or 0
    found = join_by_weight(rows, names, ["fp"], "n", total, "left").select("doc_id", "fp", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.unionByName(told.where("not may").select("doc_id", "fp", F.col("doc_id").alias("component_id"))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
