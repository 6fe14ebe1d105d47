"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Everything on the path is a DataFrame or SQL function.

``quality_rules`` gives one row for each row of its input:

* null text counts as an empty text; an empty text has all counts 0, score 0.0
  and ``base_failed`` true (fewer than 50 words);
* rows with equal text get equal results, repeated rows are repeated;
* other columns of the input are ignored, so their names cannot clash;
* an empty input gives an empty result; without trusted rows the ratio is 0.0
  for every document and the threshold 0.0, so the base rules alone decide;
* text length is not limited: the work for a text is n log n in its words.

The method: pairs of neighbouring words are hashed into ``buckets`` cells. Two multinomials with add-one smoothing are counted, one
over all trusted rows (labels.quality = 1), one over all documents. A document's score is the mean of
log(p_target / p_raw) over its word pairs. The threshold is the ``quantile`` of the
scores of all trusted rows minus ``slack``, one number for all documents; nothing is drawn at random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_table, marked_rows, saved, text_or_empty, words_of

BUCKETS = 1 << 14
QUANTILE = 0.002
SLACK = 0.02
#: Ranges into which scores are counted at once where a quantile is looked for.
RANGES = 4096
#: Words of 64 rows up to which the marks of trusted rows are sent to each executor; more are exchanged, with the pairs' buckets.
MARK_WORDS = 1 << 20
SYMBOLS_KEPT = r"[^#*$%&|<>]++"


def _after(words: str, by: int) -> F.Column:
    return F.slice(words, by + 1, F.greatest(F.size(words) - by, F.lit(0)))


def _pairs(hashes: str) -> F.Column:
    """One hash for each two neighbouring words; the last word pairs with nothing (null)."""
    return F.zip_with(hashes, _after(hashes, 1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _bucket(pair: F.Column, buckets: int) -> F.Column:
    return pair.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _hashed(docs: DataFrame) -> DataFrame:
    """words and the 64-bit hash of each; each costly array is a column of its own so that it is made once."""
    df = docs.withColumn("words", words_of(F.col("text")))
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _base_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """The base counts of docs(..., text), and ``cells``: the bucket of each word pair in order."""
    has_word = r"[^\x20\x09-\x0D]"
    df = _hashed(docs).withColumns(
        {
            "pairs": _pairs("hashes"),
            "n_symbols": F.length(F.regexp_replace("text", SYMBOLS_KEPT, "")).cast("long"),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(has_word)),
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
        }
    )
    windows = F.zip_with("pairs", _after("hashes", 2), lambda p, w: F.when(w.isNotNull(), F.xxhash64(p, w)))
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "windows": F.slice(windows, 1, F.greatest(F.size("hashes") - 2, F.lit(0))),
        }
    )
    # Sorted (hash, start) pairs put equal windows side by side; starts of repeated ones, sorted
    # again, cover 3 words each or as many as there are up to the next start.
    ordered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    n = F.size("ordered")
    again = F.transform(
        "ordered",
        lambda p, k: F.when(
            ((k > 0) & (F.get("ordered", k - 1)["h"] == p["h"])) | ((k < n - 1) & (F.get("ordered", k + 1)["h"] == p["h"])), p["i"]
        ),
    )
    df = df.withColumn("again", F.when(F.col("ordered").isNotNull(), F.sort_array(F.filter(again, lambda i: i.isNotNull()))))
    covered = F.aggregate(
        F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    cells = F.transform(F.slice("pairs", 1, F.greatest(F.size("pairs") - 1, F.lit(0))), lambda p: _bucket(p, buckets))
    return df.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "cells": cells}).drop(
        "text", "words", "hashes", "pairs", "lines", "windows", "ordered", "again"
    )


def quantile_of(scores: DataFrame, quantile: float) -> float | None:
    """The quantile of ``score``, with linear interpolation between neighbours; None without rows. Scores are counted by ranges, and the range that
    holds the quantile again until it is found exactly: no task holds more than ``RANGES`` numbers."""
    n, lo, hi = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
    if not n:
        return None
    first = int(quantile * (n - 1))
    share = quantile * (n - 1) - first
    below = 0  # rows under lo
    while lo < hi:
        place = F.least(F.floor((F.col("score") - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1)).alias("r")
        inside = scores.where((F.col("score") >= lo) & (F.col("score") <= hi)).groupBy(place)
        ranges = sorted(inside.agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect(), key=lambda r: r["r"])
        for k, r in enumerate(ranges):
            if first < below + r["n"]:
                break
            below += r["n"]
        if first == below + r["n"] - 1:
            # The last of its range: the next row is the first of the next one.
            after = ranges[k + 1]["lo"] if k + 1 < len(ranges) else hi
            return r["hi"] + share * (after - r["hi"])
        lo, hi = r["lo"], r["hi"]
    return lo


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    buckets: int = BUCKETS,
    quantile: float = QUANTILE,
    slack: float = SLACK,
) -> DataFrame:
    """Base counts, ``score`` (mean log-likelihood ratio), ``base_failed`` and ``kept`` for every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()

    # The texts are read once: what is told of each row, its pairs' buckets among it (less than two bytes a pair), is kept as a table.
    told = saved(_base_counts(docs, buckets).withColumn("row", F.monotonically_increasing_id()), "rules")
    # Only ids and numbers of rows meet the labels; what comes back is one bit a row, so the buckets stay where they are.
    trusted = told.select("doc_id", F.col("row").alias("key")).join(good, "doc_id", "left_semi")
    marks = saved(bit_table(trusted, 64), "trusted")
    everywhere = marks.count() <= MARK_WORDS
    cells = marked_rows(told.select("row", "cells"), "row", marks, "trusted", everywhere).select("trusted", F.explode("cells").alias("b"))
    counts = cells.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target"))
    # One row: an array with the log ratio of each bucket. Its size is set by ``buckets``, not by the data.
    full = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    full = full.select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    one = full.agg(
        F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("cells")
    )
    ratio = one.select(
        F.transform(
            "cells",
            lambda c: F.when(
                F.col("targets") > 0,
                F.log((c["target"] + 1) / (F.col("targets") + buckets)) - F.log((c["raw"] + 1) / (F.col("raws") + buckets)),
            ).otherwise(F.lit(0.0)),
        ).alias("ratio")
    )
    # The one row (``buckets`` numbers) comes to the driver and goes back as a constant that is folded once.
    row = ratio.first()["ratio"]
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in row)), ",").cast("array<double>")

    total = F.aggregate("cells", F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    scored = told.withColumn("score", total / F.greatest(F.size("cells"), F.lit(1)))
    long = scored.where("n_words >= 50").select("row", "score")
    cut = quantile_of(saved(marked_rows(long, "row", marks, "trusted", everywhere).where("trusted").select("score"), "scores"), quantile)
    cut = 0.0 if cut is None else cut - slack
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= F.lit(cut))).alias("kept"),
        "score",
    )
