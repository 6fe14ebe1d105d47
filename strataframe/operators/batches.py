"""Slices and batches of a table by the rank of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of the key that are ranked apart, each in a task of its own.
RANGES = 256
#: Batches of a copy at most.
MOST_BATCHES = 200


def range_of(key: Column, bounds: list) -> Column:
    """Number of the bounds that a key is over: the same for a row however often it is asked."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < key))


def ranked(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """df with ``rank`` from 0 by key. Ranges of the key come from quantiles taken once, so no task ranks all rows, and no row's range can change between two runs."""
    bounds = df.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    placed = df.withColumn("_range", range_of(F.col(key), sorted(set(bounds))))
    counts = sorted((r["_range"], r["n"]) for r in placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    prior = df.sparkSession.createDataFrame(before or [(0, 0)], "_range int, _prior bigint")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1 + F.col("_prior")
    return placed.join(F.broadcast(prior), "_range").withColumn("rank", rank).drop("_range", "_prior")


def slices(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with ``slice``: n slices of even size by key, the remainder in the last."""
    size = max(df.count() // n, 1)
    return ranked(df, key).withColumn("slice", F.least(F.floor(F.col("rank") / size), F.lit(n - 1))).drop("rank")


def batch_size(rows: int, first: int = 1000, most: int = MOST_BATCHES) -> int:
    """Rows of a batch: doubled until there are few enough batches."""
    size = first
    while -(-rows // size) > most:
        size *= 2
    return size
