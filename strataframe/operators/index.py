"""Spatial indexes as columns: the kind and fineness of an index follow a table's extent and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.rect import Rect

Extent = tuple[float, float, float, float]
KINDS = ("noindex", "grid", "qtree", "zorder", "xzorder")
#: Features of a leaf of the quadtree, by count of all (fixed values).
LEAF_SHARE, LEAST_LEAF, MOST_LEAF = 256, 1000, 10_000
#: Levels that an adaptive quadtree counts at most: 4^8 cells come to the driver.
DEPTH = 8


def extent_of(df: DataFrame) -> tuple[Extent | None, int]:
    """Bounds and count of a table with boxes."""
    r = df.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), F.count(F.lit(1))).first()
    return (None if r[0] is None else (r[0], r[1], r[2], r[3])), r[4]


def leaf_capacity(n: int) -> int:
    return min(max(n // LEAF_SHARE, LEAST_LEAF), MOST_LEAF)


def with_index(df: DataFrame, extent: Extent | None = None, kind: str = "zorder", rows: int | None = None) -> tuple[str, int, DataFrame]:
    """(kind, level, df with the index's column): code for zorder and xzorder, leaf for qtree, cx and cy (a row a cell) for grid."""
    if kind not in KINDS:
        raise ValueError(f"unknown index {kind!r}")
    if kind == "noindex":
        return kind, 0, df
    if extent is None or rows is None:
        found, n = extent_of(df)
        extent, rows = extent or found or (0.0, 0.0, 1.0, 1.0), n if rows is None else rows
    level = cells.zorder_level(rows)
    if kind == "grid":
        from .join import with_cells

        return kind, level, with_cells(df, cells.grid_side((extent[2] - extent[0]) * (extent[3] - extent[1]) or 1.0, rows))
    if kind == "qtree":
        return kind, level, quadtree_leaves(df, extent, leaf_capacity(rows))
    code = cells.zorder_code if kind == "zorder" else cells.xzorder_code
    return kind, level, df.withColumn("code", code(Rect.of(), extent, level))


def quadtree_leaves(df: DataFrame, extent: Extent, capacity: int, depth: int = DEPTH) -> DataFrame:
    """df with ``leaf``: the path of its node in a quadtree that splits a node only where it holds more than ``capacity`` features.

    A feature goes down to the deepest node that covers it, and no deeper than a leaf. Counts per node of the finest level come from one
    aggregate of at most 4^depth rows, and the tree is made of them on the driver.
    """
    keyed = df.withColumn("_path", cells.quad_key(Rect.of(), extent, depth))
    counts = {r["_path"]: r["n"] for r in keyed.groupBy("_path").agg(F.count(F.lit(1)).alias("n")).collect()}
    below: dict[str, int] = {}
    for path, n in counts.items():
        for k in range(len(path) + 1):
            below[path[:k]] = below.get(path[:k], 0) + n
    leaf_of = {}
    for path in counts:
        k = 0
        while k < len(path) and below[path[:k]] > capacity:
            k += 1
        leaf_of[path] = path[:k]
    leaves = df.sparkSession.createDataFrame(list(leaf_of.items()) or [("", "")], "_path string, leaf string")
    return keyed.join(F.broadcast(leaves), "_path").drop("_path")


def leaf_meets(leaf: Column, box: Extent, extent: Extent, depth: int = DEPTH) -> Column:
    """Whether a node may hold a feature that meets the box: its path leads to a cell that does."""
    w, h = extent[2] - extent[0], extent[3] - extent[1]
    digit = lambda k: F.substring(leaf, k + 1, 1)
    # A digit beyond the path's end is empty and adds nothing.
    x = sum((F.when(digit(k).isin("2", "3"), 0.5 ** (k + 1)).otherwise(0.0) for k in range(depth)), F.lit(0.0))
    y = sum((F.when(digit(k).isin("1", "3"), 0.5 ** (k + 1)).otherwise(0.0) for k in range(depth)), F.lit(0.0))
    side = F.pow(F.lit(0.5), F.length(leaf))
    minx, miny = extent[0] + x * w, extent[1] + y * h
    return (minx <= box[2]) & (minx + side * w >= box[0]) & (miny <= box[3]) & (miny + side * h >= box[1])
