"""Feature queries: fields, attribute condition and a spatial mode with a query rectangle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geometry import POINT, POLYGON, point_parts, rect_parts
from ..functions.rect import Rect
from . import where as attributes
from .relate import MODES, Shape, checked, may_be_apart, relates, transposed

BBOX = ("minx", "miny", "maxx", "maxy")


@dataclass(frozen=True)
class QueryDef:
    """fields None: all columns; an empty list: id and geometry only. box or shape None: no spatial filter.

    mode is a named one, or a pattern of nine of 0 1 2 F T *, of the query's rectangle or geometry against the feature.
    """

    fields: list[str] | None = None
    where: str | None = None
    mode: str = "Intersects"
    box: tuple[float, float, float, float] | None = None
    shape: Shape | None = None

    def bounds(self) -> tuple[float, float, float, float] | None:
        return self.box if self.shape is None else tuple(float(v) for v in self.shape.bounds())


def rect_shape(box: tuple[float, float, float, float]) -> Shape:
    a, b, c, d = box
    return Shape(POLYGON, [[[(a, d), (a, b), (c, b), (c, d), (a, d)]]])


def point_relation(rect: Rect, x: Column, y: Column, mode: str) -> Column:
    """The query rectangle against a point. What an area cannot be to a point is false; a pattern is held against the matrix."""
    mode = checked(mode)
    inside, edge = rect.contains_point(x, y), rect.touches_point(x, y)
    named = {
        "BBoxIntersects": inside | edge,
        "Intersects": inside | edge,
        "Disjoint": ~(inside | edge),
        "Touches": edge,
        "Contains": inside,
        "Covers": rect.covers_point(x, y),
    }
    if mode in named:
        return named[mode]
    if mode in MODES:
        return F.lit(False)
    return matrix_matches(point_matrix(rect, x, y), transposed(mode), boundary_a=False)


def point_matrix(rect: Rect, x: Column, y: Column) -> Column:
    """DE-9IM of a point (rows) against a rectangle (columns); a point has no boundary."""
    return F.when(rect.contains_point(x, y), "0FFFFF212").when(rect.touches_point(x, y), "F0FFFF212").otherwise("FF0FFF212")


def matrix_matches(matrix: Column, pattern: str, boundary_a: bool = True) -> Column:
    """Pattern of 0 1 2 F T *; a geometry without boundary leaves its row free."""
    cells_ = ["*" if not boundary_a and k // 3 == 1 else c for k, c in enumerate(pattern)]
    return matrix.rlike("^" + "".join({"T": "[012]", "*": "."}.get(c, c) for c in cells_) + "$")


def rect_relation(rect: Rect, other: Rect, mode: str) -> Column:
    """The query rectangle against a feature that is its box."""
    mode = checked(mode)
    named = {
        "BBoxIntersects": rect.intersects(other),
        "Intersects": rect.intersects(other),
        "Disjoint": rect.disjoint(other),
        "Touches": rect.touches(other),
        "Contains": rect.contains(other),
        "Covers": rect.covers(other),
        "Within": other.contains(rect),
        "CoveredBy": other.covers(rect),
        "Overlaps": rect.overlaps(other) & ~rect.covers(other) & ~other.covers(rect),
        "Equals": rect.equals(other),
        "Crosses": F.lit(False),
    }
    return named[mode] if mode in named else matrix_matches(rect_matrix(rect, other), mode)


def rect_matrix(a: Rect, b: Rect) -> Column:
    """DE-9IM of two rectangles with an area, as a Column."""
    cell = lambda c, d: F.when(c, F.lit(str(d))).otherwise("F")
    overlap, meet = a.overlaps(b), a.intersects(b)
    a_in_b, b_in_a = b.covers(a), a.covers(b)
    # Borders share a stretch if two sides lie on one line and overlap along it.
    along_x = (F.least(a.maxx, b.maxx) > F.greatest(a.minx, b.minx)) & ((a.miny == b.miny) | (a.miny == b.maxy) | (a.maxy == b.miny) | (a.maxy == b.maxy))
    along_y = (F.least(a.maxy, b.maxy) > F.greatest(a.miny, b.miny)) & ((a.minx == b.minx) | (a.minx == b.maxx) | (a.maxx == b.minx) | (a.maxx == b.maxx))
    stretch = meet & (along_x | along_y)
    borders = meet & ~a.contains(b) & ~b.contains(a)
    same = a_in_b & b_in_a
    return F.concat(
        cell(overlap, 2), cell(overlap & ~a_in_b, 1), cell(~a_in_b, 2), cell(overlap & ~b_in_a, 1),
        F.when(stretch, F.lit("1")).otherwise(cell(borders, 0)), cell(~a_in_b, 1), cell(~b_in_a, 2), cell(~b_in_a & ~same, 1), F.lit("2"),
    )


def spatial_test(columns: list[str], q: QueryDef) -> Column:
    """The exact test of a query for a table with these columns: geometry (gtype, parts), points (x, y) or boxes."""
    mode = checked(q.mode)
    geometries = "parts" in columns and "gtype" in columns
    if q.shape is not None:
        if mode == "BBoxIntersects" and not ("x" in columns and "minx" not in columns):
            return Rect.lit(*q.bounds()).intersects(Rect.of())
        if geometries:
            gtype, parts = F.col("gtype"), F.col("parts")
        elif "minx" in columns:
            gtype, parts = F.lit(POLYGON), rect_parts(Rect.of())
        else:
            gtype, parts = F.lit(POINT), point_parts(F.col("x"), F.col("y"))
        return relates(gtype, parts, q.shape, mode)
    rect = Rect.lit(*q.box)
    if "x" in columns and "minx" not in columns:
        return point_relation(rect, F.col("x"), F.col("y"), mode)
    # A feature in the rectangle is so if its box is; an area crosses nothing that it can be asked for here.
    if not geometries or mode in ("BBoxIntersects", "Contains", "Covers", "Crosses"):
        return rect_relation(rect, Rect.of(), mode)
    return relates(F.col("gtype"), F.col("parts"), rect_shape(q.box), mode)


def query(df: DataFrame, q: QueryDef, *, index: str | None = None, extent=None, level: int = 0, code: str = "code") -> DataFrame:
    """Filter, then project. With an index the cell codes of the box are added as a filter of their own, which prunes
    partitions and row groups, and boxes are compared before geometries; a query that features apart from it may fit is pruned by neither.
    Points have columns x and y, others a box, and exact geometry where there are gtype and parts."""
    points = "x" in df.columns and "minx" not in df.columns
    geometry = ["x", "y"] if points else [c for c in (*BBOX, "gtype", "parts") if c in df.columns]
    out = attributes.where(df, q.where)
    bounds = q.bounds()
    if bounds is not None:
        near = not may_be_apart(q.mode)
        if index and near:
            ranges = cells.xzorder_ranges(bounds, extent, level) if index == "xzorder" else cells.zorder_ranges(bounds, extent, level)
            out = out.where(cells.in_ranges(F.col(code), ranges))
        if near:
            rect = Rect.lit(*bounds)
            # Wider by the tolerance of the test itself.
            wide = rect.extend(1e-9)
            out = out.where(wide.contains_point(F.col("x"), F.col("y")) if points else rect.intersects(Rect.of()))
        out = out.where(spatial_test(df.columns, q))
    if q.fields is None:
        return out
    return out.select(*dict.fromkeys(["fid", *geometry, *q.fields]))


def page(df: DataFrame, after: int, size: int) -> DataFrame:
    """Keyset page: the first rows with an id over the last seen one."""
    return df.where(F.col("fid") > after).orderBy("fid").limit(size)
