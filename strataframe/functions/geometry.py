"""Functions of the nested geometry array: parts[island or line][ring][vertex] with x and y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: gtype numbers (fixed values).
POINT, POLYGON, POLYLINE = 1, 3, 5
PARTS = "array<array<array<struct<x:double,y:double>>>>"


def vertices(parts: Column) -> Column:
    return F.flatten(F.flatten(parts))


def bounds(parts: Column) -> Column:
    """Struct of the least and largest coordinates; for polygons of the shells, which hold the holes."""
    xs, ys = F.transform(vertices(parts), lambda p: p["x"]), F.transform(vertices(parts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def point_count(parts: Column) -> Column:
    return F.size(vertices(parts))


def sub_count(parts: Column) -> Column:
    return F.size(parts)


def dimension(gtype: Column) -> Column:
    return F.when(gtype == POINT, 0).when(gtype == POLYLINE, 1).when(gtype == POLYGON, 2)


def boundary_dimension(gtype: Column) -> Column:
    """-1 for points, 0 for lines (their ends), 1 for polygons."""
    return F.when(gtype == POINT, -1).when(gtype == POLYLINE, 0).when(gtype == POLYGON, 1)


def point_parts(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(F.struct(x.alias("x"), y.alias("y")))))


def rect_parts(rect) -> Column:
    return F.array(F.array(rect.corners(closed=True)))


def map_points(parts: Column, f) -> Column:
    """Applies f(x, y) -> (x, y) to each vertex."""

    def one(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda a: F.transform(a, lambda r: F.transform(r, one)))


def with_bounds(df: DataFrame) -> DataFrame:
    """df(fid, gtype, parts, ...) with its box as minx, miny, maxx, maxy."""
    return df.withColumn("_b", bounds(F.col("parts"))).select(*df.columns, "_b.minx", "_b.miny", "_b.maxx", "_b.maxy")


def from_vertices(df: DataFrame, gtype: int, keys: tuple[str, ...] = ("fid",)) -> DataFrame:
    """One row a feature from one row a vertex (seq, x, y): a single line or ring."""
    line = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return df.groupBy(*keys).agg(F.array(F.array(line)).alias("parts")).withColumn("gtype", F.lit(gtype))


def segments(df: DataFrame) -> DataFrame:
    """Neighbouring vertices (fid, seq, x, y) of a line or ring as (fid, seq, x1, y1, x2, y2)."""
    w = Window.partitionBy("fid").orderBy("seq")
    out = df.select("fid", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where("x2 is not null")


def explode_vertices(df: DataFrame) -> DataFrame:
    """One row a vertex; attributes are left behind."""
    return df.select("fid", F.posexplode(vertices(F.col("parts"))).alias("seq", "p")).select("fid", "seq", "p.x", "p.y")


# --- thinning: plain functions, used in Arrow batches -------------------------------


def _turn(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float]) -> tuple[float, float]:
    """(cross, dot) of the two sides seen from b: the angle at b is 180 degrees where cross is 0 and dot negative."""
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    return (ax - bx) * (cy - by) - (ay - by) * (cx - bx), (ax - bx) * (cx - bx) + (ay - by) * (cy - by)


def thin_line(points: list[tuple[float, float]], dis2: float, max_angle: float = 180.0) -> list[tuple[float, float]]:
    """Keeps a vertex that is farther than sqrt(dis2) from the last kept one, or at which the line has an angle of less than max_angle degrees."""
    if len(points) <= 2:
        return list(points)
    out = [points[0]]
    for p, after in zip(points[1:-1], points[2:], strict=True):
        far = (p[0] - out[-1][0]) ** 2 + (p[1] - out[-1][1]) ** 2 > dis2
        cross, dot = _turn(out[-1], p, after)
        if far or ((cross or dot) and math.degrees(math.atan2(abs(cross), dot)) < max_angle):
            out.append(p)
    out.append(points[-1])
    return out


def slim_line(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Drops vertices at which the line goes straight on, and repeated ones; the tip of a spike stays."""
    out = list(points[:1])
    for p, after in zip(points[1:-1], points[2:], strict=True):
        cross, dot = _turn(out[-1], p, after)
        if cross != 0 or dot > 0:
            out.append(p)
    return out + list(points[-1:] if len(points) > 1 else [])


def thin_ring(points: list[tuple[float, float]], dis2: float, max_angle: float = 180.0) -> list[tuple[float, float]]:
    """Thinned and closed; empty if fewer than three different vertices are left."""
    out = thin_line(points, dis2, max_angle)
    if out and out[0] != out[-1]:
        out.append(out[0])
    return out if len(out) > 3 else []
