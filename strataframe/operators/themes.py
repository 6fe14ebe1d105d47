"""Thematic classes, colours and raster catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import geohash
from ..functions.rect import Rect


def equal_ranges(value: Column, count: int, classes: int = 10) -> tuple[Column, Column]:
    """(class, "low-high") of a value in [0, count) cut into equal intervals."""
    k = F.least(F.lit(classes - 1), F.floor(value * classes / F.lit(count))).cast("int")
    step = F.lit(count / classes)
    label = F.concat_ws("-", F.floor(k * step).cast("bigint").cast("string"), F.floor((k + 1) * step).cast("bigint").cast("string"))
    return k, label


def color_hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0")) for c in (r, g, b, a)))


def ramp(value: Column, low: Column, high: Column, start: tuple[int, ...], end: tuple[int, ...]) -> tuple[Column, ...]:
    """Channel values between two colours; the start colour where the range is empty."""
    t = F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))
    return tuple(F.floor(F.lit(s) + t * (e - s)).cast("int") for s, e in zip(start, end, strict=True))


def grid_counts(points: DataFrame, precision: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Count and tight bounds for each geohash cell with points."""
    if box is not None:
        points = points.where(Rect.lit(*box).contains_point(F.col("x"), F.col("y")) | Rect.lit(*box).touches_point(F.col("x"), F.col("y")))
    return points.groupBy(geohash(F.col("x"), F.col("y"), precision).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy")
    )


def raster_level(catalog: DataFrame, resolution: float) -> int | None:
    """Coarsest level that is still finer than asked for, else the finest level there is."""
    levels = catalog.groupBy("lvl").agg(F.max("res").alias("res")).collect()
    fine = [r for r in levels if r["res"] < resolution]
    best = max(fine, key=lambda r: r["res"]) if fine else min(levels, key=lambda r: r["res"], default=None)
    return best["lvl"] if best else None


def raster_pick(catalog: DataFrame, box: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Rasters of the chosen level that share an area with the view."""
    lvl = raster_level(catalog, min((box[2] - box[0]) / width, (box[3] - box[1]) / height))
    return catalog.where(F.col("lvl") == F.lit(lvl)).where(Rect.of().overlaps(Rect.lit(*box)))


def raster_window(box: tuple[float, float, float, float], pixels: int = 1024) -> tuple[Column, Column, Column, Column]:
    """Source window (x, y, width, height in pixels) of the part of a raster that a view shows."""
    r, v = Rect.of(), Rect.lit(*box)
    part = r.intersection(v)
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    sx, sy = F.lit(float(pixels)) / r.width(), F.lit(float(pixels)) / r.height()
    return half_up((part.minx - r.minx) * sx), half_up((r.maxy - part.maxy) * sy), half_up(part.width() * sx), half_up(part.height() * sy)


def overview_factors(size: Column, least: int = 256) -> Column:
    """2, 4, 8 ... while the overview is larger than ``least``."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.filter(powers, lambda f: size / f > least)


def alpha_mask(r: Column, g: Column, b: Column) -> Column:
    return F.when(r + g + b == 0, 0).otherwise(255)
