"""Catalogues as JSON and text: maps of layers, lists of services, mosaics of rasters, folders of shapefiles and images.

Paths inside a catalogue are relative to it, so a folder can be moved as a whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.paths import absolute_path, relative_path
from . import files

#: Folder of a mosaic's overviews, which is no source of rasters (fixed value).
THUMBNAILS = "Thumbnails"


@dataclass
class Layer:
    """A named table in a store, with the name of its theme and what the theme is given."""

    name: str
    path: str
    theme: str = "simple"
    options: dict = field(default_factory=dict)


@dataclass
class MapDocument:
    name: str
    epsg: int = 4326
    layers: list[Layer] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        held = asdict(self)
        for layer in held["layers"]:
            layer["path"] = relative_path(path, layer["path"])
        files.put(spark, path, json.dumps(held, indent=3).encode())

    @staticmethod
    def open(spark: SparkSession, path: str) -> MapDocument:
        held = json.loads(files.get(spark, path))
        layers = [Layer(**(x | {"path": absolute_path(path, x["path"])})) for x in held.get("layers", [])]
        return MapDocument(held["name"], held.get("epsg", 4326), layers)


def save_services(spark: SparkSession, path: str, maps: list[str]) -> None:
    files.put(spark, path, "".join(relative_path(path, m) + "\n" for m in maps).encode())


def open_services(spark: SparkSession, path: str) -> list[str]:
    """Paths of the maps in a service list; empty lines and lines that start with // are left out."""
    lines = (x.strip() for x in files.get(spark, path).decode().splitlines())
    return [absolute_path(path, x) for x in lines if x and not x.startswith("//")]


def shapefiles(spark: SparkSession, folder: str) -> list[str]:
    return files.listing(spark, folder, "*.shp")


def rasters(spark: SparkSession, folder: str) -> list[str]:
    return files.listing(spark, folder, "*.tif", "*.tiff", skip=(THUMBNAILS,))


#: Keys of a mosaic catalogue: Bbox, Namess and Bboxess by level and file, Ress by level; boxes as Min and Max with X and Y (fixed values of the format).
def mosaic_rows(text: str, path: str) -> list[tuple[int, str, float, float, float, float, float]]:
    """(level, file, box, resolution) of a mosaic catalogue's JSON."""
    held = json.loads(text)
    out = []
    for level, (names, boxes, res) in enumerate(zip(held["Namess"], held["Bboxess"], held["Ress"], strict=True)):
        for name, b in zip(names, boxes, strict=True):
            out.append((level, absolute_path(path, name), b["Min"]["X"], b["Min"]["Y"], b["Max"]["X"], b["Max"]["Y"], res))
    return out


MOSAIC = "lvl int, file string, minx double, miny double, maxx double, maxy double, res double"


def open_mosaic(spark: SparkSession, path: str) -> DataFrame:
    """The rasters of a mosaic: lvl, file, box, res. A text list has a path a line and nothing else."""
    text = files.get(spark, path).decode()
    if path.endswith(".gmr"):
        return spark.createDataFrame(mosaic_rows(text, path), MOSAIC)
    names = [x.strip() for x in text.splitlines() if x.strip()]
    return spark.createDataFrame([(0, absolute_path(path, n), None, None, None, None, None) for n in names], MOSAIC)


def save_mosaic(catalog: DataFrame, path: str) -> None:
    """Writes a catalogue of rasters, which is small beside them, as JSON with relative paths; levels are numbered from 0."""
    rows = catalog.select("lvl", "file", "minx", "miny", "maxx", "maxy", "res").collect()
    levels = sorted({r["lvl"] for r in rows})
    of = {v: sorted((r for r in rows if r["lvl"] == v), key=lambda r: r["file"]) for v in levels}
    box = lambda rs: {"Min": {"X": min(r["minx"] for r in rs), "Y": min(r["miny"] for r in rs)}, "Max": {"X": max(r["maxx"] for r in rs), "Y": max(r["maxy"] for r in rs)}}
    held = {
        "Bbox": box(of[levels[0]]) if levels else None,
        "Namess": [[relative_path(path, r["file"]) for r in of[v]] for v in levels],
        "Bboxess": [[box([r]) for r in of[v]] for v in levels],
        "Ress": [max(r["res"] for r in of[v]) for v in levels],
    }
    files.put(catalog.sparkSession, path, json.dumps(held, indent=3).encode())


def raster_box(transform: tuple[float, float, float, float, float, float], width: int, height: int) -> tuple[float, float, float, float]:
    """Box of a raster from its geotransform (x of the left edge, x per column and row, y of the top edge, y per column and row)."""
    x0, dx, rx, y0, ry, dy = transform
    xs = [x0 + c * dx + r * rx for c in (0, width) for r in (0, height)]
    ys = [y0 + c * ry + r * dy for c in (0, width) for r in (0, height)]
    return min(xs), min(ys), max(xs), max(ys)
