"""Shapefiles as a Python data source: one partition for each run of records.

    spark.dataSource.register(ShapefileSource)
    spark.read.format("strata_shp").load(path)

Columns: fid (record number from 0), gtype, parts, minx, miny, maxx, maxy and
the attributes. Numbers without decimals become bigint, others double; dates
are read as yyyyMMdd. The path must be readable on every worker.

Options: ``records`` (of a partition), ``encoding``, ``only`` ("box": fid and box alone, from the first bytes of each record),
``ids`` (record numbers, with commas: neighbours are read together).

``read_folder`` reads all shapefiles below a folder of any file system that Spark reaches, a file a task, as whole binaries.
"""

from __future__ import annotations

import datetime
import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.codec import PARTS_TYPE, POINT, POLYGON, POLYLINE

#: Shape types of the file format that are read (fixed values).
TYPES = {1: POINT, 3: POLYLINE, 5: POLYGON}
RECORDS = 50_000
_HEAD = f"fid bigint, gtype int, parts {PARTS_TYPE}, minx double, miny double, maxx double, maxy double"


def decode(record: bytes):
    """(gtype, parts, box) of a record's content; None for a null shape."""
    (kind,) = struct.unpack_from("<i", record)
    if kind not in TYPES:
        return None
    if kind == 1:
        x, y = struct.unpack_from("<2d", record, 4)
        return POINT, [[[(x, y)]]], (x, y, x, y)
    box = struct.unpack_from("<4d", record, 4)
    n, m = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n}i", record, 44), m]
    flat = struct.unpack_from(f"<{2 * m}d", record, 44 + 4 * n)
    points = list(zip(flat[::2], flat[1::2], strict=True))
    rings = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return TYPES[kind], _islands(rings) if kind == 5 else [[r] for r in rings], box


def _area(ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def _inside(p, ring) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def _islands(rings: list) -> list[list]:
    """Parts of a shell and its holes: shells run clockwise, holes the other way and belong to the smallest shell around them. A hole in no shell is a part of its own."""
    shells = [[r] for r in rings if _area(r) <= 0]
    for hole in (r for r in rings if _area(r) > 0):
        around = [s for s in shells if _area(s[0]) <= 0 and _inside(hole[0], s[0])]
        if around:
            min(around, key=lambda s: -_area(s[0])).append(hole)
        else:
            shells.append([hole])
    return shells


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(rows, header bytes, row bytes, fields as (name, type, length, decimals))."""
    with open(path, "rb") as f:
        head = f.read(32)
        rows, start, size = struct.unpack_from("<IHH", head, 4)
        fields = []
        while (raw := f.read(32))[:1] not in (b"\r", b""):
            fields.append((raw[:11].split(b"\0")[0].decode("ascii", "replace"), chr(raw[11]), raw[16], raw[17]))
    return rows, start, size, fields


def _kind(t: str, decimals: int) -> str:
    return {"C": "string", "L": "boolean", "D": "date", "N": "double" if decimals else "bigint", "F": "double"}.get(t, "string")


def cast(raw: str, kind: str):
    raw = raw.strip()
    if kind == "string":
        return raw
    if kind == "boolean":
        return raw in ("Y", "y", "T", "t") if raw and raw != "?" else None
    try:
        return {"bigint": int, "double": float, "date": lambda v: datetime.datetime.strptime(v, "%Y%m%d").date()}[kind](raw)
    except ValueError:
        return None


def decode_box(head: bytes):
    """The box in the first 36 bytes of a record's content; None for a null shape."""
    (kind,) = struct.unpack_from("<i", head)
    if kind not in TYPES:
        return None
    if kind == 1:
        x, y = struct.unpack_from("<2d", head, 4)
        return x, y, x, y
    return struct.unpack_from("<4d", head, 4)


def runs_of(ids: list[int], most: int) -> list[tuple[int, int]]:
    """(first, count) of neighbouring record numbers."""
    out: list[tuple[int, int]] = []
    for i in sorted(set(ids)):
        if out and i == sum(out[-1]) and out[-1][1] < most:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((i, 1))
    return out


class _Run(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, size: int, only: str = "", ids: list[int] | None = None):
        self.path, self.encoding, self.size, self.only, self.ids = path, encoding, size, only, ids

    def partitions(self):
        n = (os.path.getsize(self.path[:-4] + ".shx") - 100) // 8
        if self.ids is not None:
            return [_Run(a, k) for a, k in runs_of([i for i in self.ids if 0 <= i < n], self.size)] or [_Run(0, 0)]
        return [_Run(i, min(self.size, n - i)) for i in range(0, n, self.size)] or [_Run(0, 0)]

    def read(self, run: _Run):
        if self.only == "box":
            yield from self._boxes(run)
            return
        dbf = self.path[:-4] + ".dbf"
        rows, start, size, fields = dbf_fields(dbf) if os.path.exists(dbf) else (0, 0, 0, [])
        with open(self.path[:-4] + ".shx", "rb") as shx, open(self.path, "rb") as shp:
            shx.seek(100 + 8 * run.first)
            index = struct.unpack(f">{2 * run.count}i", shx.read(8 * run.count))
            table = open(dbf, "rb") if fields else None
            try:
                if table:
                    table.seek(start + size * run.first)
                for k in range(run.count):
                    shp.seek(index[2 * k] * 2 + 8)
                    found = decode(shp.read(index[2 * k + 1] * 2))
                    values = []
                    if table:
                        row, at = table.read(size), 1
                        for _, t, n, d in fields:
                            values.append(cast(row[at : at + n].decode(self.encoding, "replace"), _kind(t, d)))
                            at += n
                    gtype, parts, box = found or (None, None, (None,) * 4)
                    yield (run.first + k, gtype, parts and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts], *box, *values)
            finally:
                if table:
                    table.close()


    def _boxes(self, run: _Run):
        with open(self.path[:-4] + ".shx", "rb") as shx, open(self.path, "rb") as shp:
            shx.seek(100 + 8 * run.first)
            index = struct.unpack(f">{2 * run.count}i", shx.read(8 * run.count))
            for k in range(run.count):
                shp.seek(index[2 * k] * 2 + 8)
                yield (run.first + k, *(decode_box(shp.read(min(36, index[2 * k + 1] * 2))) or (None,) * 4))


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata_shp"

    def schema(self) -> str:
        if self.options.get("only") == "box":
            return "fid bigint, minx double, miny double, maxx double, maxy double"
        dbf = self.options["path"][:-4] + ".dbf"
        fields = dbf_fields(dbf)[3] if os.path.exists(dbf) else []
        return ", ".join([_HEAD, *(f"`{n}` {_kind(t, d)}" for n, t, _, d in fields)])

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], self.options.get("encoding", "utf-8"), int(self.options.get("records", RECORDS)), self.options.get("only", ""), self._ids())

    def _ids(self) -> list[int] | None:
        ids = self.options.get("ids")
        return None if ids is None else [int(i) for i in ids.split(",") if i.strip()]


def records_of(shp: bytes, shx: bytes):
    """(number, gtype, parts, box) of each record of a file held whole."""
    for k in range((len(shx) - 100) // 8):
        at, n = struct.unpack_from(">2i", shx, 100 + 8 * k)
        yield (k, *(decode(shp[2 * at + 8 : 2 * at + 8 + 2 * n]) or (None, None, (None,) * 4)))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file, fid, gtype, parts, box) of all shapefiles below a folder; .shp and .shx of one name meet in one task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[sS][hH][pPxX]").load(folder)
    found = found.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("file"), F.lower(F.right("path", F.lit(3))).alias("kind"), "content")

    def decode_file(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(held["kind"], held["content"], strict=True))
        rows = []
        if {"shp", "shx"} <= set(by):
            for k, gtype, parts, box in records_of(bytes(by["shp"]), bytes(by["shx"])):
                rows.append((key[0], k, gtype, parts and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts], *box))
        out = pd.DataFrame(rows, columns=["file", "fid", "gtype", "parts", "minx", "miny", "maxx", "maxy"])
        return out.astype({"gtype": "Int32"})

    return found.groupBy("file").applyInPandas(decode_file, f"file string, {_HEAD}")
