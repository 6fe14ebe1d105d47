"""Stores with the semantics of a key-ordered table and of a document index, kept as Parquet.

``KeyStore``: features lie in the order of a key made of cell code and id, with a system table of extent, kind, level and count;
a box is read as ranges of codes. ``PointIndex``: documents of an id and a location, paged by id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.codec import parts_of_wkb, wkb_of
from ..functions.geometry import bounds
from ..functions.rect import Rect
from . import files


def row_key(code: Column, fid: Column) -> Column:
    """Twelve bytes, big-endian, so that bytes sort as (code, id) do."""
    return F.unhex(F.concat(F.lpad(F.hex(code.cast("bigint")), 8, "0"), F.lpad(F.hex(fid.cast("bigint")), 16, "0")))


class KeyStore:
    """Named feature tables under a folder."""

    SYSTEM = "_system"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        return sorted(p.rsplit("/", 1)[1][:-5] for p in files.listing(self.spark, f"{self.root}/{self.SYSTEM}", "*.json"))

    def info(self, name: str) -> dict:
        """bbox, gtype, index_level and count of a table."""
        return json.loads(files.get(self.spark, f"{self.root}/{self.SYSTEM}/{name}.json"))

    def _put_info(self, name: str, info: dict) -> None:
        files.put(self.spark, f"{self.root}/{self.SYSTEM}/{name}.json", json.dumps(info).encode())

    def create(self, name: str, gtype: int, extent: tuple[float, float, float, float], level: int) -> None:
        if name in self.names():
            raise ValueError(f"there is a table {name}")
        self._put_info(name, {"bbox": None, "gtype": gtype, "index_level": level, "index_extent": list(extent), "count": 0})

    def write(self, name: str, features: DataFrame) -> None:
        """Adds features (fid, gtype, parts) and carries count and extent on."""
        info = self.info(name)
        df = features.withColumn("_b", bounds(F.col("parts")))
        code = cells.xzorder_code(Rect(*(F.col(f"_b.{c}") for c in ("minx", "miny", "maxx", "maxy"))), tuple(info["index_extent"]), info["index_level"])
        df = df.select(code.alias("code"), F.col("fid").cast("bigint").alias("fid"), "gtype", wkb_of("gtype", "parts").alias("geom"), "_b.*")
        out = df.withColumn("rowkey", row_key(F.col("code"), F.col("fid"))).repartitionByRange("code", "fid").sortWithinPartitions("code", "fid")
        out.write.mode("append").parquet(f"{self.root}/{name}")
        # Told by what is stored, so that a write that was repeated counts once.
        t = self.spark.read.parquet(f"{self.root}/{name}")
        r = t.agg(F.count(F.lit(1)), F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
        self._put_info(name, info | {"count": r[0], "bbox": None if r[1] is None else list(r[1:])})

    def scan(self, name: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
        """(rowkey, fid, gtype, parts, box) of features whose box meets the query's, read by ranges of codes."""
        info = self.info(name)
        t = self.spark.read.parquet(f"{self.root}/{name}")
        if box is not None:
            runs = cells.xzorder_ranges(box, tuple(info["index_extent"]), info["index_level"])
            t = t.where(cells.in_ranges(F.col("code"), runs)).where(Rect.lit(*box).intersects(Rect.of()))
        return t.select("rowkey", "fid", "gtype", parts_of_wkb("geom").alias("parts"), "minx", "miny", "maxx", "maxy")

    def delete(self, name: str) -> bool:
        files.remove(self.spark, f"{self.root}/{name}")
        return files.remove(self.spark, f"{self.root}/{self.SYSTEM}/{name}.json")


class PointIndex:
    """Indices of documents (gid, location): points only."""

    #: Types of the fields (fixed values).
    MAPPING = {"properties": {"gid": {"type": "long"}, "location": {"type": "geo_point"}}}
    MOST = 10_000

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def names(self) -> list[str]:
        """Indices whose mapping has a point."""
        found = []
        for p in files.listing(self.spark, self.root, "mapping.json"):
            if any(f.get("type") == "geo_point" for f in json.loads(files.get(self.spark, p)).get("properties", {}).values()):
                found.append(p.rsplit("/", 2)[1])
        return sorted(found)

    def create(self, name: str) -> None:
        files.put(self.spark, f"{self.root}/{name}/mapping.json", json.dumps(self.MAPPING).encode())

    def write(self, name: str, points: DataFrame) -> None:
        """Adds points (fid, x, y)."""
        df = points.select(F.col("fid").cast("bigint").alias("gid"), F.struct(F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon")).alias("location"))
        df.repartitionByRange("gid").sortWithinPartitions("gid").write.mode("append").parquet(f"{self.root}/{name}/rows")

    def search(self, name: str, box: tuple[float, float, float, float], after: int | None = None, size: int = MOST) -> DataFrame:
        """A page of (gid, location) in the box, held to the world's bounds, in the order of ids after the last seen one."""
        a, b, c, d = max(box[0], -180.0), max(box[1], -90.0), min(box[2], 180.0), min(box[3], 90.0)
        t = self.spark.read.parquet(f"{self.root}/{name}/rows")
        t = t.where(F.col("location.lon").between(a, c) & F.col("location.lat").between(b, d))
        if after is not None:
            t = t.where(F.col("gid") > after)
        return t.orderBy("gid").limit(min(size, self.MOST))

    def delete(self, name: str) -> bool:
        return files.remove(self.spark, f"{self.root}/{name}")
