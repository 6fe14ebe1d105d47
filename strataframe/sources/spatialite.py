"""SQLite feature tables (pk, geom as a SpatiaLite blob, attributes) as a Python data source, and a catalogue of stores.

    spark.dataSource.register(SpatialiteSource)
    spark.read.format("strata_sqlite").option("table", "cities").load(path)

Partitions are runs of the row id. The path must be readable on every worker.
"""

from __future__ import annotations

import sqlite3
import struct
from contextlib import closing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import cells
from ..functions.codec import PARTS_TYPE, POINT, POLYGON, POLYLINE, from_gaia, to_gaia

RESERVED = ("pk", "smid", "geom", "g_index_code")
ROWS = 50_000
_TYPES = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}


#: Type codes of the catalogue and of blobs by geometry: points, lines, polygons, plain and multiple (fixed values).
TYPE_CODES = {1: 1, 4: 1, 2: 5, 5: 5, 3: 3, 6: 3}


def geometry_type(code: Column) -> Column:
    """Geometry type of a stored type code; null for others."""
    out = F.lit(None).cast("int")
    for stored, gtype in TYPE_CODES.items():
        out = F.when(code == stored, gtype).otherwise(out)
    return out


def _fields(path: str, table: str) -> tuple[str, list[tuple[str, str]]]:
    with closing(sqlite3.connect(path)) as c:
        info = c.execute(f'pragma table_info("{table}")').fetchall()
    if not info:
        raise ValueError(f"no table {table}")
    key = next((r[1] for r in info if r[1].lower() in ("pk", "smid")), "rowid")
    return key, [(r[1], _TYPES.get(r[2].upper(), "string")) for r in info if r[1].lower() not in RESERVED]


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SpatialiteReader(DataSourceReader):
    def __init__(self, path: str, table: str, size: int):
        self.path, self.table, self.size = path, table, size
        self.key, self.fields = _fields(path, table)

    def partitions(self):
        with closing(sqlite3.connect(self.path)) as c:
            lo, hi = c.execute(f'select min("{self.key}"), max("{self.key}") from "{self.table}"').fetchone()
        return [] if lo is None else [_Rows(i, i + self.size) for i in range(lo, hi + 1, self.size)]

    def read(self, rows: _Rows):
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        sql = f'select "{self.key}", geom{", " + names if names else ""} from "{self.table}" where "{self.key}" >= ? and "{self.key}" < ?'
        with closing(sqlite3.connect(self.path)) as c:
            for fid, blob, *values in c.execute(sql, (rows.lo, rows.hi)):
                gtype, parts, srid, box = from_gaia(blob) if blob is not None else (None, None, None, (None,) * 4)
                parts = parts and [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]
                yield (fid, gtype, parts, srid, *box, *values)


class SpatialiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata_sqlite"

    def schema(self) -> str:
        head = f"fid bigint, gtype int, parts {PARTS_TYPE}, srid int, minx double, miny double, maxx double, maxy double"
        return ", ".join([head, *(f"`{n}` {t}" for n, t in _fields(self.options["path"], self.options["table"])[1])])

    def reader(self, schema: StructType) -> SpatialiteReader:
        return SpatialiteReader(self.options["path"], self.options["table"], int(self.options.get("rows", ROWS)))


#: The catalogue's tables and columns (fixed values).
CATALOG = {
    "geometry_columns": "f_table_name varchar not null, f_geometry_column varchar, geometry_type integer, srid integer, g_index_level integer, g_index_type varchar",
    "geometry_columns_statistics": "f_table_name varchar not null, f_geometry_column varchar, row_count integer, extent_min_x real, extent_min_y real, extent_max_x real, extent_max_y real",
    "geometry_columns_field_infos": "f_table_name varchar not null, f_geometry_column varchar, ordinal integer, column_name varchar",
    "spatial_ref_sys": "srid integer primary key, ref_sys_name varchar, proj4text varchar, srtext varchar",
}
_STORED = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER", "binary": "BLOB"}


class SqliteStore:
    """A SQLite file with its catalogue, for tables of one machine's size; reading them is distributed by the data source above."""

    def __init__(self, path: str):
        from ..functions.crs import SYSTEMS

        self.path = path
        with closing(sqlite3.connect(path)) as c, c:
            for name, columns in CATALOG.items():
                c.execute(f"create table if not exists {name} ({columns})")
            c.executemany("insert or ignore into spatial_ref_sys values (?, ?, ?, '')", [(k, *v) for k, v in SYSTEMS.items()])

    def tables(self) -> list[dict]:
        """Name, geometry type, srid, index level and kind of each table."""
        with closing(sqlite3.connect(self.path)) as c:
            rows = c.execute("select f_table_name, geometry_type, srid, g_index_level, g_index_type from geometry_columns order by 1").fetchall()
        return [{"name": n, "gtype": TYPE_CODES.get(g), "srid": s, "level": lv, "index": k} for n, g, s, lv, k in rows]

    def create(self, name: str, gtype: int, fields: list[tuple[str, str]], srid: int = 4326, index: str = "xzorder") -> str:
        """A new table with catalogue rows and an index on its codes; gives its name, changed where it was taken. Reserved columns are left out."""
        from ..functions.paths import free_name

        name = free_name(name, [t["name"] for t in self.tables()])
        fields = [(n, t) for n, t in fields if n.lower() not in RESERVED]
        code = {POINT: 1, POLYLINE: 5, POLYGON: 6}[gtype]
        with closing(sqlite3.connect(self.path)) as c, c:
            columns = "".join(f', "{n}" {_STORED.get(t, "VARCHAR")}' for n, t in fields)
            c.execute(f'create table "{name}" (pk integer primary key autoincrement, geom blob, g_index_code integer{columns})')
            c.execute(f'create index "g_index_code_{name}" on "{name}" (g_index_code)')
            c.execute("insert into geometry_columns values (?, 'geom', ?, ?, -1, ?)", (name, code, srid, index))
            c.execute("insert into geometry_columns_statistics values (?, 'geom', 0, null, null, null, null)", (name,))
            infos = ["pk", "geom", "g_index_code", *(n for n, _ in fields)]
            c.executemany("insert into geometry_columns_field_infos values (?, 'geom', ?, ?)", [(name, k, n) for k, n in enumerate(infos)])
        return name

    def write(self, name: str, rows) -> int:
        """Adds (fid, gtype, parts, *values) rows in one transaction, then brings statistics, level and codes up to date."""
        srid = next(t["srid"] for t in self.tables() if t["name"] == name)
        _, fields = _fields(self.path, name)
        n = 0
        with closing(sqlite3.connect(self.path)) as c, c:
            sql = f'insert into "{name}" (pk, geom{"".join(f", {chr(34)}{f}{chr(34)}" for f, _ in fields)}) values ({", ".join("?" * (2 + len(fields)))})'
            for fid, gtype, parts, *values in rows:
                c.execute(sql, (fid, to_gaia(gtype, parts, srid) if parts else None, *values))
                n += 1
        self.compute(name)
        return n

    def statistics(self, name: str) -> tuple[int, tuple[float, float, float, float] | None]:
        """(count, extent) as stored, computed and written back where they are missing."""
        with closing(sqlite3.connect(self.path)) as c:
            r = c.execute("select row_count, extent_min_x, extent_min_y, extent_max_x, extent_max_y from geometry_columns_statistics where f_table_name = ?", (name,)).fetchone()
        if r is None or r[0] is None or (r[0] and None in r[1:]):
            return self.compute(name)
        return r[0], None if None in r[1:] else tuple(r[1:])

    def compute(self, name: str) -> tuple[int, tuple[float, float, float, float] | None]:
        """Count and extent from the rows; the index level from the count, and each row's code at that level."""
        index = next((t["index"] for t in self.tables() if t["name"] == name), "xzorder")
        with closing(sqlite3.connect(self.path)) as c, c:
            boxes = [(pk, struct.unpack_from("<4d" if bytes(g[1:2]) == b"\x01" else ">4d", g, 6)) for pk, g in c.execute(f'select pk, geom from "{name}" where geom is not null')]
            n = c.execute(f'select count(*) from "{name}"').fetchone()[0]
            extent = (min(b[0] for _, b in boxes), min(b[1] for _, b in boxes), max(b[2] for _, b in boxes), max(b[3] for _, b in boxes)) if boxes else None
            level = cells.zorder_level(n)
            if extent:
                code = cells.plain_zorder_code if index == "zorder" else cells.plain_xzorder_code
                c.executemany(f'update "{name}" set g_index_code = ? where pk = ?', [(code(b, extent, level), pk) for pk, b in boxes])
            c.execute("update geometry_columns set g_index_level = ? where f_table_name = ?", (level, name))
            if not c.execute("update geometry_columns_statistics set row_count = ?, extent_min_x = ?, extent_min_y = ?, extent_max_x = ?, extent_max_y = ? where f_table_name = ?", (n, *(extent or (None,) * 4), name)).rowcount:
                c.execute("insert into geometry_columns_statistics values (?, 'geom', ?, ?, ?, ?, ?)", (name, n, *(extent or (None,) * 4)))
        return n, extent

    def column_exists(self, name: str, column: str) -> bool:
        with closing(sqlite3.connect(self.path)) as c:
            return any(r[1].lower() == column.lower() for r in c.execute(f'pragma table_info("{name}")'))

    def add_column(self, name: str, column: str, kind: str) -> None:
        if not self.column_exists(name, column):
            with closing(sqlite3.connect(self.path)) as c, c:
                c.execute(f'alter table "{name}" add column "{column}" {_STORED.get(kind, "VARCHAR")}')

    def add_index(self, name: str, column: str) -> None:
        with closing(sqlite3.connect(self.path)) as c, c:
            c.execute(f'create index if not exists "{column}_{name}" on "{name}" ("{column}")')

    def delete(self, name: str) -> bool:
        """The table and its rows in the catalogue."""
        if name not in [t["name"] for t in self.tables()]:
            return False
        with closing(sqlite3.connect(self.path)) as c, c:
            for t in CATALOG:
                if t != "spatial_ref_sys":
                    c.execute(f"delete from {t} where f_table_name = ?", (name,))
            c.execute(f'drop table "{name}"')
        return True


def write_table(rows, path: str, table: str, fields: list[tuple[str, str]], srid: int = 4326) -> int:
    """Writes (fid, gtype, parts, *values) rows to a new table of a store. For small results."""
    rows = list(rows)
    store = SqliteStore(path)
    gtype = next((r[1] for r in rows if r[1]), POINT)
    return store.write(store.create(table, gtype, fields, srid), rows)


class Store:
    """Named feature tables under a folder, as Parquet partitioned by cell code where they have one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, df: DataFrame, mode: str = "errorifexists") -> None:
        """Rows of a code lie together and sorted by id, so that scans prune by code and skip by box."""
        w = df
        if "code" in df.columns:
            w = df.repartition("code").sortWithinPartitions("code", "fid")
            w.write.mode(mode).partitionBy("code").parquet(f"{self.root}/{name.lower()}")
        else:
            w.write.mode(mode).parquet(f"{self.root}/{name.lower()}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name.lower()}")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name.lower()}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        path, fs = self._path()
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def drop(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.delete(path, True)


def convert(source: DataFrame, store: Store, name: str, partitions: int | None = None) -> None:
    """Copies any feature table into a store."""
    store.write(name, source.coalesce(partitions) if partitions else source)
