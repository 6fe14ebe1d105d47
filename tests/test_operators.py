"""Conditions, joins against brute force, sources, stores and a stream."""

import random

import pytest
from pyspark.sql import functions as F

from strataframe.operators import join, query, tiles
from strataframe.operators.where import where
from strataframe.plans.queries import sample_shapefile
from strataframe.sources.shapefile import ShapefileSource
from strataframe.sources.spatialite import SpatialiteSource, Store, convert, write_table


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, "Ann", 1.5, True), (2, "bob", 2.0, False), (3, "ANN", 2.5, True), (4, None, None, None)]
    return spark.createDataFrame(rows, "id int, o_name string, price double, ok boolean")


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("o_name = 'ann'", [1, 3]),
        ('o_name != "ann"', [2]),
        ("id > 1 or (price > 2)", [2, 3, 4]),
        ("id = 1 or id = 2 and price > 5", [1]),
        ("id >= 1 and id <= 3 and price > 1.6", [2, 3]),
        ("price = 2.0000000001", [2]),
        ("ok = true AND (id = 3 OR id = 1)", [1, 3]),
        ("id = nonsense", []),
        ("", [1, 2, 3, 4]),
    ],
)
def test_where(table, text, ids):
    assert sorted(r.id for r in where(table, text).collect()) == ids


@pytest.mark.parametrize("text", ["id >", "(id = 1", "nothing = 1", "o_name > 'a'", "id = 1 id = 2"])
def test_where_errors(table, text):
    with pytest.raises(ValueError):
        where(table, text)


def test_where_types(spark):
    df = spark.sql("select 1 as id, date '2020-01-02' as day_, timestamp '2020-01-02 03:04:05' as at, cast(1.50 as decimal(9,2)) as dec, cast('ab' as binary) as raw, array(1) as list union all select 2, null, null, null, null, null")
    ids = lambda text: [r.id for r in where(df, text).collect()]
    for text in ("day_ = '2020-01-02'", "day_ > 2019-12-31", "day_ > 'no date'", "at >= '2020-01-02 03:04:05'", "dec = 1.5", "dec > x", "raw = 'ab'", "raw != 'a'"):
        assert ids(text) == [1], text
    assert ids("day_ < '2020-01-02'") == []
    for text in ("raw > 'a'", "list = 1"):
        with pytest.raises(ValueError):
            where(df, text)


def test_slices_lose_nothing(spark):
    from strataframe.operators.batches import batch_size, slices

    got = slices(spark.range(4_000_000).select(((F.col("id") * 7919) % 4_000_037).alias("fid")), "fid", 7)
    counts = {r.slice: (r.n, r.lo, r.hi) for r in got.groupBy("slice").agg(F.count("fid").alias("n"), F.min("fid").alias("lo"), F.max("fid").alias("hi")).collect()}
    assert sum(n for n, *_ in counts.values()) == 4_000_000 and [counts[k][0] for k in range(6)] == [571_428] * 6
    assert all(counts[k][2] < counts[k + 1][1] for k in range(6))
    assert slices(spark.range(0).withColumnRenamed("id", "fid"), "fid", 7).count() == 0
    assert batch_size(1_000_000) == 8000 and batch_size(5) == 1000


def test_exact_queries(spark):
    from strataframe.functions.codec import PARTS_TYPE
    from strataframe.operators.relate import Shape

    line = lambda *pts: [[[{"x": float(x), "y": float(y)} for x, y in pts]]]
    rows = [
        (1, 5, line((0, 0), (10, 10)), 0.0, 0.0, 10.0, 10.0),  # its box meets the query's, it does not
        (2, 5, line((6, 1), (9, 3)), 6.0, 1.0, 9.0, 3.0),
        (3, 5, line((0, 3), (20, 3)), 0.0, 3.0, 20.0, 3.0),
        (4, 3, line((5, 0), (10, 0), (10, 4), (5, 4), (5, 0)), 5.0, 0.0, 10.0, 4.0),
        (5, 3, line((50, 50), (60, 50), (60, 60), (50, 50)), 50.0, 50.0, 60.0, 60.0),
    ]
    df = spark.createDataFrame(rows, f"fid bigint, gtype int, parts {PARTS_TYPE}, minx double, miny double, maxx double, maxy double")
    ids = lambda mode, **q: sorted(r.fid for r in query.query(df, query.QueryDef(mode=mode, **q)).collect())
    box = {"box": (5.0, 0.0, 10.0, 4.0)}
    assert ids("Intersects", **box) == [2, 3, 4] and ids("BBoxIntersects", **box) == [1, 2, 3, 4] and ids("Disjoint", **box) == [1, 5]
    assert ids("Contains", **box) == [2] and ids("Covers", **box) == [2, 4] and ids("Equals", **box) == [4] and ids("Crosses", **box) == []
    assert ids("1********", **box) == [2, 3] and ids("FF2FF1212", **box) == [5]
    triangle = {"shape": Shape(3, [[[(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 0.0)]]])}
    assert ids("Intersects", **triangle) == [1, 2, 3, 4] and ids("Contains", **triangle) == [2] and ids("Disjoint", **triangle) == [5]
    with pytest.raises(ValueError):
        ids("Nearby", **box)
    pairs = sorted(map(tuple, join.features_relate(df, df).where("a < b").collect()))
    assert pairs == [(1, 3), (2, 3), (2, 4), (3, 4)]


def test_boxes_of_all_sizes(spark):
    rnd = random.Random(9)
    bxs = []
    for i in range(300):
        x, y, w = rnd.uniform(-100, 100), rnd.uniform(-100, 100), 10 ** rnd.uniform(-4, 2.2)
        bxs.append((i, x, y, x + w, y + w * rnd.uniform(0, 1)))
    bxs += [(900, -200000.0, -1.0, 200000.0, 1.0), (901, 5.0, 5.0, 5.0, 5.0), (902, None, 1.0, 2.0, 3.0)]
    b = spark.createDataFrame(bxs, "fid bigint, minx double, miny double, maxx double, maxy double")
    got = sorted(map(tuple, join.boxes_meet(b, b).collect()))
    full = [x for x in bxs if x[1] is not None]
    assert got == sorted((u[0], v[0]) for u in full for v in full if u[1] <= v[3] and v[1] <= u[3] and u[2] <= v[4] and v[2] <= u[4])
    pts = [(i, rnd.uniform(-100, 100), rnd.uniform(-100, 100)) for i in range(200)] + [(500, 5.0, 5.0)]
    p = spark.createDataFrame(pts, "fid bigint, x double, y double")
    got = sorted(map(tuple, join.points_in_boxes(p, b).collect()))
    assert got == sorted((u[0], i) for u in full for i, x, y in pts if u[1] <= x <= u[3] and u[2] <= y <= u[4])
    assert join.points_in_boxes(p, b.limit(0)).count() == 0 and join.boxes_meet(b.limit(0), b.limit(0)).count() == 0


def test_shapefile_holes():
    import struct

    from strataframe.sources.shapefile import decode

    rings = [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)], [(20, 0), (20, 5), (25, 5), (25, 0), (20, 0)]]
    flat = [float(v) for r in rings for p in r for v in p]
    body = struct.pack("<i4d2i", 5, 0, 0, 25, 10, 3, 15) + struct.pack("<3i", 0, 5, 10) + struct.pack(f"<{len(flat)}d", *flat)
    gtype, parts, _ = decode(body)
    assert gtype == 3 and [len(p) for p in parts] == [2, 1]


def test_feature_tiles(spark):
    from strataframe.functions import geometry

    rows = [(1, s, float(x), float(y)) for s, (x, y) in enumerate([(-10, 10), (100, 10), (100, -20)])]
    f = geometry.with_bounds(geometry.from_vertices(spark.createDataFrame(rows, "fid bigint, seq int, x double, y double"), 5))
    got = {(r.col, r.row): len(r.data) for r in tiles.feature_tiles(f, 1).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1)} and min(got.values()) > 10


def test_joins_equal_brute_force(spark):
    rnd = random.Random(5)
    pts = [(i, rnd.randrange(-400, 400) / 8, rnd.randrange(-400, 400) / 8) for i in range(400)]
    bxs = []
    for i in range(60):
        x, y = rnd.randrange(-400, 400) / 8, rnd.randrange(-400, 400) / 8
        bxs.append((i, x, y, x + rnd.randrange(1, 120) / 8, y + rnd.randrange(1, 120) / 8))
    p = spark.createDataFrame(pts, "fid bigint, x double, y double")
    b = spark.createDataFrame(bxs, "fid bigint, minx double, miny double, maxx double, maxy double")
    got = sorted(map(tuple, join.points_in_boxes(p, b).collect()))
    assert got == sorted((i, j) for i, a, c, d, e in bxs for j, x, y in pts if a <= x <= d and c <= y <= e)
    got = sorted(map(tuple, join.boxes_meet(b, b).collect()))
    assert got == sorted((u[0], v[0]) for u in bxs for v in bxs if u[1] <= v[3] and v[1] <= u[3] and u[2] <= v[4] and v[2] <= u[4])
    plan = join.points_in_boxes(p, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boxes_of_one_cell_in_blocks(spark):
    rnd = random.Random(6)
    bxs = [(i, *(x := (rnd.randrange(64) / 8, rnd.randrange(64) / 8)), x[0] + rnd.randrange(9) / 8, x[1] + rnd.randrange(9) / 8) for i in range(900)]
    bxs += [(1000 + i, *bxs[7][1:]) for i in range(150)] + [(None, *bxs[7][1:])]
    names = ("minx", "miny", "maxx", "maxy")
    b = spark.createDataFrame(bxs, "fid int, " + ", ".join(f"{n} double" for n in names)).coalesce(2)
    brute = [(u, v) for u in bxs for v in bxs if u[1] <= v[3] and v[1] <= u[3] and u[2] <= v[4] and v[2] <= u[4]]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    pairs = join.boxes_meet(b, b)
    assert sorted(map(tuple, pairs.collect()), key=key) == sorted(((u[0], v[0]) for u, v in brute), key=key)
    carried = join.boxes_meet(b, b, carry=True, once=True)
    assert carried.columns == ["a", "b", *(f"{p}_{n}" for p in "ab" for n in names)]
    assert sorted(map(tuple, carried.collect())) == sorted((u[0], v[0], *u[1:], *v[1:]) for u, v in brute if None not in (u[0], v[0]) and u[0] < v[0])
    # What the cells' join gives are blocks of boxes, not pairs: few rows.
    rows = pairs._jdf.queryExecution().executedPlan()
    assert "MapInArrow" in rows.toString() and "NestedLoop" not in rows.toString()


def test_query_fields_and_modes(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 5.0, 5.0, "b"), (3, 9.0, 9.0, "c")], "fid bigint, x double, y double, kind string")
    q = query.QueryDef(fields=[], box=(0.0, 0.0, 6.0, 6.0))
    assert query.query(p, q).columns == ["fid", "x", "y"]
    ids = lambda mode: sorted(r.fid for r in query.query(p, query.QueryDef(mode=mode, box=(0.0, 0.0, 6.0, 6.0))).collect())
    assert (ids("Contains"), ids("Covers"), ids("Touches"), ids("Disjoint")) == ([2], [1, 2], [1], [3])


def test_shapefile(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("strata_shp").option("records", "6").load(sample_shapefile(str(tmp_path)))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 20
    r = df.where("fid = 3").first()
    assert (r.gtype, r.NAME, r.POP, r.AREA, str(r.DAY), r.OK, len(r.parts[0][0])) == (5, "line3", 30, 0.75, "2020-01-02", True, 3)


def test_sqlite_round_trip(spark, tmp_path):
    spark.dataSource.register(SpatialiteSource)
    path = str(tmp_path / "s.sqlite")
    write_table([(1, 1, [[[(1.0, 2.0)]]], "a"), (5, 1, [[[(3.0, 4.0)]]], None)], path, "t", [("name", "string")])
    rows = spark.read.format("strata_sqlite").option("table", "t").option("rows", "2").load(path).orderBy("fid").collect()
    assert [(r.fid, r.minx, r.name, r.srid) for r in rows] == [(1, 1.0, "a", 4326), (5, 3.0, None, 4326)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    df = spark.range(10).select(F.col("id").alias("fid"), (F.col("id") % 3).cast("int").alias("code"))
    convert(df, store, "Cities")
    assert store.names() == ["cities"] and store.read("CITIES").count() == 10
    plan = store.read("cities").where("code in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [code" in plan
    assert store.drop("cities") and store.names() == []


def test_sqlite_store(spark, tmp_path):
    from strataframe.sources.spatialite import SqliteStore

    store = SqliteStore(str(tmp_path / "s.sqlite"))
    name = store.create("Roads", 1, [("name", "string"), ("pk", "bigint"), ("len", "double")])
    assert store.create("roads", 1, []) == "roads001" and store.tables()[0] == {"name": "Roads", "gtype": 1, "srid": 4326, "level": -1, "index": "xzorder"}
    assert store.statistics("roads001") == (0, None)
    assert store.write(name, [(None, 1, [[[(1.0, 2.0)]]], "a", 0.5), (None, 1, [[[(3.0, 9.0)]]], "b", None), (None, 1, None, "c", 1.0)]) == 3
    assert store.statistics(name) == (3, (1.0, 2.0, 3.0, 9.0))
    assert store.column_exists(name, "LEN") and not store.column_exists(name, "wide")
    store.add_column(name, "wide", "double")
    store.add_index(name, "len")
    spark.dataSource.register(SpatialiteSource)
    rows = spark.read.format("strata_sqlite").option("table", name).load(store.path).orderBy("fid").collect()
    assert [(r.fid, r.name, r.len, r.minx, r.wide) for r in rows] == [(1, "a", 0.5, 1.0, None), (2, "b", None, 3.0, None), (3, "c", 1.0, None, None)]
    assert store.delete(name) and not store.delete(name) and [t["name"] for t in store.tables()] == ["roads001"]


def test_key_store(spark, tmp_path):
    from strataframe.functions import geometry
    from strataframe.sources.stores import KeyStore

    rnd = random.Random(31)
    rows = [(i, s, rnd.uniform(-170, 170) if s == 0 else 0.0, rnd.uniform(-80, 80)) for i in range(200) for s in (0,)]
    rows += [(i, 1, x + rnd.uniform(0, 5), y + rnd.uniform(0, 5)) for i, _, x, y in rows]
    lines = geometry.from_vertices(spark.createDataFrame(rows, "fid bigint, seq int, x double, y double"), 5)
    store = KeyStore(spark, str(tmp_path / "keys"))
    store.create("lines", 5, (-180.0, -90.0, 180.0, 90.0), 6)
    with pytest.raises(ValueError):
        store.create("lines", 5, (-180.0, -90.0, 180.0, 90.0), 6)
    store.write("lines", lines.where("fid < 100"))
    store.write("lines", lines.where("fid >= 100"))
    info = store.info("lines")
    boxes = {i: (min(a[2], b[2]), min(a[3], b[3]), max(a[2], b[2]), max(a[3], b[3])) for a, b in zip(rows[:200], rows[200:], strict=True) for i in (a[0],)}
    assert info["count"] == 200 and info["bbox"] == [min(b[0] for b in boxes.values()), min(b[1] for b in boxes.values()), max(b[2] for b in boxes.values()), max(b[3] for b in boxes.values())]
    q = (-30.0, -20.0, 60.0, 40.0)
    got = store.scan("lines", q).collect()
    assert sorted(r.fid for r in got) == sorted(i for i, b in boxes.items() if b[0] <= q[2] and q[0] <= b[2] and b[1] <= q[3] and q[1] <= b[3])
    assert all(len(r.rowkey) == 12 and int.from_bytes(r.rowkey[4:], "big") == r.fid for r in got)
    assert store.names() == ["lines"] and store.delete("lines") and store.names() == []


def test_point_index(spark, tmp_path):
    from strataframe.sources.stores import PointIndex

    store = PointIndex(spark, str(tmp_path / "docs"))
    store.create("shops")
    store.write("shops", spark.range(100).selectExpr("id as fid", "cast(id as double) x", "cast(id % 10 as double) y"))
    box = (10.0, 0.0, 500.0, 4.0)
    first = [r.gid for r in store.search("shops", box, size=7).collect()]
    second = [r.gid for r in store.search("shops", box, after=first[-1], size=7).collect()]
    assert first + second == [i for i in range(10, 100) if i % 10 <= 4][:14]
    assert store.names() == ["shops"] and store.delete("shops") and store.names() == []


def test_catalogs(spark, tmp_path):
    from strataframe.sources import catalogs, files

    root = str(tmp_path)
    for name in ("a/x.SHP", "a/y.tif", "a/Thumbnails/z.tif", "b/w.tiff"):
        files.put(spark, f"{root}/{name}", b"1")
    assert [p.rsplit("/", 1)[1] for p in catalogs.shapefiles(spark, root)] == ["x.SHP"]
    assert [p.rsplit("/", 1)[1] for p in catalogs.rasters(spark, root)] == ["y.tif", "w.tiff"]
    doc = catalogs.MapDocument("all", 4326, [catalogs.Layer("x", f"{root}/a/x.SHP", "range", {"classes": 10})])
    doc.save(spark, f"{root}/maps/all.gmp")
    assert b"../a/x.SHP" in files.get(spark, f"{root}/maps/all.gmp") and catalogs.MapDocument.open(spark, f"{root}/maps/all.gmp") == doc
    catalogs.save_services(spark, f"{root}/list.gms", [f"{root}/maps/all.gmp"])
    files.put(spark, f"{root}/list2.gms", b"// no\n\nmaps/all.gmp\n")
    assert catalogs.open_services(spark, f"{root}/list.gms") == catalogs.open_services(spark, f"{root}/list2.gms") == [f"{root}/maps/all.gmp"]
    rows = [(0, f"{root}/a/y.tif", 0.0, 0.0, 10.0, 10.0, 0.5), (0, f"{root}/b/w.tiff", 10.0, 0.0, 20.0, 10.0, 0.5), (1, f"{root}/a/Thumbnails/z.tif", 0.0, 0.0, 20.0, 10.0, 2.0)]
    catalogs.save_mosaic(spark.createDataFrame(rows, catalogs.MOSAIC), f"{root}/m/all.gmr")
    assert sorted(map(tuple, catalogs.open_mosaic(spark, f"{root}/m/all.gmr").collect())) == sorted(rows)
    assert catalogs.raster_box((100.0, 0.5, 0.0, 50.0, 0.0, -0.25), 20, 40) == (100.0, 40.0, 110.0, 50.0)


def test_paths():
    from strataframe.functions import paths

    assert paths.free_name("Roads", ["roads", "roads001"]) == "Roads002" and paths.free_name("x", ["y"]) == "x"
    assert paths.relative_path("/c/temp/a.gmp", "/c/abc.def") == "../abc.def" and paths.absolute_path("hdfs://h/c/temp/a.gmp", "../x") == "hdfs://h/c/x"
    assert paths.json_objects('x {"a": "}{"} , {"b": {"c": 1}}]') == ['{"a": "}{"}', '{"b": {"c": 1}}']
    assert paths.progress(50, 200, 10.0) == (25, 5.0, 30.0)


def test_pyramid_and_tiles_are_stored(spark, tmp_path):
    from strataframe.functions import geometry

    rows = [(i, s, float(s) / 100, (s % 2) / 1000) for i in range(3) for s in range(200)]
    f = geometry.with_bounds(geometry.from_vertices(spark.createDataFrame(rows, "fid bigint, seq int, x double, y double"), 5))
    tiles.save_pyramid(f, [0, 6, 12], str(tmp_path / "p"))
    sizes = [tiles.load_pyramid(spark, str(tmp_path / "p"), v).select(F.sum(geometry.point_count(F.col("parts")))).first()[0] for v in (0, 3, 6, 12, 20)]
    assert sizes[0] == sizes[1] < sizes[3] == sizes[4] and sizes[3] == 600
    tiles.save_tiles(tiles.feature_tiles(f, 1), str(tmp_path / "t"))
    assert tiles.tile(spark, str(tmp_path / "t"), 1, 2, 0) and tiles.tile(spark, str(tmp_path / "t"), 1, 0, 0) is None


def test_indexes_follow_the_table(spark):
    from strataframe.operators import index

    rnd = random.Random(33)
    rows = [(i, *(v := (rnd.gauss(0, 1), rnd.gauss(0, 1))), *v) for i in range(3000)] + [(9000 + i, -50.0, -50.0, 50.0, 50.0) for i in range(5)]
    df = spark.createDataFrame(rows, "fid bigint, minx double, miny double, maxx double, maxy double")
    leaves = index.quadtree_leaves(df, (-64.0, -64.0, 64.0, 64.0), 100)
    counts = {r.leaf: r.n for r in leaves.groupBy("leaf").agg(F.count("fid").alias("n")).collect()}
    assert sum(counts.values()) == 3005 and counts[""] >= 5 and max(len(k) for k in counts) > 4 and max(n for k, n in counts.items() if 0 < len(k) < 8) <= 100
    q = (0.2, 0.2, 0.6, 0.9)
    hit = leaves.where(f"minx <= {q[2]} and maxx >= {q[0]} and miny <= {q[3]} and maxy >= {q[1]}")
    kept = leaves.where(index.leaf_meets(F.col("leaf"), q, (-64.0, -64.0, 64.0, 64.0)))
    assert hit.join(kept.select("fid"), "fid", "left_anti").count() == 0 and kept.count() < 2000
    assert index.with_index(df, kind="noindex")[2] is df and index.leaf_capacity(10**6) == 3906
    assert "code" in index.with_index(df, kind="zorder")[2].columns and "cx" in index.with_index(df, kind="grid")[2].columns
    with pytest.raises(ValueError):
        index.with_index(df, kind="rtree2")


def test_tiles(spark):
    p = spark.createDataFrame([(1, -180.0, 90.0), (2, 179.0, -89.0)], "fid bigint, x double, y double")
    got = sorted((r.level, r.col, r.row, r.features) for r in tiles.assign_points(p, [0, 1]).collect())
    assert got == [(0, 0, 0, 1), (0, 1, 0, 1), (1, 0, 0, 1), (1, 3, 1, 1)]
    assert tiles.useful_levels((0.0, 0.0, 10.0, 10.0), 1000)[0] <= tiles.useful_levels((0.0, 0.0, 10.0, 10.0), 1000)[1]


def test_stream_append(spark, tmp_path):
    from strataframe.streaming import append_features

    spark.range(5).select(F.col("id").alias("fid"), F.lit(1).alias("code")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fid bigint, code int").parquet(str(tmp_path / "in"))
    append_features(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
