"""Registered queries over the fixture views, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells, crs, geometry, paths
from ..functions.rect import Rect
from ..functions.segment import Segment, angle, cross, distance2, ring_contains
from ..operators import index, join, query, themes, tiles
from ..operators.batches import slices
from ..operators.where import where
from .fixtures import cte, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORLD = (-180.0, -90.0, 180.0, 90.0)
BOX = (-20.0, -20.0, 60.0, 40.0)
LEVEL = 5
P, B, V, R, A = "fx_points", "fx_boxes", "fx_vertices", "fx_rings", "fx_rasters"


def register(views: tuple[str, ...], sql: str | None = None):
    """The function gets the views as DataFrames; sql is the oracle after the views' with clause."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) if v.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views))

        QUERIES[f.__name__] = run
        if sql is not None:
            made = [v for v in views if v.startswith("fx_")]
            text = sql.strip()
            if made and text.lower().startswith("with recursive "):
                text = "with recursive " + cte(*made).rstrip()[5:] + ", " + text[15:]
            elif made and text.lower().startswith("with "):
                text = cte(*made).rstrip() + ", " + text[5:]
            elif made:
                text = cte(*made) + text
            ORACLE_SQL[f.__name__] = text
        return f

    return wrap


def lit(r) -> Rect:
    return Rect.lit(*r)


def _in(r, x="x", y="y") -> str:
    return f"{x} >= {r[0]} and {x} <= {r[2]} and {y} >= {r[1]} and {y} <= {r[3]}"


def _meet(r) -> str:
    return f"minx <= {r[2]} and maxx >= {r[0]} and miny <= {r[3]} and maxy >= {r[1]}"


# --- projection and attribute filters -------------------------------------------------


@register((P,), "select fid, x, y from fx_points")
def scan_project(p):
    return query.query(p, query.QueryDef(fields=[]))


@register((P,), "select fid, kind, val from fx_points where val > 100000 or (val < 2000 and lower(kind) = 'o')")
def where_and_or(p):
    return where(p, "val>100000 or val<2000 and kind='O'").select("fid", "kind", "val")


@register((P,), "select fid from fx_points where (val > 50000 and (kind = 'O' or kind = 'P') and fid > 100) or (fid < 50 and not kind = 'F')")
def where_nested(p):
    return where(p, "(val > 50000 and (kind = \"O\" or kind='P') AND fid>100) OR (fid<50 and kind != 'F')").select("fid")


@register((P,), "select fid, kind from fx_points where lower(kind) = 'o'")
def where_string_ci(p):
    return where(p, "kind = 'o'").select("fid", "kind")


@register((P,), "select fid, x from fx_points where abs(x - 12.5) < 1e-9")
def where_float_tol(p):
    return where(p, "x = 12.5000000001").select("fid", "x")


@register(("orders",), "select o_orderkey as fid, o_orderdate from orders where o_orderdate <= timestamp '1995-06-30 00:00:00'")
def where_time_le(o):
    return where(o, "o_orderdate <= '1995-06-30 00:00:00'").select(F.col("o_orderkey").alias("fid"), "o_orderdate")


@register(
    ("orders",),
    "select o_orderkey as fid, cast(12 as bigint) as num, cast(0 as bigint) as no_num, 1.5e0 as dbl, date '1970-01-01' as no_day, date '1995-03-04' as day_, true as flag from orders where o_orderdate >= date '1995-03-04'",
)
def literal_cast(o):
    from pyspark.sql import types as T

    from ..operators.where import literal

    texts = (("num", "12", T.LongType()), ("no_num", "x", T.LongType()), ("dbl", "'1.5'", T.DoubleType()), ("no_day", "soon", T.DateType()), ("day_", "1995-03-04", T.DateType()), ("flag", "true", T.BooleanType()))
    return where(o, "o_orderdate >= '1995-03-04'").select(F.col("o_orderkey").alias("fid"), *(literal(v, k).alias(n) for n, v, k in texts))


@register(("orders",), "select o_orderkey as fid, cast(o_orderdate as date) as day_ from orders where cast(o_orderdate as date) > date '1997-12-30' or cast(o_orderdate as date) = date '1995-06-17'")
def where_date(o):
    days = o.select(F.col("o_orderkey").alias("fid"), F.col("o_orderdate").cast("date").alias("day_"))
    return where(days, "day_ > '1997-12-30' or day_ = 1995-06-17")


@register((P,), f"select fid, x, y, kind from fx_points where {_in(BOX)}")
def bbox_points(p):
    return query.query(p, query.QueryDef(fields=["kind"], mode="Covers", box=BOX))


@register(
    (P,),
    f"""select fid, case when x > {BOX[0]} and x < {BOX[2]} and y > {BOX[1]} and y < {BOX[3]} then 'contains'
 when {_in(BOX)} then 'touches' else 'disjoint' end as relation from fx_points""",
)
def point_rect_modes(p):
    r, x, y = lit(BOX), F.col("x"), F.col("y")
    return p.select("fid", F.when(r.contains_point(x, y), "contains").when(r.touches_point(x, y), "touches").otherwise("disjoint").alias("relation"))


@register(
    (P,),
    f"""with m as (select fid, case when x > {BOX[0]} and x < {BOX[2]} and y > {BOX[1]} and y < {BOX[3]} then '0FFFFF212'
 when {_in(BOX)} then 'F0FFFF212' else 'FF0FFF212' end as matrix from fx_points)
 select fid, matrix, regexp_full_match(matrix, '[012]........') as inside from m""",
)
def point_rect_de9im(p):
    m = query.point_matrix(lit(BOX), F.col("x"), F.col("y"))
    return p.select("fid", m.alias("matrix")).withColumn("inside", query.matrix_matches(F.col("matrix"), "T********"))


# --- rectangles -----------------------------------------------------------------------

FIXED = (0.0, 0.0, 40.0, 30.0)
_q = dict(zip(("x0", "y0", "x1", "y1"), FIXED, strict=True))


@register(
    (B,),
    """select fid, minx > {x0} and miny > {y0} and maxx < {x1} and maxy < {y1} as contains,
 minx >= {x0} and miny >= {y0} and maxx <= {x1} and maxy <= {y1} as covers,
 minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0} as intersects,
 minx < {x1} and maxx > {x0} and miny < {y1} and maxy > {y0} as overlaps,
 not (minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0}) as disjoint,
 (minx <= {x1} and maxx >= {x0} and miny <= {y1} and maxy >= {y0}) and not (minx < {x1} and maxx > {x0} and miny < {y1} and maxy > {y0}) as touches,
 minx = {x0} and miny = {y0} and maxx = {x1} and maxy = {y1} as equals from fx_boxes""".format(**_q),
)
def rect_relations(b):
    q, r = lit(FIXED), Rect.of()
    names = ("contains", "covers", "intersects", "overlaps", "disjoint", "touches", "equals")
    return b.select("fid", *(getattr(q, n)(r).alias(n) for n in names))


@register(
    (B,),
    """select fid, least(minx, {x0}) as u_minx, least(miny, {y0}) as u_miny, greatest(maxx, {x1}) as u_maxx, greatest(maxy, {y1}) as u_maxy,
 greatest(minx, {x0}) as i_minx, greatest(miny, {y0}) as i_miny, least(maxx, {x1}) as i_maxx, least(maxy, {y1}) as i_maxy,
 least(maxx, {x1}) > greatest(minx, {x0}) and least(maxy, {y1}) > greatest(miny, {y0}) as i_valid from fx_boxes""".format(**_q),
)
def rect_union_intersection(b):
    u, i = Rect.of().union(lit(FIXED)), Rect.of().intersection(lit(FIXED))
    names = ("minx", "miny", "maxx", "maxy")
    return b.select(
        "fid",
        *(c.alias(f"u_{n}") for n, c in zip(names, u.columns(), strict=True)),
        *(c.alias(f"i_{n}") for n, c in zip(names, i.columns(), strict=True)),
        i.is_valid().alias("i_valid"),
    )


@register(
    (B,),
    """select fid, minx + 1.5e0 as o_minx, maxy - 2.25e0 as o_maxy, minx - 0.5e0 as e_minx, maxy + 0.5e0 as e_maxy,
 (minx + maxx) / 2 - (maxx - minx) * 2 / 2 as s_minx, (miny + maxy) / 2 + (maxy - miny) * 2 / 2 as s_maxy,
 (maxx - minx) * (maxy - miny) as area, (minx + maxx) / 2 as cx, (miny + maxy) / 2 as cy from fx_boxes""",
)
def rect_offset_extend_scale(b):
    r = Rect.of()
    o, e, s, c = r.offset(1.5, -2.25), r.extend(0.5), r.scale(2.0), r.center()
    return b.select(
        "fid", o.minx.alias("o_minx"), o.maxy.alias("o_maxy"), e.minx.alias("e_minx"), e.maxy.alias("e_maxy"), s.minx.alias("s_minx"),
        s.maxy.alias("s_maxy"), r.area().alias("area"), c[0].alias("cx"), c[1].alias("cy"),
    )


@register(
    (B,),
    """select fid, ax, ay, case ax when 1 then (minx + maxx) / 2 else minx end as minx, case ay when 1 then (miny + maxy) / 2 else miny end as miny,
 case ax when 1 then maxx else (minx + maxx) / 2 end as maxx, case ay when 1 then maxy else (miny + maxy) / 2 end as maxy
 from fx_boxes cross join (select 0 as ax union all select 1) a cross join (select 0 as ay union all select 1) b""",
)
def rect_quadrants(b):
    flag = F.explode(F.array(F.lit(0), F.lit(1)))
    b = b.withColumn("ax", flag).withColumn("ay", flag)
    q = Rect.of().quadrant(F.col("ax") == 1, F.col("ay") == 1)
    return b.select("fid", "ax", "ay", q.minx.alias("minx"), q.miny.alias("miny"), q.maxx.alias("maxx"), q.maxy.alias("maxy"))


@register(
    (B,),
    """with c as (select *, minx < 0 and maxx > 0 as cut_x, miny < 10 and maxy > 10 as cut_y from fx_boxes)
 select fid, 'LU' as part, minx, 10e0 as miny, 0e0 as maxx, maxy from c where cut_x and cut_y
 union all select fid, 'LD', minx, miny, 0e0, 10e0 from c where cut_x and cut_y
 union all select fid, 'RU', 0e0, 10e0, maxx, maxy from c where cut_x and cut_y
 union all select fid, 'RD', 0e0, miny, maxx, 10e0 from c where cut_x and cut_y
 union all select fid, 'L', minx, miny, 0e0, maxy from c where cut_x and not cut_y
 union all select fid, 'R', 0e0, miny, maxx, maxy from c where cut_x and not cut_y
 union all select fid, 'U', minx, 10e0, maxx, maxy from c where not cut_x and cut_y
 union all select fid, 'D', minx, miny, maxx, 10e0 from c where not cut_x and cut_y""",
)
def rect_split_xy(b):
    return b.select("fid", F.explode(Rect.of().split_xy(0, 10)).alias("s")).select("fid", "s.part", "s.minx", "s.miny", "s.maxx", "s.maxy")


@register(
    (B,),
    """select fid, i as corner, case i when 0 then minx when 1 then minx when 2 then maxx when 3 then maxx else minx end as x,
 case i when 0 then maxy when 1 then miny when 2 then miny when 3 then maxy else maxy end as y
 from fx_boxes cross join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4) t""",
)
def rect_corners(b):
    return b.select("fid", F.posexplode(Rect.of().corners(closed=True)).alias("corner", "p")).select("fid", "corner", "p.x", "p.y")


# --- aggregates -----------------------------------------------------------------------

def _bounds():
    return F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")


@register((B,), "select min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from fx_boxes")
def extent_agg(b):
    return b.agg(*_bounds())


@register((B,), "select kind, count(*) as n, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy from fx_boxes group by kind")
def extent_by_kind(b):
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *_bounds())


@register((P, B), "select 'points' as name, count(*) as n from fx_points union all select 'boxes', count(*) from fx_boxes")
def count_stats(p, b):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return one(p, "points").unionByName(one(b, "boxes"))


@register(
    (P, B),
    "select b.fid, cast(floor(n.n * ((maxx - minx) * (maxy - miny)) / 64800) as bigint) as estimate from fx_boxes b cross join (select count(*) as n from fx_points) n",
)
def area_estimate(p, b):
    n = p.agg(F.count(F.lit(1)).alias("n"))
    return b.join(F.broadcast(n)).select("fid", F.floor(F.col("n") * Rect.of().area() / 64800).cast("bigint").alias("estimate"))


@register(
    (P,),
    """with c as (select cast(floor(x / 10) as int) as cell, count(*) as n from fx_points group by 1)
 select max(n) as most, min(n) as least, (select cell from c order by n desc, cell limit 1) as at from c""".replace("as at", "as cell_of_most"),
)
def max_min_counts(p):
    c = p.groupBy(F.floor(F.col("x") / 10).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.max_by("cell", F.struct("n", -F.col("cell"))).alias("cell_of_most"))


# --- cells ----------------------------------------------------------------------------

_GRID = """cells as (select fid, cx, cy from fx_boxes, unnest(range(cast(floor(minx / 8) as bigint), cast(floor(maxx / 8) as bigint) + 1)) a(cx),
 unnest(range(cast(floor(miny / 8) as bigint), cast(floor(maxy / 8) as bigint) + 1)) b(cy))"""


@register((B,), f"with {_GRID} select fid, cast(cx as int) as cx, cast(cy as int) as cy from cells")
def grid_index_assign(b):
    return join.with_cells(b, 8.0).select("fid", "cx", "cy")


@register((B,), f"with {_GRID} select count(*) as entries, count(distinct fid) as features from cells")
def grid_duplication(b):
    return join.with_cells(b, 8.0).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("fid").alias("features"))


@register((B,), f"select fid from fx_boxes where {_meet(BOX)}")
def grid_query_distinct(b):
    q = lit(BOX)
    hit = join.with_cells(b, 8.0).where((F.col("cx").between(-3, 7)) & F.col("cy").between(-3, 5)).where(q.intersects(Rect.of()))
    return hit.select("fid").distinct()


def _sql_cells(lv: int) -> dict[str, str]:
    n, w, h = 1 << lv, 360.0 / (1 << lv), 180.0 / (1 << lv)
    c0, r0 = f"greatest(0, least({n - 1}, floor((minx + 180) / {w})))", f"greatest(0, least({n - 1}, floor((miny + 90) / {h})))"
    c1, r1 = f"greatest(0, least({n - 1}, ceil((maxx + 180) / {w}) - 1))", f"greatest(0, least({n - 1}, ceil((maxy + 90) / {h}) - 1))"
    return {"c0": f"cast({c0} as int)", "r0": f"cast({r0} as int)", "c1": f"cast(greatest({c0}, {c1}) as int)", "r1": f"cast(greatest({r0}, {r1}) as int)"}


def _sql_interleave(c: str, r: str, lv: int) -> str:
    return " + ".join(f"((({c}) >> {b}) & 1) * {2 << 2 * b} + ((({r}) >> {b}) & 1) * {1 << 2 * b}" for b in range(lv))


def _sql_code(kind: str, level: int = LEVEL) -> str:
    out = "case"
    for lv in range(level, 0, -1):
        s = _sql_cells(lv)
        ok = f"{s['c0']} = {s['c1']} and {s['r0']} = {s['r1']}" if kind == "z" else f"{s['c1']} - {s['c0']} <= 1 and {s['r1']} - {s['r0']} <= 1"
        out += f" when {ok} then {_sql_interleave(s['c0'], s['r0'], lv)} + {cells.cells_before(lv)}"
    return f"cast({out} else 0 end as int)"


def coded(b: DataFrame, kind: str) -> DataFrame:
    f = cells.zorder_code if kind == "z" else cells.xzorder_code
    return b.withColumn("code", f(Rect.of(), WORLD, LEVEL))


@register((B,), f"select fid, {_sql_code('z')} as code from fx_boxes")
def zorder_code(b):
    return coded(b, "z").select("fid", "code")


@register((B,), f"select fid, {_sql_code('xz')} as code from fx_boxes")
def xzorder_code(b):
    return coded(b, "xz").select("fid", "code")


def _code_rows(codes: list[int]) -> str:
    rows = ", ".join("({}, {}, {}, {}, {})".format(c, *cells.cell_bounds(c, WORLD)) for c in codes)
    return f"select cast(a as int) as code, cast(b as double) as minx, cast(c as double) as miny, cast(d as double) as maxx, cast(e as double) as maxy from (values {rows}) t(a, b, c, d, e)"


@register(
    (B,),
    f"""with codes as (select distinct {_sql_code('z')} as code from fx_boxes), lv as (select code, case when code >= 341 then 5 when code >= 85 then 4
 when code >= 21 then 3 when code >= 5 then 2 when code >= 1 then 1 else 0 end as l from codes),
 z as (select code, l, code - cast((pow(4, l) - 1) / 3 as int) as k from lv),
 xy as (select code, l, {" + ".join(f"((k >> {2 * b + 1}) & 1) * {1 << b}" for b in range(5))} as cx, {" + ".join(f"((k >> {2 * b}) & 1) * {1 << b}" for b in range(5))} as cy from z)
 select code, -180 + cx * 360 / pow(2e0, l) as minx, -90 + cy * 180 / pow(2e0, l) as miny, -180 + (cx + 1) * 360 / pow(2e0, l) as maxx,
 -90 + (cy + 1) * 180 / pow(2e0, l) as maxy from xy""",
)
def zorder_cell_bbox(b):
    r = cells.code_bounds(F.col("code"), WORLD, LEVEL)
    return coded(b, "z").select("code").distinct().select("code", *(c.alias(n) for c, n in zip(r.columns(), query.BBOX, strict=True)))


@register((B,), f"select fid from fx_boxes where {_meet(BOX)}")
def zorder_query(b):
    return query.query(coded(b, "z"), query.QueryDef(box=BOX), index="zorder", extent=WORLD, level=LEVEL).select("fid")


@register((B,), f"select fid from fx_boxes where {_meet(BOX)}")
def xzorder_query(b):
    return query.query(coded(b, "xz"), query.QueryDef(box=BOX), index="xzorder", extent=WORLD, level=LEVEL).select("fid")


@register(
    (B,),
    f"""with c as (select *, {_sql_code('z')} as code from fx_boxes), lv as (select *, case when code >= 341 then 5 when code >= 85 then 4
 when code >= 21 then 3 when code >= 5 then 2 when code >= 1 then 1 else 0 end as l from c), z as (select *, code - cast((pow(4, l) - 1) / 3 as int) as k from lv),
 xy as (select *, {" + ".join(f"((k >> {2 * b + 1}) & 1) * {1 << b}" for b in range(5))} as cx, {" + ".join(f"((k >> {2 * b}) & 1) * {1 << b}" for b in range(5))} as cy from z),
 bb as (select *, -180 + cx * 360 / pow(2e0, l) as ax, -90 + cy * 180 / pow(2e0, l) as ay, -180 + (cx + 1) * 360 / pow(2e0, l) as bx, -90 + (cy + 1) * 180 / pow(2e0, l) as b_y from xy)
 select l as level, count(*) as n, coalesce(sum(case when greatest(minx, -180) >= ax and greatest(miny, -90) >= ay and least(maxx, 180) <= bx and least(maxy, 90) <= b_y then 0 else 1 end), 0)::bigint as outside,
 count(*) - count(distinct fid) as repeated from bb group by l""",
)
def zorder_check(b):
    # What reaches over the extent's edge is clamped to it, as codes are.
    inside = cells.code_bounds(F.col("code"), WORLD, LEVEL).covers(Rect.of().intersection(lit(WORLD)))
    level = F.lit(0)
    for k in range(1, LEVEL + 1):
        level = F.when(F.col("code") >= cells.cells_before(k), k).otherwise(level)
    return coded(b, "z").groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((~inside).cast("bigint")).alias("outside"), (F.count(F.lit(1)) - F.count_distinct("fid")).alias("repeated")
    )


def _sql_quad() -> str:
    out = "case"
    for lv in range(LEVEL, 0, -1):
        s = _sql_cells(lv)
        path = " || ".join(f"cast((({s['c0']} >> {b}) & 1) * 2 + (({s['r0']} >> {b}) & 1) as varchar)" for b in range(lv - 1, -1, -1))
        out += f" when {s['c0']} = {s['c1']} and {s['r0']} = {s['r1']} then {path}"
    return out + " else '' end"


@register((B,), f"select fid, {_sql_quad()} as path from fx_boxes")
def qtree_key(b):
    return b.select("fid", cells.quad_key(Rect.of(), WORLD, LEVEL).alias("path"))


@register(
    (B,),
    f"""with c as (select distinct {_sql_code('xz')} as code from fx_boxes), g as (select code, code - row_number() over (order by code) as island from c)
 select min(code) as first_code, max(code) as last_code, count(*) as n from g group by island""",
)
def code_ranges(b):
    codes = coded(b, "xz").select("code").distinct()  # at most as many rows as there are cells: one window partition is bounded
    g = codes.withColumn("island", F.col("code") - F.row_number().over(Window.orderBy("code")))
    return g.groupBy("island").agg(F.min("code").alias("first_code"), F.max("code").alias("last_code"), F.count(F.lit(1)).alias("n")).drop("island")


@register((B,), f"select fid, lpad(printf('%x', code), 8, '0') || lpad(printf('%x', fid), 16, '0') as rowkey from (select fid, {_sql_code('z')} as code from fx_boxes) t")
def rowkey_hex(b):
    return coded(b, "z").select("fid", F.lower(F.concat(F.lpad(F.hex("code"), 8, "0"), F.lpad(F.hex("fid"), 16, "0"))).alias("rowkey"))


def _sql_geohash(p: int) -> str:
    n = 5 * p
    bx, by = (n + 1) // 2, n // 2
    cx = f"cast(greatest(0, least({(1 << bx) - 1}, ceil((x + 180) / 360 * {1 << bx}) - 1)) as bigint)"
    cy = f"cast(greatest(0, least({(1 << by) - 1}, ceil((y + 90) / 180 * {1 << by}) - 1)) as bigint)"
    out = []
    for d in range(p):
        terms = []
        for k in range(5):
            bit = d * 5 + k
            s, w = (cx, bx) if bit % 2 == 0 else (cy, by)
            terms.append(f"(({s} >> {w - 1 - bit // 2}) & 1) * {1 << (4 - k)}")
        out.append(f"substr('{cells.BASE32}', cast({' + '.join(terms)} + 1 as bigint), 1)")
    return " || ".join(out)


@register((P,), f"select fid, {_sql_geohash(5)} as code from fx_points")
def geohash_encode(p):
    return p.select("fid", cells.geohash(F.col("x"), F.col("y"), 5).alias("code"))


@register(
    (P,),
    """select fid, (greatest(0, least(8191, ceil((x + 180) / 360 * 8192) - 1)) + 0.5e0) * (360 / 8192e0) - 180 as cx,
 (greatest(0, least(4095, ceil((y + 90) / 180 * 4096) - 1)) + 0.5e0) * (180 / 4096e0) - 90 as cy, 360 / 8192e0 as width, 180 / 4096e0 as height from fx_points""",
)
def geohash_decode(p):
    cx, cy, w, h = cells.geohash_cell(cells.geohash(F.col("x"), F.col("y"), 5), 5)
    return p.select("fid", cx.alias("cx"), cy.alias("cy"), w.alias("width"), h.alias("height"))


@register((P,), f"select {_sql_geohash(2)} as cell, count(*) as n, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_points where {_in(BOX)} group by 1")
def geohash_grid_agg(p):
    return themes.grid_counts(p, 2, BOX)


@register((B,), f"select fid from fx_boxes where not ({_meet(BOX)})")
def disjoint_query(b):
    return query.query(coded(b, "z"), query.QueryDef(mode="Disjoint", box=BOX), index="zorder", extent=WORLD, level=LEVEL).select("fid")


# --- joins ----------------------------------------------------------------------------


@register((P, B), "select b.fid as box_fid, p.fid as point_fid from fx_points p join fx_boxes b on x >= minx and x <= maxx and y >= miny and y <= maxy")
def spatial_join_point_box(p, b):
    return join.points_in_boxes(p, b)


@register((B,), "select a.fid as a, b.fid as b from fx_boxes a join fx_boxes b on a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy")
def spatial_join_box_box(b):
    return join.boxes_meet(b, b)


@register((P, B), "select fid from fx_boxes b where not exists (select 1 from fx_points p where x >= minx and x <= maxx and y >= miny and y <= maxy)")
def spatial_anti_join(p, b):
    return join.boxes_without_points(b, p).select("fid")


@register(
    (B, A),
    """with q as (select min(minx) as a, min(miny) as b, max(maxx) as c, max(maxy) as d from fx_rasters where lvl = 0)
 select fid from fx_boxes, q where minx <= c and maxx >= a and miny <= d and maxy >= b""",
)
def bounds_of_other_set(b, a):
    return join.within_bounds_of(b, a.where("lvl = 0")).select("fid")


@register((P,), "select fid, (x - 10) * (x - 10) + (y - 20) * (y - 20) as dist2 from fx_points order by dist2, fid limit 1")
def nearest_point(p):
    return join.nearest(p, 10, 20).select("fid", "dist2")


@register((P,), f"select fid from fx_points where {_in(BOX)} and fid > 1000 order by fid limit 100")
def keyset_page(p):
    return query.page(query.query(p, query.QueryDef(mode="Covers", box=BOX)), 1000, 100).select("fid")


@register((P,), "with c as (select count(*) as n from fx_points) select fid, cast(least(floor((row_number() over (order by fid) - 1) / (n // 7)), 6) as int) as slice from fx_points, c")
def batch_slices(p):
    return slices(p.select("fid"), "fid", 7).select("fid", F.col("slice").cast("int").alias("slice"))


@register((B,), f"with u as (select fid from fx_boxes where {_meet(BOX)} union all select fid from fx_boxes where {_meet(FIXED)}) select distinct fid from u")
def candidate_union_distinct(b):
    one = lambda r: query.query(b, query.QueryDef(box=r)).select("fid")
    return one(BOX).unionByName(one(FIXED)).distinct()


# --- segments, lines, rings -------------------------------------------------------------

_SEG = "seg as (select fid, seq, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from fx_vertices window w as (partition by fid order by seq))"


@register(
    (V,),
    f"""with {_SEG} select fid, seq, x1, y1, x2, y2, (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) as len2,
 (x2 - x1) * (0 - y1) - (y2 - y1) * (0 - x1) as side_of_origin from seg where x2 is not null""",
)
def segments(v):
    s = geometry.segments(v)
    c = [F.col(k) for k in ("x1", "y1", "x2", "y2")]
    return s.select("*", distance2(*c).alias("len2"), cross(*c, F.lit(0.0), F.lit(0.0)).alias("side_of_origin"))


def _sides(x1, y1, x2, y2, px, py):
    return f"sign(({x2} - {x1}) * ({py} - {y1}) - ({y2} - {y1}) * ({px} - {x1}))"


_CROSS_SQL = (
    f"{_sides('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x1', 'b.y1')} * {_sides('a.x1', 'a.y1', 'a.x2', 'a.y2', 'b.x2', 'b.y2')} < 0 and "
    f"{_sides('b.x1', 'b.y1', 'b.x2', 'b.y2', 'a.x1', 'a.y1')} * {_sides('b.x1', 'b.y1', 'b.x2', 'b.y2', 'a.x2', 'a.y2')} < 0"
)


@register(
    (V,),
    f"""with {_SEG} select a.fid, a.seq as a_seq, b.seq as b_seq, {_CROSS_SQL} as crosses,
 (a.x1 = b.x1 and a.y1 = b.y1 and a.x2 = b.x2 and a.y2 = b.y2) or (a.x1 = b.x2 and a.y1 = b.y2 and a.x2 = b.x1 and a.y2 = b.y1) as equals
 from seg a join seg b on a.fid = b.fid and a.seq < b.seq where a.x2 is not null and b.x2 is not null""",
)
def segment_relations(v):
    s = geometry.segments(v)
    a, b = (s.select("fid", *(F.col(c).alias(f"{p}_{c}") for c in ("seq", "x1", "y1", "x2", "y2"))) for p in "ab")
    x, y = Segment.of("a_"), Segment.of("b_")
    return a.join(b, "fid").where("a_seq < b_seq").select("fid", "a_seq", "b_seq", x.crosses(y).alias("crosses"), x.equals(y).alias("equals"))


def _corner_sides(f: str) -> str:
    pts = [(BOX[0], BOX[1]), (BOX[2], BOX[1]), (BOX[2], BOX[3]), (BOX[0], BOX[3])]
    return f"{f}(" + ", ".join(_sides("x1", "y1", "x2", "y2", a, b) for a, b in pts) + ")"


_SEG_MEETS = (
    f"least(x1, x2) <= {BOX[2]} and greatest(x1, x2) >= {BOX[0]} and least(y1, y2) <= {BOX[3]} and greatest(y1, y2) >= {BOX[1]} and "
    f"{_corner_sides('least')} <= 0 and {_corner_sides('greatest')} >= 0"
)


@register((V,), f"with {_SEG} select fid, seq, {_SEG_MEETS} as meets from seg where x2 is not null")
def segment_rect(v):
    return geometry.segments(v).select("fid", "seq", Segment.of().intersects_rect(lit(BOX)).alias("meets"))


@register((V,), f"with {_SEG} select fid, bool_or({_SEG_MEETS}) as meets, bool_and({_in(BOX, 'x1', 'y1')} and {_in(BOX, 'x2', 'y2')}) as covered from seg where x2 is not null group by fid")
def line_rect(v):
    r = lit(BOX)
    ends = [(F.col(a) >= BOX[0]) & (F.col(a) <= BOX[2]) & (F.col(b) >= BOX[1]) & (F.col(b) <= BOX[3]) for a, b in (("x1", "y1"), ("x2", "y2"))]
    return geometry.segments(v).groupBy("fid").agg(F.bool_or(Segment.of().intersects_rect(r)).alias("meets"), F.bool_and(ends[0] & ends[1]).alias("covered"))


@register(
    (P, R),
    """with s as (select fid as ring, x as x1, y as y1, lead(x) over w as x2, lead(y) over w as y2 from fx_rings window w as (partition by fid order by seq)),
 b as (select fid as ring, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_rings group by fid),
 c as (select b.ring, p.fid, p.x, p.y from fx_points p join b on x >= minx and x <= maxx and y >= miny and y <= maxy)
 select c.ring, c.fid from c join s on c.ring = s.ring and s.x2 is not null
  group by c.ring, c.fid having sum(case when (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1
 and not bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) and x >= least(x1, x2) and x <= greatest(x1, x2) and y >= least(y1, y2) and y <= greatest(y1, y2))""",
)
def ring_contains_point(p, r):
    box = r.groupBy("fid").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    s = geometry.segments(r).withColumnRenamed("fid", "box_fid")
    near = join.points_in_boxes(p, box, carry=("x", "y")).join(s, "box_fid")
    seg, x, y = Segment.of(), F.col("x"), F.col("y")
    hits = near.groupBy("box_fid", "point_fid").agg(F.sum(seg.ray(x, y)).alias("n"), F.bool_or(seg.covers_point(x, y)).alias("on"))
    return hits.where(ring_contains(F.col("n"), F.col("on"))).select(F.col("box_fid").alias("ring"), F.col("point_fid").alias("fid"))


_LINE_SQL = f"with {_SEG} select fid, count(*) as segments from seg where x2 is not null group by fid having bool_or({_SEG_MEETS})"


@register((V,), _LINE_SQL)
def line_query_exact(v):
    """Lines whose own course, not only their box, meets the query's rectangle."""
    f = geometry.with_bounds(geometry.from_vertices(v, geometry.POLYLINE))
    hit = query.query(f, query.QueryDef(fields=[], box=BOX))
    return hit.select("fid", (geometry.point_count(F.col("parts")) - 1).cast("bigint").alias("segments"))


def _rect_sql(a: dict, b: dict) -> dict[str, str]:
    """Relations of two rectangles in SQL, by their sides."""
    meet = f"{a['x0']} <= {b['x1']} and {b['x0']} <= {a['x1']} and {a['y0']} <= {b['y1']} and {b['y0']} <= {a['y1']}"
    overlap = f"{a['x0']} < {b['x1']} and {b['x0']} < {a['x1']} and {a['y0']} < {b['y1']} and {b['y0']} < {a['y1']}"
    cover = lambda p, q: f"({p['x0']} <= {q['x0']} and {p['y0']} <= {q['y0']} and {p['x1']} >= {q['x1']} and {p['y1']} >= {q['y1']})"
    strict = lambda p, q: f"({p['x0']} < {q['x0']} and {p['y0']} < {q['y0']} and {p['x1']} > {q['x1']} and {p['y1']} > {q['y1']})"
    same_x = f"(least({a['x1']}, {b['x1']}) > greatest({a['x0']}, {b['x0']}) and ({a['y0']} in ({b['y0']}, {b['y1']}) or {a['y1']} in ({b['y0']}, {b['y1']})))"
    same_y = f"(least({a['y1']}, {b['y1']}) > greatest({a['y0']}, {b['y0']}) and ({a['x0']} in ({b['x0']}, {b['x1']}) or {a['x1']} in ({b['x0']}, {b['x1']})))"
    return {
        "meet": f"({meet})", "overlap": f"({overlap})", "a_covers": cover(a, b), "b_covers": cover(b, a), "a_contains": strict(a, b), "b_contains": strict(b, a), "stretch": f"(({meet}) and ({same_x} or {same_y}))",
    }


def _rect_matrix_sql(r: dict[str, str]) -> str:
    c = lambda test, d: f"case when {test} then '{d}' else 'F' end"
    bb = f"case when {r['stretch']} then '1' when {r['meet']} and not {r['a_contains']} and not {r['b_contains']} then '0' else 'F' end"
    apart = lambda x: f"not {r[x]}"
    rows = [
        c(r["overlap"], 2), c(f"{r['overlap']} and {apart('b_covers')}", 1), c(apart("b_covers"), 2),
        c(f"{r['overlap']} and {apart('a_covers')}", 1), bb, c(apart("b_covers"), 1), c(apart("a_covers"), 2), c(apart("a_covers"), 1), "'2'",
    ]
    return " || ".join(f"({x})" for x in rows)


_QUERY_SIDES = dict(zip(("x0", "y0", "x1", "y1"), (str(v) for v in BOX), strict=True))
_BOX_SIDES = dict(zip(("x0", "y0", "x1", "y1"), query.BBOX, strict=True))
_TO_BOX = _rect_sql(_QUERY_SIDES, _BOX_SIDES)
_POLYGON_MODES = {
    "Intersects": "meet", "Disjoint": "not meet", "Touches": "meet and not overlap", "Contains": "a_contains", "Covers": "a_covers and overlap", "Overlaps": "overlap and not a_covers and not b_covers",
    "T*T***T**": "overlap and not a_covers and not b_covers", "F***T****": "meet and not overlap",
}


def _mode_sql(text: str) -> str:
    import re

    return re.sub(r"\b(meet|overlap|a_covers|b_covers|a_contains)\b", lambda m: _TO_BOX[m[0]], text)


@register((B,), " union all ".join(f"select '{m}' as mode, fid from fx_boxes where {_mode_sql(s)}" for m, s in _POLYGON_MODES.items()))
def polygon_query_modes(b):
    """Polygons against the query's rectangle in several modes and patterns, exactly."""
    f = b.select("fid", *query.BBOX, F.lit(geometry.POLYGON).alias("gtype"), geometry.rect_parts(Rect.of()).alias("parts"))
    one = lambda m: query.query(f, query.QueryDef(fields=[], mode=m, box=BOX)).select(F.lit(m).alias("mode"), "fid")
    first, *rest = (one(m) for m in _POLYGON_MODES)
    for r in rest:
        first = first.unionByName(r)
    return first


@register((B,), f"select fid, {_rect_matrix_sql(_TO_BOX)} as matrix from fx_boxes")
def rect_rect_de9im(b):
    return b.select("fid", query.rect_matrix(lit(BOX), Rect.of()).alias("matrix"))


@register(
    (P, V),
    f"""with {_SEG} select fid, 'line' as layer from seg where x2 is not null group by fid
 having bool_or(least(x1, x2) <= 40 and greatest(x1, x2) >= -40 and least(y1, y2) <= 30 and greatest(y1, y2) >= -30 and {{sides}})
 union all select fid, 'point' from fx_points where x >= -40 and x <= 40 and y >= -30 and y <= 30""".format(
        sides=" and ".join(
            f"{f}({', '.join(_sides('x1', 'y1', 'x2', 'y2', a, c) for a, c in ((-40, -30), (40, -30), (40, 30), (-40, 30)))}) {op} 0" for f, op in (("least", "<="), ("greatest", ">="))
        )
    ),
)
def geometry_query(p, v):
    """A polygon as the query object, on lines and on points."""
    shape = query.rect_shape((-40.0, -30.0, 40.0, 30.0))
    lines = geometry.with_bounds(geometry.from_vertices(v, geometry.POLYLINE))
    one = lambda df, n: query.query(df, query.QueryDef(fields=[], shape=shape)).select("fid", F.lit(n).alias("layer"))
    return one(lines, "line").unionByName(one(p, "point"))


@register((V,), "select fid, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_vertices group by fid")
def line_bounds(v):
    return geometry.from_vertices(v, geometry.POLYLINE).select("fid", geometry.bounds(F.col("parts")).alias("b")).select("fid", "b.*")


@register((V,), "select fid, seq, x, y from fx_vertices")
def polyline_to_points(v):
    return geometry.explode_vertices(geometry.from_vertices(v, geometry.POLYLINE))


@register(
    (V,),
    """with t as (select fid, seq, lag(x) over w as ax, lag(y) over w as ay, x, y, lead(x) over w as bx, lead(y) over w as b_y from fx_vertices window w as (partition by fid order by seq))
 select fid, seq, round(degrees(acos(greatest(-1, least(1, ((ax - x) * (bx - x) + (ay - y) * (b_y - y)) / sqrt(((ax - x) * (ax - x) + (ay - y) * (ay - y)) * ((bx - x) * (bx - x) + (b_y - y) * (b_y - y))))))), 3) as angle
 from t where ax is not null and bx is not null""",
)
def vertex_angle(v):
    w = Window.partitionBy("fid").orderBy("seq")
    t = v.select("fid", "seq", "x", "y", *(f(c).over(w).alias(n) for f, c, n in ((F.lag, "x", "ax"), (F.lag, "y", "ay"), (F.lead, "x", "bx"), (F.lead, "y", "b_y"))))
    t = t.where("ax is not null and bx is not null")
    return t.select("fid", "seq", F.round(angle(*(F.col(c) for c in ("ax", "ay", "x", "y", "bx", "b_y"))), 3).alias("angle"))


# --- tiles, themes, rasters ---------------------------------------------------------------


@register(
    (P,),
    """with l as (select 2 as level union all select 4) select level, cast(floor((x + 180) / (180e0 / pow(2e0, level))) as int) as col,
 cast(floor((90 - y) / (180e0 / pow(2e0, level))) as int) as row, count(*) as features from fx_points cross join l group by 1, 2, 3""".replace(" as row", ' as "row"'),
)
def tile_assign(p):
    return tiles.assign_points(p, [2, 4])


_TILES = """t as (select 3 as level, a.i as col, b.i as r from unnest(range(0, 16)) a(i), unnest(range(0, 8)) b(i))"""


@register(
    ("region",),
    f"""with {_TILES} select level, cast(col as int) as col, cast(r as int) as row_no, -180 + col * 22.5e0 as minx, 90 - (r + 1) * 22.5e0 as miny, -180 + (col + 1) * 22.5e0 as maxx, 90 - r * 22.5e0 as maxy from t""",
)
def tile_bbox(region):
    t = region.sparkSession.range(128).select(F.lit(3).alias("level"), (F.col("id") % 16).cast("int").alias("col"), F.floor(F.col("id") / 16).cast("int").alias("row_no"))
    b = tiles.tile_bounds(F.col("level"), F.col("col"), F.col("row_no"))
    return t.select("*", b.minx.alias("minx"), b.miny.alias("miny"), b.maxx.alias("maxx"), b.maxy.alias("maxy"))


@register(
    (B,),
    """select fid, cast(floor((minx + 180) / 22.5e0) as int) as col0, cast(floor((90 - maxy) / 22.5e0) as int) as row0,
 cast(ceil((maxx + 180) / 22.5e0) as int) as col1, cast(ceil((90 - miny) / 22.5e0) as int) as row1 from fx_boxes""",
)
def tile_ranges(b):
    names = ("col0", "row0", "col1", "row1")
    return b.select("fid", *(c.alias(n) for n, c in zip(names, tiles.tile_range(Rect.of(), F.lit(3)), strict=True)))


@register(
    (B,),
    """with recursive e as (select max(maxx) - min(minx) + max(maxy) - min(miny) as size, count(*) as n from fx_boxes),
 low as (select min(l) as low from unnest(range(0, 60)) t(l), e where size >= 180 / pow(2e0, l)),
 down as (select n, 0 as steps from e union all select n // 4, steps + 1 from down where n > 10)
 select cast(l as int) as level, 360e0 / pow(2e0, l) / 256 as degrees from unnest(range(0, 99)) t(l), low where l between low and low + (select max(steps) from down)""",
)
def tile_levels(b):
    """Levels of use for a layer, from its extent and count, with their resolutions."""
    e = b.agg(*_bounds(), F.count(F.lit(1)).alias("n")).first()
    low, high = tiles.useful_levels((e["minx"], e["miny"], e["maxx"], e["maxy"]), e["n"])
    df = b.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("level"))
    return df.select("level", tiles.degrees_per_pixel(F.col("level")).alias("degrees"))


@register(
    (P,),
    """select distinct '4/' || cast(cast(floor((x + 180) / 11.25e0) as int) as varchar) || '/' || cast(cast(floor((90 - y) / 11.25e0) as int) as varchar) as key from fx_points""",
)
def tile_key(p):
    col, row = tiles.tile_of_point(F.col("x"), F.col("y"), F.lit(4))
    return p.select(tiles.tile_key(F.lit(4), col, row).alias("key")).distinct()


@register((P,), "select fid, (x - 0) * 2 + 360 as px, 180 - (y - 0) * 2 as py from fx_points")
def pixel_transform(p):
    px, py = tiles.view(WORLD, 720, 360, F.col("x"), F.col("y"))
    return p.select("fid", px.alias("px"), py.alias("py"))


@register(
    (P,),
    """select fid, cast(least(9, floor((fid % 1000) * 10 / 1000e0)) as int) as class_no, cast(cast(floor((fid % 1000) * 10 / 1000e0) as bigint) * 100 as varchar) || '-' ||
 cast((cast(floor((fid % 1000) * 10 / 1000e0) as bigint) + 1) * 100 as varchar) as label from fx_points""",
)
def range_theme(p):
    k, label = themes.equal_ranges(F.col("fid") % 1000, 1000)
    return p.select("fid", k.alias("class_no"), label.alias("label"))


@register((P,), "select p.fid, s.style from fx_points p left join (values ('O', '#ff0000ff'), ('F', '#00ff00ff')) s(kind, style) on p.kind = s.kind")
def unique_theme(p):
    styles = p.sparkSession.createDataFrame([("O", "#ff0000ff"), ("F", "#00ff00ff")], "kind string, style string")
    return p.join(F.broadcast(styles), "kind", "left").select("fid", "style")


@register(
    (P,),
    """select fid, '#' || lpad(printf('%x', cast(floor(0 + (fid % 64) / 64e0 * 255) as int)), 2, '0') || '40' || lpad(printf('%x', cast(floor(255 + (fid % 64) / 64e0 * -255) as int)), 2, '0') || 'ff' as color from fx_points""",
)
def color_ramp(p):
    c = themes.ramp(F.col("fid") % 64, F.lit(0.0), F.lit(64.0), (0, 64, 255, 255), (255, 64, 0, 255))
    return p.select("fid", themes.color_hex(*c).alias("color"))


@register(
    (A,),
    """with l as (select lvl, max(res) as res from fx_rasters group by lvl), pick as (select lvl from l where res < 0.01e0 order by res desc limit 1)
 select fid, lvl from fx_rasters where lvl = (select lvl from pick) and minx < 60 and maxx > -20 and miny < 40 and maxy > -20""",
)
def raster_level_pick(a):
    return themes.raster_pick(a, BOX, 8000, 6000).select("fid", "lvl")


@register(
    (A,),
    """select fid, cast(floor((greatest(minx, -20) - minx) * (1024 / (maxx - minx)) + 0.5e0) as int) as sx, cast(floor((maxy - least(maxy, 40)) * (1024 / (maxy - miny)) + 0.5e0) as int) as sy,
 cast(floor((least(maxx, 60) - greatest(minx, -20)) * (1024 / (maxx - minx)) + 0.5e0) as int) as sw, cast(floor((least(maxy, 40) - greatest(miny, -20)) * (1024 / (maxy - miny)) + 0.5e0) as int) as sh
 from fx_rasters where minx < 60 and maxx > -20 and miny < 40 and maxy > -20""",
)
def raster_window(a):
    df = a.where(Rect.of().overlaps(lit(BOX)))
    return df.select("fid", *(c.alias(n) for n, c in zip(("sx", "sy", "sw", "sh"), themes.raster_window(BOX), strict=True)))


@register(
    (A,),
    """select fid, cast(f as int) as factor, cast(regexp_extract('Ovr_L' || cast(lvl as varchar) || '_0x0.tif', '_L(\\d+)_', 1) as int) as level from fx_rasters,
 unnest([2, 4, 8, 16, 32, 64, 128, 256]) t(f) where fid * 16 / cast(f as double) > 256""",
)
def overview_factors(a):
    df = a.select("fid", "lvl", F.explode(F.slice(themes.overview_factors(F.col("fid") * 16), 1, 8)).alias("factor"))
    name = F.concat(F.lit("Ovr_L"), F.col("lvl").cast("string"), F.lit("_0x0.tif"))
    return df.select("fid", "factor", F.regexp_extract(name, r"_L(\d+)_", 1).cast("int").alias("level"))


_PATH = "'/data/' || c_mktsegment || '/' || c_name || '.shp'"


@register(
    ("customer",),
    f"""select c_custkey as fid, regexp_extract({_PATH}, '([^/]*)\\.[^./]*$', 1) as title, regexp_extract({_PATH}, '\\.([^./]*)$', 1) as ext,
 '/data/' || c_mktsegment || '/' || c_name || '.gmp' as changed, '../' || c_mktsegment || '/' || c_name || '.shp' as rel, {_PATH} as back from customer""",
)
def file_title_ext(c):
    path = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), "c_name", F.lit(".shp"))
    rel = paths.relative(F.lit("/data/maps/all.gmp"), path)
    return c.select(
        F.col("c_custkey").alias("fid"), paths.title(path).alias("title"), paths.extension(path).alias("ext"), paths.with_extension(path, "gmp").alias("changed"),
        rel.alias("rel"), paths.absolute(F.lit("/data/maps/all.gmp"), rel).alias("back"),
    )


@register(
    (P,),
    """with q as (select fid, cast(floor((x + 180) / 45) as int) as c3, cast(floor((y + 90) / 22.5e0) as int) as r3 from fx_points), n3 as (select c3, r3, count(*) as n from q group by all),
 n2 as (select c3 // 2 as c2, r3 // 2 as r2, sum(n) as n from n3 group by all), n1 as (select c2 // 2 as c1, r2 // 2 as r1, sum(n) as n from n2 group by all)
 select case when n1.n <= 400 then 1 when n2.n <= 400 then 2 else 3 end as depth, count(*) as features from q
 join n2 on c2 = c3 // 2 and r2 = r3 // 2 join n1 on c1 = c3 // 4 and r1 = r3 // 4 where (select count(*) from q) > 400 group by 1""",
)
def adaptive_quadtree(p):
    """Leaves that are split only where they hold more than their capacity."""
    leaves = index.quadtree_leaves(p.select("fid", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy")), WORLD, capacity=400, depth=3)
    return leaves.groupBy(F.length("leaf").alias("depth")).agg(F.count(F.lit(1)).alias("features"))


@register((B,), f"select 'xzorder' as kind, code, count(*) as n from (select {_sql_code('xz', 1)} as code from fx_boxes) t group by code")
def index_choice(b):
    """The code index of a table at the level that its count asks for."""
    kind, level, coded_ = index.with_index(b, WORLD, "xzorder", rows=5000)
    assert level == 1
    return coded_.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "code", "n")


@register((P,), "select fid, cast(floor(x + 0.5e0) as bigint) as rx, cast(abs(floor(y + 0.5e0)) as bigint) as ay, cast(kind = 'O' as int) as is_open from fx_points")
def round_half_up(p):
    up = lambda c: F.floor(F.col(c) + 0.5)
    return p.select("fid", up("x").cast("bigint").alias("rx"), F.abs(up("y")).cast("bigint").alias("ay"), (F.col("kind") == "O").cast("int").alias("is_open"))


@register(
    (P,),
    """select fid, round(radians(x) * 6378137, 2) as mx, round(ln(tan(radians(y) / 2 + pi() / 4)) * 6378137, 2) as my from fx_points where y > -85 and y < 85""",
)
def crs_4326_3857(p):
    mx, my = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    return p.where("y > -85 and y < 85").select("fid", F.round(mx, 2).alias("mx"), F.round(my, 2).alias("my"))


@register(
    (P, B),
    f"""select 'points' as layer, fid from fx_points where {_in(BOX)} union all select 'boxes', fid from fx_boxes where {_meet(BOX)}""",
)
def map_layers_union(p, b):
    one = lambda df, n: query.query(df, query.QueryDef(box=BOX)).select(F.lit(n).alias("layer"), "fid")
    return one(p, "points").unionByName(one(b, "boxes"))


@register((P,), "select fid, lpad(printf('%x', fid), 16, '0') as big, cast(case when fid % 7 + fid % 5 + fid % 3 = 0 then 0 else 255 end as int) as alpha from fx_points")
def byte_casts(p):
    return p.select("fid", F.lower(F.lpad(F.hex("fid"), 16, "0")).alias("big"), themes.alpha_mask(F.col("fid") % 7, F.col("fid") % 5, F.col("fid") % 3).alias("alpha"))


@register(("part",), "select cast(case when p_size % 9 in (1, 4) then 1 when p_size % 9 in (2, 5) then 5 when p_size % 9 in (3, 6) then 3 end as int) as gtype, count(*) as n from part group by 1")
def geometry_type_map(part):
    """Stored type codes to geometry types."""
    from ..sources.spatialite import geometry_type

    return part.groupBy(geometry_type(F.col("p_size") % 9).alias("gtype")).agg(F.count(F.lit(1)).alias("n"))


@register(("events",), """select event_id, json_extract_string(props, '$.k') as k, coalesce(json_extract_string(props, '$.none'), 'missing') as none_key from events""")
def json_path(e):
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("missing")).alias("none_key"))


# --- codecs, exact relations and files: told by round trips, no SQL form ------------------


_COORDS = "string_agg(cast(cast(x * 64 as bigint) as varchar) || ' ' || cast(cast(y * 64 as bigint) as varchar), ',' order by seq)"


def _coords(parts):
    """Coordinates in 64ths, as text."""
    text = lambda c: F.round(c * 64).cast("bigint").cast("string")
    return F.array_join(F.transform(geometry.vertices(parts), lambda p: F.concat(text(p["x"]), F.lit(" "), text(p["y"]))), ",")


@register((R,), f"select fid, {_COORDS} as coords, 9 + 4 + 16 * count(*) as bytes from fx_rings group by fid")
def wkb_roundtrip(r):
    from ..functions.codec import parts_of_wkb, wkb_of

    f = geometry.from_vertices(r, geometry.POLYGON).withColumn("wkb", wkb_of("gtype", "parts"))
    return f.select("fid", _coords(parts_of_wkb("wkb")).alias("coords"), F.octet_length("wkb").cast("bigint").alias("bytes"))


@register((V,), f"select fid, {_COORDS} as coords, 39 + 4 + 4 + 16 * count(*) + 1 as bytes from fx_vertices group by fid")
def gaia_roundtrip(v):
    from ..functions.codec import gaia_of, parts_of_gaia

    f = geometry.from_vertices(v, geometry.POLYLINE).withColumn("gaia", gaia_of("gtype", "parts", F.lit(4326)))
    return f.select("fid", _coords(parts_of_gaia("gaia")).alias("coords"), F.octet_length("gaia").cast("bigint").alias("bytes"))


def _keeps(k: int, last: str) -> str:
    """Whether vertex k of a line is kept after the last kept one: farther than 90 degrees, or an angle under 60."""
    ax, ay = f"({last}x - x{k})", f"({last}y - y{k})"
    bx, by = f"(x{k + 1} - x{k})", f"(y{k + 1} - y{k})"
    return f"({ax} * {ax} + {ay} * {ay} > 8100 or {ax} * {bx} + {ay} * {by} > 0.5e0 * sqrt(({ax} * {ax} + {ay} * {ay}) * ({bx} * {bx} + {by} * {by})))"


@register(
    (V,),
    f"""with p as (select fid, {", ".join(f"max(case when seq = {k} then {c} end) as {c}{k}" for k in range(5) for c in "xy")} from fx_vertices group by fid),
 a as (select *, {_keeps(1, "p0.").replace("p0.x", "x0").replace("p0.y", "y0")} as k1 from p), b as (select *, case when k1 then x1 else x0 end as l1x, case when k1 then y1 else y0 end as l1y from a),
 c as (select *, {_keeps(2, "l1")} as k2 from b), d as (select *, case when k2 then x2 else l1x end as l2x, case when k2 then y2 else l1y end as l2y from c),
 e as (select *, {_keeps(3, "l2")} as k3 from d) select fid, cast(2 + k1::int + k2::int + k3::int as int) as vertices from e""",
)
def line_thin(v):
    f = geometry.from_vertices(v, geometry.POLYLINE)
    return tiles.thinned(f, 8100.0, 60.0).select("fid", geometry.point_count(F.col("parts")).alias("vertices"))


@register(
    (B,),
    f"""with n as (select * from fx_boxes) select a.fid as a, b.fid as b, {_rect_matrix_sql(_rect_sql(*({k: f"{s}.{c}" for k, c in _BOX_SIDES.items()} for s in "ab")))} as matrix
 from n a join n b on a.fid < b.fid and a.minx <= b.maxx and b.minx <= a.maxx and a.miny <= b.maxy and b.miny <= a.maxy""",
)
def de9im_polygons(b):
    """Polygons whose boxes meet, with their matrices; the box test is a join of its own before the Arrow function."""
    from ..operators.relate import matrix_of

    parts = lambda p: geometry.rect_parts(Rect.of(f"{p}_"))
    pairs = join.boxes_meet(b, b, carry=True, once=True)
    return pairs.select("a", "b", matrix_of(F.lit(geometry.POLYGON), parts("a"), F.lit(geometry.POLYGON), parts("b")).alias("matrix"))


@register((P,))
def mvt_tiles(p):
    t = tiles.point_tiles(p, 2)
    return t.select("level", "col", F.col("row").alias("row_no"), F.length("data").cast("bigint").alias("bytes"), F.sha2("data", 256).alias("digest"))


def shapefile_bytes(lines: list[tuple[int, list[tuple[float, float]]]], attributes: list[tuple]) -> dict[str, bytes]:
    """.shp, .shx and .dbf of polylines with attributes NAME, POP, AREA, DAY, OK."""
    records, index, at = b"", b"", 50
    for i, pts in lines:
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        body = struct.pack("<i4d2i", 3, min(xs), min(ys), max(xs), max(ys), 1, len(pts)) + struct.pack("<i", 0) + struct.pack(f"<{2 * len(pts)}d", *(v for p in pts for v in p))
        records += struct.pack(">2i", i + 1, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 3, -180, -90, 180, 90, 0, 0, 0, 0)
    fields = [("NAME", b"C", 24, 0), ("POP", b"N", 12, 0), ("AREA", b"N", 12, 2), ("DAY", b"D", 8, 0), ("OK", b"L", 1, 0)]
    size = 1 + sum(f[2] for f in fields)
    dbf = struct.pack("<4BIHH20x", 3, 120, 1, 1, len(lines), 32 + 32 * len(fields) + 1, size)
    for n, t, ln, d in fields:
        dbf += n.encode().ljust(11, b"\0") + t + b"\0" * 4 + bytes([ln, d]) + b"\0" * 14
    dbf += b"\r"
    for name, pop, area, day, ok in attributes:
        dbf += b" " + name.encode().ljust(24)[:24] + f"{pop:12d}".encode() + f"{area:12.2f}".encode() + (day or " " * 8).encode() + (b"?" if ok is None else b"T" if ok else b"F")
    return {"shp": head(at) + records, "shx": head(50 + 4 * len(lines)) + index, "dbf": dbf + b"\x1a"}


def sample_shapefile(folder: str) -> str:
    """A small polyline shapefile with attributes; gives its path."""
    path = os.path.join(folder, "lines.shp")
    lines = [(i, [(float(i), 0.0), (i + 0.5, 1.0), (i + 1.0, 0.0)]) for i in range(20)]
    for kind, data in shapefile_bytes(lines, [(f"line{i}", i * 10, i / 4, "20200102", bool(i % 2)) for i in range(20)]).items():
        with open(f"{path[:-3]}{kind}", "wb") as f:
            f.write(data)
    return path


def _table_folder(spark: SparkSession) -> str:
    """A folder of its own for files made from a table: the shared one where there is one."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{root.rstrip('/')}/strataframe-{uuid.uuid4().hex}"


@register(
    (V,),
    """select fid, cast(5 as int) as gtype, count(*) as vertices, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from fx_vertices where fid <= 200 group by fid""",
)
def shp_folder_scan(v):
    """A table written as shapefiles of fifty lines each, then read as a folder."""
    from ..sources import files
    from ..sources.shapefile import read_folder

    spark = v.sparkSession
    folder = _table_folder(spark)
    held: dict[int, list] = {}
    for r in v.where("fid <= 200").orderBy("fid", "seq").collect():  # a fixture of 200 lines
        held.setdefault(r["fid"], []).append((r["x"], r["y"]))
    ids = sorted(held)
    for at in range(0, len(ids), 50):
        part = [(fid, held[fid]) for fid in ids[at : at + 50]]
        made = shapefile_bytes(part, [("", 0, 0.0, None, None)] * len(part))
        for kind in ("shp", "shx"):
            files.put(spark, f"{folder}/part{at:05d}.{kind}", made[kind])
    found = read_folder(spark, folder)
    first = F.regexp_extract("file", r"part(\d+)$", 1).cast("bigint")
    return found.select((first + F.col("fid") + min(ids, default=0)).alias("fid"), "gtype", geometry.point_count(F.col("parts")).cast("bigint").alias("vertices"), "minx", "miny", "maxx", "maxy")


@register(
    ("customer",),
    """select c_custkey as fid, cast(5 as int) as gtype, cast(c_custkey % 360 - 180 as double) as minx, c_name as name, cast(c_nationkey as bigint) as pop, round(c_acctbal, 2) as area,
 case when c_custkey % 3 = 0 then null else date '2020-01-02' end as day_, case when c_custkey % 5 = 0 then null else c_custkey % 2 = 1 end as ok from customer where c_custkey <= 300""",
)
def shp_scan(c):
    """A table written as a shapefile with its attributes, then read by runs of records. Reader and writer share this machine's folder."""
    from ..sources.shapefile import ShapefileSource

    spark = c.sparkSession
    spark.dataSource.register(ShapefileSource)
    rows = c.where("c_custkey <= 300").orderBy("c_custkey").collect()  # a fixture of 300 rows
    lines = [(r["c_custkey"], [(float(r["c_custkey"] % 360 - 180), 0.0), (r["c_custkey"] % 360 - 179.0, 1.0)]) for r in rows]
    made = shapefile_bytes(lines, [(r["c_name"], r["c_nationkey"], r["c_acctbal"], None if r["c_custkey"] % 3 == 0 else "20200102", None if r["c_custkey"] % 5 == 0 else r["c_custkey"] % 2 == 1) for r in rows])
    path = _local_folder(spark)
    for kind, data in made.items():
        with open(f"{path}/t.{kind}", "wb") as f:
            f.write(data)
    df = spark.read.format("strata_shp").option("records", "70").load(f"{path}/t.shp")
    names = {"NAME": "name", "POP": "pop", "AREA": "area", "DAY": "day_", "OK": "ok"}
    return df.select("fid", "gtype", "minx", *(F.col(k).alias(v) for k, v in names.items()))


def _local_folder(spark: SparkSession) -> str:
    """A folder that the standard library reaches on each machine: the shared one, where it is a plain path."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root.removeprefix("file://") if root and (root.startswith("/") or root.startswith("file:///")) else None
    if root:
        os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(dir=root)


@register(("nation",), "select n_nationkey::bigint + 1 as fid, n_name as name, n_regionkey * 2e0 as x, n_regionkey + 0.5e0 as weight from nation")
def sqlite_scan(nation):
    """A table written to a SQLite store with its catalogue, then read by runs of row ids."""
    from ..sources.spatialite import SpatialiteSource, SqliteStore

    spark = nation.sparkSession
    spark.dataSource.register(SpatialiteSource)
    store = SqliteStore(os.path.join(_local_folder(spark), "store.sqlite"))
    name = store.create("nations", geometry.POINT, [("name", "string"), ("weight", "double")])
    rows = nation.orderBy("n_nationkey").collect()  # twenty-five rows
    store.write(name, [(r["n_nationkey"] + 1, geometry.POINT, [[[(r["n_regionkey"] * 2.0, 1.0)]]], r["n_name"], r["n_regionkey"] + 0.5) for r in rows])
    df = spark.read.format("strata_sqlite").option("table", name).option("rows", "10").load(store.path)
    return df.select("fid", "name", F.col("minx").alias("x"), "weight")


@register((B,), "select fid, minx, maxy from fx_boxes where minx <= 60 and maxx >= -20 and miny <= 40 and maxy >= -20")
def key_store_scan(b):
    """A table kept in the order of cell code and id, then a box read as ranges of codes."""
    from ..sources.stores import KeyStore

    spark = b.sparkSession
    store = KeyStore(spark, _table_folder(spark))
    store.create("boxes", geometry.POLYGON, WORLD, LEVEL)
    store.write("boxes", b.select("fid", F.lit(geometry.POLYGON).alias("gtype"), geometry.rect_parts(Rect.of()).alias("parts")))
    return store.scan("boxes", BOX).select("fid", "minx", "maxy")


@register((P,), "select fid, x from fx_points where x >= -180 and x <= 60 and y >= -20 and y <= 40 and fid > 1000 order by fid limit 200")
def point_index_search(p):
    """A page of documents in a box that reaches over the world's bounds."""
    from ..sources.stores import PointIndex

    store = PointIndex(p.sparkSession, _table_folder(p.sparkSession))
    store.create("points")
    store.write("points", p)
    return store.search("points", (-400.0, -20.0, 60.0, 40.0), 1000, 200).select(F.col("gid").alias("fid"), F.col("location.lon").alias("x"))


@register((A,), "select lvl, cast(count(*) as int) as files, min(minx) as minx, max(maxy) as maxy, max(res) as res from fx_rasters where fid <= 400 group by lvl")
def mosaic_catalog(a):
    """A raster catalogue saved as JSON and opened again."""
    from ..sources import catalogs

    spark = a.sparkSession
    path = f"{_table_folder(spark)}/all.gmr"
    named = a.where("fid <= 400").withColumn("file", F.concat(F.lit(f"{path[:-8]}/img"), F.col("fid"), F.lit(".tif")))
    catalogs.save_mosaic(named, path)
    return catalogs.open_mosaic(spark, path).groupBy("lvl").agg(F.count("file").cast("int").alias("files"), F.min("minx").alias("minx"), F.max("maxy").alias("maxy"), F.max("res").alias("res"))


@register((V,), "select fid, cast(5 as int) as gtype from fx_vertices group by fid")
def pyramid_roundtrip(v):
    """Levels of detail saved in chunks; the finest is read back whole."""
    f = geometry.from_vertices(v, geometry.POLYLINE)
    path = _table_folder(v.sparkSession)
    tiles.save_pyramid(f, [0, 6], path, chunk=500)
    return tiles.load_pyramid(v.sparkSession, path, 9).select("fid", "gtype")
