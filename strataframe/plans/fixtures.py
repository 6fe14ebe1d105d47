"""Views with geometry derived from the base tables by integer arithmetic; the same text runs in Spark and in DuckDB.

Coordinates are multiples of 1/64, exact in binary floating point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_points": (
        "orders",
        "select o_orderkey as fid, cast((o_orderkey*7919) % 23040 as double)/64 - 180 as x,"
        " cast((o_custkey*104729 + o_orderkey*31) % 11520 as double)/64 - 90 as y, o_orderstatus as kind, o_totalprice as val from {t}",
    ),
    "fx_boxes": (
        "part",
        "select fid, minx, miny, minx + w as maxx, miny + h as maxy, kind from (select p_partkey as fid,"
        " cast((p_partkey*7919) % 20000 as double)/64 - 180 as minx, cast((p_partkey*104729) % 9000 as double)/64 - 90 as miny,"
        " cast(p_size as double)/8 as w, cast(51 - p_size as double)/8 as h, p_brand as kind from {t}) t",
    ),
    "fx_vertices": (
        "customer",
        "select fid, seq, cast((fid*7919 + seq*3571) % 23040 as double)/64 - 180 as x,"
        " cast((fid*104729 + seq*1787) % 11520 as double)/64 - 90 as y from (select c_custkey as fid, s.seq as seq from {t}"
        " cross join (select 0 as seq union all select 1 union all select 2 union all select 3 union all select 4) s) t",
    ),
    "fx_rings": (
        "supplier",
        "select s_suppkey as fid, o.seq as seq, cast((s_suppkey*7919) % 20000 as double)/64 - 180 + o.dx as x,"
        " cast((s_suppkey*104729) % 9000 as double)/64 - 90 + o.dy as y from {t} cross join (select 0 as seq, 0 as dx, 0 as dy"
        " union all select 1,8,0 union all select 2,8,4 union all select 3,4,4 union all select 4,4,8 union all select 5,0,8 union all select 6,0,0) o",
    ),
    "fx_rasters": (
        "part",
        "select lvl, fid, minx, miny, minx + w as maxx, miny + w as maxy, w/1024 as res from ("
        " select cast(p_partkey % 4 as int) as lvl, p_partkey as fid, cast((p_partkey*7919) % 20000 as double)/64 - 180 as minx,"
        " cast((p_partkey*104729) % 9000 as double)/64 - 90 as miny,"
        " cast(case p_partkey % 4 when 0 then 1 when 1 then 4 when 2 then 16 else 64 end as double) as w from {t}) t",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, sql = VIEWS[name]
    return spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def cte(*names: str) -> str:
    """The with clause of the views, over the registered base tables."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n][1].format(t=VIEWS[n][0])})" for n in names) + " "
