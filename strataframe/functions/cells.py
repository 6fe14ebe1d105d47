"""Cell codes: grid, Z-order, XZ-order, quadtree keys and geohash, as Columns with plain twins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rect import Rect

#: Digits of geohash (fixed value).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
MAX_LEVEL = 15


def zorder_level(n: int) -> int:
    """Level for n features, about 1000 a cell."""
    return 0 if n <= 1000 else max(0, min(MAX_LEVEL, int(math.log(n / 1000) / 2) + 1))


def cells_before(level: int) -> int:
    """Cells of all coarser levels: the first code of a level."""
    return (4**level - 1) // 3


def code_count(level: int) -> int:
    return cells_before(level + 1)


def grid_side(area: float, n: int) -> float:
    """Side of a grid cell for n features over an area, about 5000 a cell."""
    return math.sqrt(area / (n // 5000 + 1))


def _cell(v: Column, low: float, side: float, last: int, upper: bool) -> Column:
    q = (v - F.lit(low)) / F.lit(side)
    c = (F.ceil(q) - 1) if upper else F.floor(q)
    return F.greatest(F.lit(0), F.least(F.lit(last), c)).cast("int")


def cell_range(r: Rect, extent: tuple[float, float, float, float], level: int) -> tuple[Column, Column, Column, Column]:
    """First and last column and row of the level's cells that a rectangle meets; an upper edge on a line belongs below it."""
    n = 1 << level
    w, h = (extent[2] - extent[0]) / n, (extent[3] - extent[1]) / n
    c0, r0 = _cell(r.minx, extent[0], w, n - 1, False), _cell(r.miny, extent[1], h, n - 1, False)
    c1, r1 = _cell(r.maxx, extent[0], w, n - 1, True), _cell(r.maxy, extent[1], h, n - 1, True)
    return c0, r0, F.greatest(c0, c1), F.greatest(r0, r1)


def interleave(x: Column, y: Column, bits: int) -> Column:
    out = F.lit(0)
    for b in range(bits):
        out = out + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), 2 * b + 1) + F.shiftleft(F.shiftright(y, b).bitwiseAND(F.lit(1)), 2 * b)
    return out.cast("int")


def zorder_code(r: Rect, extent: tuple[float, float, float, float], level: int) -> Column:
    """Code of the deepest cell, at most at ``level``, that covers the rectangle."""
    out = F.lit(0)
    for lv in range(1, level + 1):
        c0, r0, c1, r1 = cell_range(r, extent, lv)
        out = F.when((c0 == c1) & (r0 == r1), interleave(c0, r0, lv) + cells_before(lv)).otherwise(out)
    return out.cast("int")


def xzorder_code(r: Rect, extent: tuple[float, float, float, float], level: int) -> Column:
    """Code of the lower left cell of the finest level at which the rectangle spans at most two cells each way."""
    out = F.lit(0)
    for lv in range(1, level + 1):
        c0, r0, c1, r1 = cell_range(r, extent, lv)
        out = F.when((c1 - c0 <= 1) & (r1 - r0 <= 1), interleave(c0, r0, lv) + cells_before(lv)).otherwise(out)
    return out.cast("int")


def _plain_range(box, extent, level: int) -> tuple[int, int, int, int]:
    n = 1 << level
    w, h = (extent[2] - extent[0]) / n or 1.0, (extent[3] - extent[1]) / n or 1.0
    held = lambda v: max(0, min(n - 1, v))
    c0, r0 = held(math.floor((box[0] - extent[0]) / w)), held(math.floor((box[1] - extent[1]) / h))
    return c0, r0, max(c0, held(math.ceil((box[2] - extent[0]) / w) - 1)), max(r0, held(math.ceil((box[3] - extent[1]) / h) - 1))


def plain_zorder_code(box, extent, level: int) -> int:
    """The twin of zorder_code for one box."""
    for lv in range(level, 0, -1):
        c0, r0, c1, r1 = _plain_range(box, extent, lv)
        if c0 == c1 and r0 == r1:
            return cell_code(lv, c0, r0)
    return 0


def plain_xzorder_code(box, extent, level: int) -> int:
    """The twin of xzorder_code for one box."""
    for lv in range(level, 0, -1):
        c0, r0, c1, r1 = _plain_range(box, extent, lv)
        if c1 - c0 <= 1 and r1 - r0 <= 1:
            return cell_code(lv, c0, r0)
    return 0


def level_of(code: int) -> int:
    lv = 0
    while cells_before(lv + 1) <= code:
        lv += 1
    return lv


def code_cell(code: int) -> tuple[int, int, int]:
    """(level, column, row)."""
    lv = level_of(code)
    z = code - cells_before(lv)
    x = sum((z >> (2 * b + 1) & 1) << b for b in range(lv))
    y = sum((z >> (2 * b) & 1) << b for b in range(lv))
    return lv, x, y


def cell_code(lv: int, x: int, y: int) -> int:
    return cells_before(lv) + sum((x >> b & 1) << (2 * b + 1) | (y >> b & 1) << (2 * b) for b in range(lv))


def cell_bounds(code: int, extent: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    lv, x, y = code_cell(code)
    w, h = (extent[2] - extent[0]) / (1 << lv), (extent[3] - extent[1]) / (1 << lv)
    return extent[0] + x * w, extent[1] + y * h, extent[0] + (x + 1) * w, extent[1] + (y + 1) * h


def children(code: int) -> list[int]:
    lv, x, y = code_cell(code)
    return [cell_code(lv + 1, 2 * x + dx, 2 * y + dy) for dx in (0, 1) for dy in (0, 1)]


def _meet(a, b) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def zorder_query(box: tuple[float, float, float, float], extent: tuple[float, float, float, float], level: int) -> list[int]:
    """Codes of every cell, of all levels, that meets the box."""
    out, todo = [], [0]
    while todo:
        code = todo.pop()
        if code and not _meet(cell_bounds(code, extent), box):
            continue
        out.append(code)
        if level_of(code) < level:
            todo += children(code)
    return sorted(out)


def xzorder_query(box: tuple[float, float, float, float], extent: tuple[float, float, float, float], level: int) -> list[int]:
    """Codes whose doubled cell (the cell and its right and upper neighbours) may hold a feature that meets the box."""
    out = []
    for lv in range(level + 1):
        n = 1 << lv
        w, h = (extent[2] - extent[0]) / n, (extent[3] - extent[1]) / n
        lo = lambda v, e, s: max(0, min(n - 1, math.floor((v - e) / s)))
        hi = lambda v, e, s: max(0, min(n - 1, math.ceil((v - e) / s) - 1))
        c0, r0 = lo(box[0], extent[0], w), lo(box[1], extent[1], h)
        c1, r1 = max(c0, hi(box[2], extent[0], w)), max(r0, hi(box[3], extent[1], h))
        out += [cell_code(lv, x, y) for x in range(max(0, c0 - 1), c1 + 1) for y in range(max(0, r0 - 1), r1 + 1)]
    return sorted(out)


def ranges(codes: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive codes, ends included."""
    out: list[tuple[int, int]] = []
    for c in sorted(set(codes)):
        if out and c == out[-1][1] + 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def _spread(x: int, y: int, bits: int) -> int:
    return sum((x >> b & 1) << (2 * b + 1) | (y >> b & 1) << (2 * b) for b in range(bits))


def _z_ranges(level: int, x0: int, y0: int, x1: int, y1: int, limit: int) -> list[tuple[int, int]]:
    """Runs of Z-order numbers that hold all cells of a rectangle of cells: exact ones while at most ``limit`` squares are cut by its border, then whole squares."""
    out, todo, left = [], [(0, 0)], level  # squares of 2^left cells a side
    while todo:
        size, partial = 1 << left, []
        for x, y in todo:
            if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
                continue
            start = _spread(x, y, level)
            if (x >= x0 and y >= y0 and x + size - 1 <= x1 and y + size - 1 <= y1) or not left:
                out.append((start, start + size * size - 1))
            else:
                partial.append((x, y))
        if len(partial) > limit:
            out += [(s, s + size * size - 1) for s in (_spread(x, y, level) for x, y in partial)]
            break
        left -= 1
        half = 1 << left if left >= 0 else 0
        todo = [(x + dx, y + dy) for x, y in partial for dx in (0, half) for dy in (0, half)]
    return out


def _joined(runs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Runs in order, neighbours joined, then the smallest gaps closed until there are few enough: more codes, never fewer."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda k: (out[k][0] - out[k - 1][1], k))
        closed = set(gaps[: len(out) - most])
        few: list[tuple[int, int]] = []
        for k, (a, b) in enumerate(out):
            if k in closed:
                few[-1] = (few[-1][0], b)
            else:
                few.append((a, b))
        out = few
    return out


MAX_RANGES = 64


def zorder_ranges(box, extent, level: int, *, limit: int = 16, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Runs of codes that hold every cell, of all levels, that meets the box; made without listing cells. What reaches over the extent counts to its border cells."""
    out = []
    for lv in range(level + 1):
        n = 1 << lv
        w, h = (extent[2] - extent[0]) / n, (extent[3] - extent[1]) / n
        held = lambda v, n=n: max(0, min(n - 1, v))
        x0, y0 = held(math.ceil((box[0] - extent[0]) / w) - 1), held(math.ceil((box[1] - extent[1]) / h) - 1)
        x1, y1 = held(math.floor((box[2] - extent[0]) / w)), held(math.floor((box[3] - extent[1]) / h))
        out += [(cells_before(lv) + a, cells_before(lv) + b) for a, b in _z_ranges(lv, x0, y0, x1, y1, limit)]
    return _joined(out, most)


def xzorder_ranges(box, extent, level: int, *, limit: int = 16, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Runs of codes whose doubled cell may hold a feature that meets the box."""
    out = []
    for lv in range(level + 1):
        n = 1 << lv
        w, h = (extent[2] - extent[0]) / n, (extent[3] - extent[1]) / n
        held = lambda v, n=n: max(0, min(n - 1, v))
        x0, y0 = max(0, held(math.ceil((box[0] - extent[0]) / w) - 1) - 1), max(0, held(math.ceil((box[1] - extent[1]) / h) - 1) - 1)
        x1, y1 = held(math.floor((box[2] - extent[0]) / w)), held(math.floor((box[3] - extent[1]) / h))
        out += [(cells_before(lv) + a, cells_before(lv) + b) for a, b in _z_ranges(lv, x0, y0, x1, y1, limit)]
    return _joined(out, most)


def in_ranges(column: Column, runs: list[tuple[int, int]]) -> Column:
    """Membership in one of a few runs, each of which can be pushed to the scan."""
    out = F.lit(False)
    for a, b in runs:
        out = out | (column.between(a, b) if a != b else column == a)
    return out


def in_codes(column: Column, codes: list[int]) -> Column:
    """Membership in a list of codes."""
    return in_ranges(column, _joined([(c, c) for c in codes], MAX_RANGES)) & column.isin(codes)


def code_bounds(code: Column, extent: tuple[float, float, float, float], level: int) -> Rect:
    """Box of each cell code up to a level, as Columns."""
    lv = sum((F.when(code >= cells_before(k), 1).otherwise(0) for k in range(1, level + 1)), F.lit(0))
    n = F.pow(F.lit(2.0), lv)
    z = (code - ((n * n - 1) / 3)).cast("bigint")
    bits = lambda first: sum((F.shiftright(z, 2 * b + first).bitwiseAND(F.lit(1)) * (1 << b) for b in range(level)), F.lit(0))
    cx, cy, w, h = bits(1), bits(0), (extent[2] - extent[0]) / n, (extent[3] - extent[1]) / n
    return Rect(extent[0] + cx * w, extent[1] + cy * h, extent[0] + (cx + 1) * w, extent[1] + (cy + 1) * h)


def quad_key(r: Rect, extent: tuple[float, float, float, float], level: int) -> Column:
    """Path of quadrants, "1" bits for right and upper, down to the deepest cell that covers the rectangle."""
    out = F.lit("")
    for lv in range(1, level + 1):
        c0, r0, c1, r1 = cell_range(r, extent, lv)
        digit = lambda b, c=c0, q=r0: (F.shiftright(c, b).bitwiseAND(F.lit(1)) * 2 + F.shiftright(q, b).bitwiseAND(F.lit(1))).cast("string")
        out = F.when((c0 == c1) & (r0 == r1), F.concat(*(digit(b) for b in range(lv - 1, -1, -1)))).otherwise(out)
    return out


def geohash(x: Column, y: Column, precision: int) -> Column:
    """Base-32 code; a point on a middle line belongs to the lower half.

    A cell number is ceil(position * 2^bits) - 1, which puts a point on a line below it.
    """
    n = 5 * precision
    bx, by = (n + 1) // 2, n // 2
    last = lambda v, b: F.greatest(F.lit(0), F.least(F.lit((1 << b) - 1), F.ceil(v * (1 << b)) - 1)).cast("bigint")
    cx, cy = last((x + 180) / 360, bx), last((y + 90) / 180, by)
    digits = []
    for d in range(precision):
        v = F.lit(0)
        for k in range(5):
            bit = d * 5 + k
            source, width = (cx, bx) if bit % 2 == 0 else (cy, by)
            v = v * 2 + F.shiftright(source, width - 1 - bit // 2).bitwiseAND(F.lit(1).cast("bigint")).cast("int")
        digits.append(F.substring(F.lit(BASE32), v + 1, F.lit(1)))
    return F.concat(*digits)


def geohash_cell(code: Column, precision: int) -> tuple[Column, Column, Column, Column]:
    """Centre x and y, width and height of a code of the given precision."""
    n = 5 * precision
    bx, by = (n + 1) // 2, n // 2
    cx, cy = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for d in range(precision):
        v = F.instr(F.lit(BASE32), F.substring(code, d + 1, 1)) - 1
        for k in range(5):
            bit = F.shiftright(v, 4 - k).bitwiseAND(F.lit(1)).cast("bigint")
            if (d * 5 + k) % 2 == 0:
                cx = cx * 2 + bit
            else:
                cy = cy * 2 + bit
    w, h = 360 / (1 << bx), 180 / (1 << by)
    return (cx + 0.5) * F.lit(w) - 180, (cy + 0.5) * F.lit(h) - 90, F.lit(w), F.lit(h)


def geohash_precision(area: float, width: int, height: int) -> int:
    """Least precision with enough cells for a view of the given pixels over an area in square degrees."""
    p = 1
    while area * 120 * 90 / (width * height) * 32**p < 64800 and p < 12:
        p += 1
    return p
