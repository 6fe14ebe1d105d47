"""Rectangle algebra as Column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of the "covers point" test.
TOLERANCE = 1e-9


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Rect:
    minx: Column
    miny: Column
    maxx: Column
    maxy: Column

    @staticmethod
    def of(prefix: str = "") -> Rect:
        """From columns minx, miny, maxx, maxy, with a prefix such as "a." or "q_"."""
        return Rect(*(F.col(f"{prefix}{c}") for c in ("minx", "miny", "maxx", "maxy")))

    @staticmethod
    def lit(minx: float, miny: float, maxx: float, maxy: float) -> Rect:
        return Rect(*(F.lit(float(v)) for v in (minx, miny, maxx, maxy)))

    @staticmethod
    def empty() -> Rect:
        """The start of a union: not valid, and any rectangle joined to it comes out unchanged."""
        big = 1.7976931348623157e308
        return Rect.lit(big, big, -big, -big)

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self.columns(), ("minx", "miny", "maxx", "maxy"), strict=True)))

    def columns(self) -> tuple[Column, Column, Column, Column]:
        return self.minx, self.miny, self.maxx, self.maxy

    def is_valid(self) -> Column:
        return (self.maxx > self.minx) & (self.maxy > self.miny)

    def width(self) -> Column:
        return self.maxx - self.minx

    def height(self) -> Column:
        return self.maxy - self.miny

    def area(self) -> Column:
        return self.width() * self.height()

    def center(self) -> tuple[Column, Column]:
        return (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2

    def union(self, o: Rect) -> Rect:
        return Rect(F.least(self.minx, o.minx), F.least(self.miny, o.miny), F.greatest(self.maxx, o.maxx), F.greatest(self.maxy, o.maxy))

    def intersection(self, o: Rect) -> Rect:
        """May be invalid: is_valid() is false where the two only touch or are apart."""
        return Rect(F.greatest(self.minx, o.minx), F.greatest(self.miny, o.miny), F.least(self.maxx, o.maxx), F.least(self.maxy, o.maxy))

    def offset(self, dx, dy) -> Rect:
        return Rect(self.minx + _col(dx), self.miny + _col(dy), self.maxx + _col(dx), self.maxy + _col(dy))

    def extend(self, d) -> Rect:
        return Rect(self.minx - _col(d), self.miny - _col(d), self.maxx + _col(d), self.maxy + _col(d))

    def scale(self, ratio) -> Rect:
        cx, cy = self.center()
        hw, hh = self.width() * _col(ratio) / 2, self.height() * _col(ratio) / 2
        return Rect(cx - hw, cy - hh, cx + hw, cy + hh)

    def quadrant(self, right: Column, upper: Column) -> Rect:
        cx, cy = self.center()
        return Rect(
            F.when(right, cx).otherwise(self.minx),
            F.when(upper, cy).otherwise(self.miny),
            F.when(right, self.maxx).otherwise(cx),
            F.when(upper, self.maxy).otherwise(cy),
        )

    def split_xy(self, x, y) -> Column:
        """Array of (part, rect): none if neither line cuts, left/right or up/down if one does, LU LD RU RD if both do."""
        x, y = _col(x), _col(y)
        cut_x, cut_y = (self.minx < x) & (x < self.maxx), (self.miny < y) & (y < self.maxy)

        def part(name: str, *r: Column) -> Column:
            return F.struct(F.lit(name).alias("part"), *(c.alias(n) for c, n in zip(r, ("minx", "miny", "maxx", "maxy"), strict=True)))

        left, right = part("L", self.minx, self.miny, x, self.maxy), part("R", x, self.miny, self.maxx, self.maxy)
        up, down = part("U", self.minx, y, self.maxx, self.maxy), part("D", self.minx, self.miny, self.maxx, y)
        four = F.array(
            part("LU", self.minx, y, x, self.maxy),
            part("LD", self.minx, self.miny, x, y),
            part("RU", x, y, self.maxx, self.maxy),
            part("RD", x, self.miny, self.maxx, y),
        )
        return F.when(cut_x & cut_y, four).when(cut_x, F.array(left, right)).when(cut_y, F.array(up, down)).otherwise(F.slice(four, 1, 0))

    def corners(self, closed: bool = False) -> Column:
        """Left top, left bottom, right bottom, right top, and the first again if closed."""
        at = [(self.minx, self.maxy), (self.minx, self.miny), (self.maxx, self.miny), (self.maxx, self.maxy)]
        return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in at + at[: int(closed)]))

    def contains_point(self, x: Column, y: Column) -> Column:
        return (self.minx < x) & (x < self.maxx) & (self.miny < y) & (y < self.maxy)

    def covers_point(self, x: Column, y: Column) -> Column:
        t = F.lit(TOLERANCE)
        return (x > self.minx - t) & (x < self.maxx + t) & (y > self.miny - t) & (y < self.maxy + t)

    def touches_point(self, x: Column, y: Column) -> Column:
        on_x = ((x == self.minx) | (x == self.maxx)) & (y >= self.miny) & (y <= self.maxy)
        on_y = ((y == self.miny) | (y == self.maxy)) & (x >= self.minx) & (x <= self.maxx)
        return on_x | on_y

    def contains(self, o: Rect) -> Column:
        return self.contains_point(o.minx, o.miny) & self.contains_point(o.maxx, o.maxy)

    def covers(self, o: Rect) -> Column:
        return (self.minx <= o.minx) & (self.miny <= o.miny) & (self.maxx >= o.maxx) & (self.maxy >= o.maxy)

    def intersects(self, o: Rect) -> Column:
        return (self.minx <= o.maxx) & (o.minx <= self.maxx) & (self.miny <= o.maxy) & (o.miny <= self.maxy)

    def overlaps(self, o: Rect) -> Column:
        return (self.minx < o.maxx) & (o.minx < self.maxx) & (self.miny < o.maxy) & (o.miny < self.maxy)

    def disjoint(self, o: Rect) -> Column:
        return ~self.intersects(o)

    def touches(self, o: Rect) -> Column:
        return self.intersects(o) & ~self.overlaps(o)

    def equals(self, o: Rect) -> Column:
        return (self.minx == o.minx) & (self.miny == o.miny) & (self.maxx == o.maxx) & (self.maxy == o.maxy)
