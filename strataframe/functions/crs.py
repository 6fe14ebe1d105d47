"""Coordinate systems: geographic degrees, spherical Mercator metres and zones of the transverse Mercator, in closed form."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere of EPSG:3857 in metres (fixed value).
RADIUS = 6378137.0
#: proj4 texts of the known systems (fixed values).
SYSTEMS = {
    4326: ("WGS 84", "+proj=longlat +datum=WGS84 +no_defs"),
    4490: ("CGCS2000", "+proj=longlat +ellps=GRS80 +no_defs"),
    3857: ("WGS 84 / Pseudo-Mercator", "+proj=merc +a=6378137 +b=6378137 +lat_ts=0 +lon_0=0 +x_0=0 +y_0=0 +k=1 +units=m +no_defs"),
}


def is_projected(proj4: Column) -> Column:
    return ~F.contains(proj4, F.lit("longlat"))


def from_wkt(wkt: str) -> int | None:
    """EPSG number of a WKT: its own authority, else the system whose name has all of the WKT's name tokens."""
    if m := re.search(r'AUTHORITY\["EPSG","?(\d+)"?\]\]\s*$', wkt):
        return int(m[1])
    m = re.match(r'\s*(?:PROJCS|GEOGCS)\["([^"]*)"', wkt)
    tokens = set(re.findall(r"[a-z0-9]+", (m[1] if m else "").lower().replace("wgs84", "wgs 84").replace("_", " "))) - {"gcs"}
    for epsg, (name, _) in SYSTEMS.items():
        known = set(re.findall(r"[a-z0-9]+", name.lower()))
        if tokens and (tokens == known or tokens - {"1984"} == known - {"84"}):
            return epsg
    return None


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.radians(x) * RADIUS, F.log(F.tan(F.radians(y) / 2 + math.pi / 4)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


@dataclass(frozen=True)
class TransverseMercator:
    """A zone: ellipsoid (axis, flattening), middle meridian, scale, false easting and northing."""

    axis: float
    flattening: float
    meridian: float
    scale: float = 1.0
    east: float = 500_000.0
    north: float = 0.0

    def _series(self):
        n = self.flattening / (2 - self.flattening)
        radius = self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        return radius, forward, back, delta, 2 * math.sqrt(n) / (1 + n)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        radius, alpha, _, _, e = self._series()
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        d = F.radians(lon - self.meridian)
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
        x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
        y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(alpha, 1)), F.lit(0.0))
        return self.east + self.scale * radius * x, self.north + self.scale * radius * y

    def back(self, x: Column, y: Column) -> tuple[Column, Column]:
        radius, _, beta, delta, _ = self._series()
        xi0, eta0 = (y - self.north) / (self.scale * radius), (x - self.east) / (self.scale * radius)
        xi = xi0 - sum((b * F.sin(2 * k * xi0) * F.cosh(2 * k * eta0) for k, b in enumerate(beta, 1)), F.lit(0.0))
        eta = eta0 - sum((b * F.cos(2 * k * xi0) * F.sinh(2 * k * eta0) for k, b in enumerate(beta, 1)), F.lit(0.0))
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(delta, 1)), F.lit(0.0))
        return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + self.meridian, F.degrees(lat)


#: Axis and flattening of the ellipsoids in use (fixed values).
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)


def zone_of(epsg: int) -> TransverseMercator | None:
    """UTM zones on WGS 84 (326zz north, 327zz south) and the zones of CGCS2000 of 6 degrees (4491-4501 with the zone number in the easting,
    4502-4512 without) and of 3 degrees (4513-4533 with it, 4534-4554 without)."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return TransverseMercator(*WGS84, 6.0 * (epsg % 100) - 183, 0.9996, 500_000.0, 10_000_000.0 if epsg > 32700 else 0.0)
    if 4491 <= epsg <= 4501:
        return TransverseMercator(*GRS80, 75.0 + 6 * (epsg - 4491), 1.0, (13 + epsg - 4491) * 1e6 + 500_000.0)
    if 4502 <= epsg <= 4512:
        return TransverseMercator(*GRS80, 75.0 + 6 * (epsg - 4502))
    if 4513 <= epsg <= 4533:
        return TransverseMercator(*GRS80, 75.0 + 3 * (epsg - 4513), 1.0, (25 + epsg - 4513) * 1e6 + 500_000.0)
    if 4534 <= epsg <= 4554:
        return TransverseMercator(*GRS80, 75.0 + 3 * (epsg - 4534))
    return None


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between degrees (4326, 4490), spherical Mercator (3857) and the zones of ``zone_of``; there is no datum shift. Between two projected systems by way of degrees."""

    def degrees(epsg: int) -> bool:
        if epsg in SYSTEMS:
            return "longlat" in SYSTEMS[epsg][1]
        if zone_of(epsg) is None:
            raise ValueError(f"unknown coordinate system {epsg}")
        return False

    flat_source, flat_target = not degrees(source), not degrees(target)
    if source == target or not (flat_source or flat_target):
        return x, y
    if flat_source:
        x, y = from_mercator(x, y) if source == 3857 else zone_of(source).back(x, y)
    if flat_target:
        x, y = to_mercator(x, y) if target == 3857 else zone_of(target).forward(x, y)
    return x, y
