"""Geometry as columns. A ring is ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>`` without a repeated closing vertex."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = 111_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """F01."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) * F.sin(dl)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def degrees_around(lat: Column, radius_m: Column | float) -> tuple[Column, Column]:
    """half height and half width in degrees of a box around a point."""
    r = radius_m if isinstance(radius_m, Column) else F.lit(float(radius_m))
    return r / METERS_PER_DEGREE, r / (METERS_PER_DEGREE * F.greatest(F.lit(0.1), F.cos(F.radians(lat))))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.array(point(minx, miny), point(maxx, miny), point(maxx, maxy), point(minx, maxy))


def open_ring(ring: Column) -> Column:
    """Drop a repeated closing vertex."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def let(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), of), 0)


def xs(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["x"])


def ys(ring: Column) -> Column:
    return F.transform(ring, lambda p: p["y"])


def bounds(ring: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy."""
    return F.array_min(xs(ring)), F.array_min(ys(ring)), F.array_max(xs(ring)), F.array_max(ys(ring))


def vertex_mean(ring: Column) -> tuple[Column, Column]:
    return F.try_divide(_sum(xs(ring)), F.size(ring)), F.try_divide(_sum(ys(ring)), F.size(ring))


def signed_area(ring: Column) -> Column:
    cross = F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return _sum(cross) / 2


def area(ring: Column) -> Column:
    """shoelace area."""
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    """F10."""
    return _sum(F.zip_with(ring, _next(ring), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def aspect(ring: Column) -> Column:
    """long side over short side of the bounding box, null when degenerate."""
    minx, miny, maxx, maxy = bounds(ring)
    w, h = maxx - minx, maxy - miny
    return F.when((w > 0) & (h > 0), F.greatest(w, h) / F.least(w, h))


def compactness(area_: Column, perimeter_: Column) -> Column:
    """F06."""
    return F.when(perimeter_ > 0, 4 * math.pi * area_ / (perimeter_ * perimeter_))


def centroid_point(ring: Column) -> Column:
    """area-weighted, relative to the first vertex to keep the products small."""
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    local = F.transform(ring, lambda p: F.struct((p["x"] - x0).alias("x"), (p["y"] - y0).alias("y")))
    parts = let(local, lambda own: F.zip_with(own, _next(own), lambda a, b: F.struct(
        (a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))))
    total = F.aggregate(
        parts, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
        lambda s, p: F.struct((s["c"] + p["c"]).alias("c"), (s["x"] + p["c"] * p["x"]).alias("x"),
                              (s["y"] + p["c"] * p["y"]).alias("y")))
    return let(total, lambda t: F.struct((x0 + F.try_divide(t["x"], 3 * t["c"])).alias("x"), (y0 + F.try_divide(t["y"], 3 * t["c"])).alias("y")))


def centroid(ring: Column) -> tuple[Column, Column]:
    """``centroid_point`` as two columns."""
    p = centroid_point(ring)
    return p["x"], p["y"]


def is_usable(ring: Column) -> Column:
    """at least three distinct vertices and a nonzero area. Self-intersections are not repaired."""
    return F.coalesce((F.size(F.array_distinct(ring)) >= 3) & (area(ring) > 0), F.lit(False))


def apply_affine(p: Column, t: Column) -> Column:
    """pixel to world; ``t`` is (a, b, c, d, e, f) with x' = a x + b y + c, y' = d x + e y + f."""
    return point(t[0] * p["x"] + t[1] * p["y"] + t[2], t[3] * p["x"] + t[4] * p["y"] + t[5])


def invert_affine(p: Column, t: Column) -> Column:
    """world to pixel."""
    det = t[0] * t[4] - t[1] * t[3]
    dx, dy = p["x"] - t[2], p["y"] - t[5]
    return point(F.try_divide(t[4] * dx - t[1] * dy, det), F.try_divide(t[0] * dy - t[3] * dx, det))


def scale_ring(ring: Column, w: Column | float, h: Column | float) -> Column:
    """normalised ring to pixels."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    h = h if isinstance(h, Column) else F.lit(float(h))
    return F.transform(ring, lambda p: point(p["x"] * w, p["y"] * h))


def tile_footprint(bounds_: Column, transform: Column, width: Column, height: Column) -> Column:
    """stored bounds if present, else affine times size."""
    minx, maxy = transform[2], transform[5]
    computed = box_ring(minx, maxy + height * transform[4], minx + width * transform[0], maxy)
    return F.when(bounds_.isNotNull(),
                  box_ring(bounds_["minx"], bounds_["miny"], bounds_["maxx"], bounds_["maxy"])).otherwise(computed)


# WGS84 ellipsoid, transverse Mercator scale, false easting and (south of the equator) false northing.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
UTM_FALSE_NORTHING = 10_000_000.0


def _krueger() -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the series coefficients (fourth order in the third flattening)."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, inverse


def utm_zone(lon: Column) -> Column:
    """The zone of a longitude in degrees."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_srid(lon: Column, lat: Column) -> Column:
    """The code of the zone that a position in degrees lies in: 326xx north of the equator, 327xx south of it."""
    return F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + utm_zone(lon)


def _meridian(zone: Column | int) -> Column:
    return zone * 6.0 - 183.0 if isinstance(zone, Column) else F.lit(zone * 6.0 - 183.0)


def _northing(south: Column | bool) -> Column:
    return F.when(south, F.lit(UTM_FALSE_NORTHING)).otherwise(F.lit(0.0)) if isinstance(south, Column) else F.lit(UTM_FALSE_NORTHING if south else 0.0)


def to_utm(lon: Column, lat: Column, zone: Column | int = 10, south: Column | bool = False) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres by the Krueger series; zone and hemisphere may differ from row to row."""
    radius, forward, _ = _krueger()
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    east = lon - _meridian(zone)
    # Over the date line the short way round.
    lam = F.radians(F.when(F.abs(east) > 180, east - 360 * F.signum(east)).otherwise(east))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi0 = F.atan2(t, F.cos(lam))
    eta0 = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta0, xi0
    for j, c in enumerate(forward, start=1):
        x = x + c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        y = y + c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
    return UTM_FALSE_EASTING + UTM_SCALE * radius * x, UTM_SCALE * radius * y + _northing(south)


def from_utm(east: Column, north: Column, zone: Column | int = 10, south: Column | bool = False) -> tuple[Column, Column]:
    """UTM metres to WGS84 (lon, lat)."""
    radius, _, inverse = _krueger()
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)
    xi = (north - _northing(south)) / (UTM_SCALE * radius)
    eta = (east - UTM_FALSE_EASTING) / (UTM_SCALE * radius)
    xi1, eta1 = xi, eta
    for j, c in enumerate(inverse, start=1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # Conformal to geodetic latitude: three fixed-point steps reach double precision at this flattening.
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    psi = F.atanh(F.sin(chi))
    s = F.sin(chi)
    for _ in range(5):
        s = F.tanh(psi + e * F.atanh(e * s))
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + _meridian(zone)
    return F.when(F.abs(lon) > 180, lon - 360 * F.signum(lon)).otherwise(lon), F.degrees(F.asin(s))


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """F12."""
    return WGS84_A * F.radians(lon), WGS84_A * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - F.lit(math.pi / 2))


def _zone_of(srid: int) -> tuple[int, bool] | None:
    """Zone and hemisphere of a UTM code on WGS84."""
    zone = srid % 100
    return (zone, srid // 100 == 327) if srid // 100 in (326, 327) and 1 <= zone <= 60 else None


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """between degrees (4326), Web Mercator (3857) and any UTM zone on WGS84 (326xx, 327xx), through degrees."""
    for srid in (source, target):
        if srid not in (4326, 3857) and _zone_of(srid) is None:
            raise ValueError(f"EPSG:{srid} is not supported; use 4326, 3857 or a UTM zone on WGS84")
    if source == target:
        return x, y
    lon, lat = (x, y) if source == 4326 else from_web_mercator(x, y) if source == 3857 else from_utm(x, y, *_zone_of(source))
    return (lon, lat) if target == 4326 else to_web_mercator(lon, lat) if target == 3857 else to_utm(lon, lat, *_zone_of(target))


def reproject_rows(x: Column, y: Column, source: Column, target: Column) -> Column:
    """F12 where the codes are columns: a point struct. A code that is not supported raises, a null code gives null."""
    zoned = lambda srid: F.floor(srid / 100).isin(326, 327) & (F.pmod(srid, F.lit(100)).between(1, 60))
    known = lambda srid: srid.isin(4326, 3857) | zoned(srid)
    zone, south = (lambda srid: F.pmod(srid, F.lit(100))), (lambda srid: F.floor(srid / 100) == 327)
    unknown = lambda srid: F.raise_error(F.concat(F.lit("EPSG:"), srid.cast("string"), F.lit(" is not supported"))).cast("struct<x: double, y: double>")
    checked = lambda srid, p: F.when(known(srid), p).when(srid.isNotNull(), unknown(srid))
    degrees = checked(source, F.when(source == 4326, point(x, y)).when(source == 3857, point(*from_web_mercator(x, y))).otherwise(
        point(*from_utm(x, y, zone(source), south(source)))))
    # Through a lambda, so that the degrees are worked out once and not wherever they are used.
    moved = F.get(F.transform(F.array(degrees), lambda d: F.when(target == 4326, d).when(target == 3857, point(*to_web_mercator(d["x"], d["y"]))).otherwise(
        point(*to_utm(d["x"], d["y"], zone(target), south(target))))), 0)
    return F.when(source == target, point(x, y)).otherwise(checked(target, moved))


def reproject_ring(ring: Column, source: int, target: int) -> Column:
    def move(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return point(x, y)

    return ring if source == target else F.transform(ring, move)


def climate_zone(lat: Column, lon: Column) -> Column:
    """P07."""
    return (F.when(lon < -120, "coastal").when((lon > -116) | ((lat < 34.5) & (lon > -117.5)), "desert")
            .otherwise("valley"))


def grid_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and column of the fixed 0.5 x 0.625 degree grid, half to even, longitude wrapping at 576."""
    return F.rint((lat + 90.0) / 0.5).cast("int"), F.pmod(F.rint((lon + 180.0) / 0.625).cast("int"), F.lit(576))


def rounded_key(c: Column, decimals: int = 3) -> Column:
    """Integer key of a coordinate rounded to some decimals."""
    return F.rint(c * float(10 ** decimals)).cast("bigint")
