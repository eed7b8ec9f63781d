"""Polygons with holes and of several parts as columns.

A geometry is an array of polygons, a polygon an array of rings, the first its outline and the others its holes, a ring an
array of points without a repeated closing one. Rings may turn either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions import geo as G

POSITION, POINTS = "array<double>", "array<struct<x: double, y: double>>"
TYPE = f"array<array<{POINTS}>>"


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """The geometry of a GeoJSON type and its coordinates as JSON text: Polygon or MultiPolygon, anything else is null.
    Positions may have further numbers; rings of fewer than three points and polygons without an outline are left out."""
    many = F.when(kind == "Polygon", F.array(F.from_json(coordinates, f"array<array<{POSITION}>>"))).when(
        kind == "MultiPolygon", F.from_json(coordinates, f"array<array<array<{POSITION}>>>"))
    rings = F.transform(many, lambda polygon: F.transform(polygon, lambda ring: G.open_ring(F.transform(ring, lambda c: G.point(F.get(c, 0), F.get(c, 1))))))
    return cleaned(rings)


def cleaned(geometry: Column) -> Column:
    """Without rings of fewer than three points; a polygon without an outline goes with its holes."""
    outlined = F.filter(geometry, lambda polygon: F.coalesce(F.size(F.get(polygon, 0)) >= 3, F.lit(False)))
    return F.transform(outlined, lambda polygon: F.filter(polygon, lambda ring: F.coalesce(F.size(ring) >= 3, F.lit(False))))


def _over_rings(geometry: Column, of) -> Column:
    """Sum of ``of(ring)`` over all rings, holes with the opposite sign."""
    signed = F.transform(geometry, lambda polygon: F.aggregate(F.transform(polygon, lambda ring, i: F.when(i == 0, of(ring)).otherwise(-of(ring))), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(signed, F.lit(0.0), lambda s, v: s + v)


def area(geometry: Column) -> Column:
    """outlines less holes."""
    return _over_rings(geometry, G.area)


def perimeter(geometry: Column) -> Column:
    """the length of all rings, holes too."""
    lengths = F.transform(F.flatten(geometry), G.perimeter)
    return F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v)


def centroid(geometry: Column) -> tuple[Column, Column]:
    """the centre of the area that is left without the holes; null if there is none."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = lambda rows: F.aggregate(rows, zero, lambda s, v: F.struct(*[(s[c] + v[c]).alias(c) for c in ("a", "x", "y")]))
    of = lambda area_, p, sign: F.struct((sign * area_).alias("a"), *[(sign * area_ * F.coalesce(p[c], F.lit(0.0))).alias(c) for c in ("x", "y")])
    ring = lambda r, i: G.let(F.struct(G.area(r).alias("a"), G.centroid_point(r).alias("p")), lambda v: of(v["a"], v["p"], F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))))
    centre = G.let(total(F.transform(geometry, lambda polygon: total(F.transform(polygon, ring)))), lambda t: F.when(t["a"] > 0, F.struct((t["x"] / t["a"]).alias("x"), (t["y"] / t["a"]).alias("y"))))
    return centre["x"], centre["y"]


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Whether a point off the outlines lies inside a part and in none of its holes: an odd number of edges to its right."""
    crossed = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]))
    turned = lambda ring: F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    hits = F.transform(F.flatten(geometry), lambda ring: F.size(F.filter(F.zip_with(ring, turned(ring), lambda p, q: F.coalesce(crossed(p, q), F.lit(False))), lambda v: v)))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def points(geometry: Column) -> Column:
    """All vertices in a row."""
    return F.flatten(F.flatten(geometry))


def bounds(geometry: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy."""
    return G.bounds(points(geometry))


def largest(geometry: Column) -> Column:
    """The outline of the part with the largest area, the first of equal ones."""
    sized = F.transform(geometry, lambda polygon, i: F.struct(G.area(F.get(polygon, 0)).alias("area"), (-i).alias("first"), F.get(polygon, 0).alias("ring")))
    return F.get(F.reverse(F.array_sort(sized)), 0)["ring"]


def moved(geometry: Column, to) -> Column:
    """Every point replaced by ``to(point)``, say its place in another reference system."""
    return F.transform(geometry, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, to)))
