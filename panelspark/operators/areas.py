"""Areas of interest: specs to validated polygons, errors as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import geo as G

# Spellings of the WGS84 reference system.
WGS84_NAMES = (
    "urn:ogc:def:crs:ogc:1.3:crs84", "urn:ogc:def:crs:ogc::crs84", "urn:ogc:def:crs:epsg::4326",
    "urn:ogc:def:crs:epsg:6.9:4326", "epsg:4326", "wgs84", "wgs 84", "crs84",
)


def scene_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-]+", "_")


def is_wgs84(crs: Column) -> Column:
    """``crs`` is the member's JSON text. Absent means WGS84; else it must be an object that names WGS84."""
    named = F.from_json(crs, "STRUCT<name: STRING, properties: STRUCT<name: STRING>>")
    name = F.coalesce(named["properties"]["name"], named["name"])
    return crs.isNull() | F.coalesce(F.lower(F.trim(name)).isin(*WGS84_NAMES), F.lit(False))


def range_error(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.when(~(minx.between(-180, 180) & maxx.between(-180, 180)), "longitude_range").when(
        ~(miny.between(-90, 90) & maxy.between(-90, 90)), "latitude_range")


def number_text(x: Column) -> Column:
    """A coordinate in canonical JSON: shortest digits, whole numbers keep one decimal, an exponent of two digits only
    below a ten-thousandth."""
    text = x.cast("string")
    parts = r"^(-?)(\d)\.(\d+)E-(\d+)$"
    sign, whole, rest, power = (F.regexp_extract(text, parts, i) for i in (1, 2, 3, 4))
    digits = F.when(rest == "0", "").otherwise(rest)
    small = F.concat(sign, whole, F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)), F.lit("e-"), F.lpad(power, 2, "0"))
    return F.when(~text.contains("E-"), text).when(power == "4", F.concat(sign, F.lit("0.000"), whole, digits)).otherwise(small)


def stable_id(rings: Column) -> Column:
    """Ten hex digits over the canonical polygon text of all rings, the outer one first."""
    pair = lambda p: F.concat(F.lit("["), number_text(p["x"]), F.lit(","), number_text(p["y"]), F.lit("]"))
    closed = lambda r: F.concat(F.lit("["), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), pair), ","), F.lit("]"))
    text = F.concat(F.lit('{"coordinates":['), F.array_join(F.transform(rings, closed), ","), F.lit('],"type":"Polygon"}'))
    return F.substring(F.sha1(text), 1, 10)


def parse_specs(specs: DataFrame, scenes: DataFrame, spec: str = "spec", partner: str | None = None) -> DataFrame:
    """Named scene or ``minx,miny,maxx,maxy`` to (source, aoi_id, ring, error). A partner id replaces the hash.

    ``scenes`` is (scene, minx, miny, maxx, maxy).
    """
    named = scenes.select(scene_key(F.col("scene")).alias("_key"), *[F.col(c).alias(f"_s_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    df = specs.withColumn("_key", scene_key(F.col(spec))).join(named, "_key", "left")
    parts = F.transform(F.split(F.col(spec), ","), lambda v: F.trim(v).try_cast("double"))
    df = df.withColumn("_p", parts).withColumn("_scene", F.col("_s_minx").isNotNull())
    box = [F.when(F.col("_scene"), F.col(f"_s_{c}")).otherwise(F.get("_p", i)) for i, c in enumerate(("minx", "miny", "maxx", "maxy"))]
    minx, miny, maxx, maxy = box
    error = (
        F.when(F.col("_scene"), range_error(*box)).when(~F.col(spec).contains(","), "unknown_scene")
        .when(F.size("_p") != 4, "not_four_parts").when(F.exists("_p", lambda v: v.isNull()), "not_numeric")
        .when(~((minx < maxx) & (miny < maxy)), "degenerate").otherwise(range_error(*box)))
    df = df.withColumn("error", error).withColumn("ring", F.when(F.col("error").isNull(), G.box_ring(*box)))
    own = F.col(partner) if partner else F.lit(None).cast("string")
    ident = F.coalesce(own, F.when(F.col("_scene"), F.col("_key")).otherwise(stable_id(F.array("ring"))))
    ok = F.col("error").isNull()
    return df.withColumn("source", F.when(ok, F.when(F.col("_scene"), "scene").otherwise("bbox"))).withColumn(
        "aoi_id", F.when(ok, ident)).select(*specs.columns, "source", "aoi_id", "ring", "error")


def parse_geojson_areas(raw: DataFrame, text: str = "value") -> DataFrame:
    """GeoJSON documents (collection, feature or bare polygon) to (aoi_id, ring, holes, error)."""
    geom = "STRUCT<type: STRING, coordinates: STRING>"
    kind = (f"STRUCT<type: STRING, coordinates: STRING, geometry: {geom}, features: ARRAY<STRUCT<geometry: {geom}>>, "
            "crs: STRING>")
    d = raw.withColumn("_d", F.from_json(F.col(text), kind))
    bare = F.struct(F.col("_d.type").alias("type"), F.col("_d.coordinates").alias("coordinates"))
    empty = (F.col("_d.type") == "FeatureCollection") & (F.coalesce(F.size("_d.features"), F.lit(0)) <= 0)
    g = F.when(F.col("_d.type") == "FeatureCollection", F.get("_d.features", 0)["geometry"]).when(
        F.col("_d.type") == "Feature", F.col("_d.geometry")).otherwise(bare)
    d = d.withColumn("_g", g)
    rings = F.from_json("_g.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>")
    opened = F.transform(rings, lambda r: G.open_ring(F.transform(r, lambda c: G.point(F.get(c, 0), F.get(c, 1)))))
    d = d.withColumn("_all", F.when(F.col("_g.type") == "Polygon", opened)).withColumn("_r", F.get("_all", 0))
    error = (
        F.when(~is_wgs84(F.col("_d.crs")), "not_wgs84").when(empty, "no_features")
        .when(F.coalesce(F.col("_g.type"), F.lit("")) != "Polygon", "not_a_polygon")
        .when(~G.is_usable(F.col("_r")) | self_crossing(F.col("_r")), "invalid_polygon").otherwise(range_error(*G.bounds(F.col("_r")))))
    ok = F.col("error").isNull()
    d = d.withColumn("error", error).withColumn("ring", F.when(ok, F.col("_r"))).withColumn("holes", F.when(ok, F.slice("_all", 2, F.size("_all"))))
    return d.withColumn("aoi_id", F.when(ok, stable_id(F.col("_all")))).drop("_d", "_g", "_r", "_all")


def self_crossing(ring: Column) -> Column:
    """Whether two edges of a ring cross properly."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, nxt, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def side(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def cross(s: Column, t: Column) -> Column:
        return (side(s["p"], s["q"], t["p"]) * side(s["p"], s["q"], t["q"]) < 0) & (
            side(t["p"], t["q"], s["p"]) * side(t["p"], t["q"], s["q"]) < 0)

    return F.exists(edges, lambda s: F.exists(edges, lambda t: cross(s, t)))
