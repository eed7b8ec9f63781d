"""Queries: geometry functions and spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.operators import components as C
from panelspark.operators import polygons as P
from panelspark.operators import spatial as S
from panelspark.plans.registry import query


def rings(t):
    return t.f_rect.select("array_id", G.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("ring"))


@query("p01_bbox_filter", "SELECT station_id, latitude, longitude FROM f_station WHERE longitude BETWEEN -122.5 AND -117 AND latitude BETWEEN 34 AND 40.25",
       "latitude, longitude")
def p01(t):
    return S.in_box(t.f_station, (-122.5, 34.0, -117.0, 40.25))


@query("p07_climate_zone", """SELECT station_id, CASE WHEN longitude < -120 THEN 'coastal'
    WHEN longitude > -116 OR (latitude < 34.5 AND longitude > -117.5) THEN 'desert' ELSE 'valley' END AS zone FROM f_station""")
def p07(t):
    return t.f_station.select("station_id", G.climate_zone(F.col("latitude"), F.col("longitude")).alias("zone"))


HAV = """2 * 6371000e0 * ASIN(SQRT(POWER(SIN(RADIANS({b}.latitude - {a}.latitude) / 2), 2)
    + COS(RADIANS({a}.latitude)) * COS(RADIANS({b}.latitude)) * POWER(SIN(RADIANS({b}.longitude - {a}.longitude) / 2), 2)))"""


@query("f01_haversine", f"SELECT a.station_id, {HAV.format(a='a', b='b')} AS d_m FROM f_station a JOIN f_station b ON b.station_id = a.station_id + 1",
       "d_m", digits=3)
def f01(t):
    a = t.f_station
    b = t.f_station.select((F.col("station_id") - 1).alias("station_id"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    return a.join(b, "station_id").select("station_id", G.haversine_m(
        F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")).alias("d_m"))


@query("f02_radius_box", """SELECT station_id, latitude - 5e3 / 111e3 AS south, longitude - 5e3 / (111e3 * GREATEST(1e-1, COS(RADIANS(latitude)))) AS west,
    latitude + 5e3 / 111e3 AS north, longitude + 5e3 / (111e3 * GREATEST(1e-1, COS(RADIANS(latitude)))) AS east FROM f_station""",
       "south, west, north, east")
def f02(t):
    dlat, dlon = G.degrees_around(F.col("latitude"), 5000.0)
    lat, lon = F.col("latitude"), F.col("longitude")
    return t.f_station.select("station_id", (lat - dlat).alias("south"), (lon - dlon).alias("west"),
                              (lat + dlat).alias("north"), (lon + dlon).alias("east"))


@query("f03_ring_measures", """SELECT tile_id, gt_idx, x1 AS minx, y1 AS miny, x2 AS maxx, y2 AS maxy, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
    (x2 - x1) * (y2 - y1) AS area, GREATEST(x2 - x1, y2 - y1) / LEAST(x2 - x1, y2 - y1) AS aspect FROM f_gt""",
       "minx, miny, maxx, maxy, cx, cy, area, aspect")
def f03(t):
    ring = F.col("ring")
    df = t.f_gt.withColumn("ring", G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    minx, miny, maxx, maxy = G.bounds(ring)
    cx, cy = G.vertex_mean(ring)
    return df.select("tile_id", "gt_idx", minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"),
                     cx.alias("cx"), cy.alias("cy"), G.area(ring).alias("area"), G.aspect(ring).alias("aspect"))


@query("f04_edge_distance", """SELECT tile_id, gt_idx, LEAST((x1 + x2) / 2, (y1 + y2) / 2, 640 - (x1 + x2) / 2, 640 - (y1 + y2) / 2) AS d FROM f_gt""", "d")
def f04(t):
    from panelspark.operators.detect import edge_distance
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return t.f_gt.select("tile_id", "gt_idx", edge_distance(cx, cy, F.lit(640.0), F.lit(640.0)).alias("d"))


@query("f05_box_iou", """WITH p AS (SELECT tile_id, gt_idx, x1, y1, x2, y2, LEAD(x1) OVER w AS a1, LEAD(y1) OVER w AS b1, LEAD(x2) OVER w AS a2, LEAD(y2) OVER w AS b2
      FROM f_gt WINDOW w AS (PARTITION BY tile_id ORDER BY gt_idx)),
    i AS (SELECT *, GREATEST(0e0, LEAST(x2, a2) - GREATEST(x1, a1)) * GREATEST(0e0, LEAST(y2, b2) - GREATEST(y1, b1)) AS inter FROM p WHERE a1 IS NOT NULL)
    SELECT tile_id, gt_idx, inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter) AS iou FROM i""", "iou")
def f05(t):
    from panelspark.operators.detect import box_iou
    nxt = t.f_gt.select("tile_id", (F.col("gt_idx") - 1).alias("gt_idx"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    own = t.f_gt.select("tile_id", "gt_idx", *[F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")])
    return own.join(nxt, ["tile_id", "gt_idx"]).select("tile_id", "gt_idx", box_iou("a_", "b_").alias("iou"))


@query("f06_f10_shape_features", """SELECT array_id, (maxx - minx) * (maxy - miny) AS area_m2, 2 * (maxx - minx + maxy - miny) AS perimeter_m,
    4 * PI() * (maxx - minx) * (maxy - miny) / POWER(2 * (maxx - minx + maxy - miny), 2) AS compactness,
    GREATEST(maxx - minx, maxy - miny) / LEAST(maxx - minx, maxy - miny) AS bbox_aspect_ratio, 1e0 AS convex_hull_ratio,
    (minx + maxx) / 2 AS centroid_x, (miny + maxy) / 2 AS centroid_y FROM f_rect""",
       "area_m2, perimeter_m, compactness, bbox_aspect_ratio, convex_hull_ratio, centroid_x, centroid_y")
def f06(t):
    return S.geometry_features(rings(t)).drop("orientation_deg")


@query("f09_orientation", """WITH b AS (SELECT array_id, maxx - minx AS w, maxy - miny AS h FROM f_rect), m AS (SELECT *, 2 * (w + h) / 5 AS mx, 2 * w / 5 AS my FROM b),
    s AS (SELECT array_id, w * w + (w + h) * (w + h) + h * h - 5 * mx * mx AS sxx, (w + h) * w + h * w - 5 * mx * my AS sxy, 2 * w * w - 5 * my * my AS syy FROM m)
    SELECT array_id, DEGREES(ATAN2(2 * sxy, sxx - syy) / 2) AS orientation_deg FROM s""", "orientation_deg")
def f09(t):
    # A sheared parallelogram per array, so the principal axis is not trivial.
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    ring = F.array(G.point(F.col("minx"), F.col("miny")), G.point(F.col("maxx"), F.col("miny")),
                   G.point(F.col("maxx") + h, F.col("miny") + w), G.point(F.col("minx") + h, F.col("miny") + w))
    return S.geometry_features(t.f_rect.select("array_id", ring.alias("ring"))).select("array_id", "orientation_deg")


@query("f11_affine", """SELECT tile_id, gt_idx, 6e-1 * x1 + 586000 AS wx, -6e-1 * y1 + 4095000 AS wy, x1 AS px, y1 AS py FROM f_gt""",
       "wx, wy, px, py")
def f11(t):
    tr = F.array(*[F.lit(float(v)) for v in (0.6, 0.0, 586000.0, 0.0, -0.6, 4095000.0)])
    w = G.apply_affine(G.point(F.col("x1"), F.col("y1")), tr)
    return t.f_gt.withColumn("w", w).withColumn("p", G.invert_affine(F.col("w"), tr)).select(
        "tile_id", "gt_idx", F.col("w.x").alias("wx"), F.col("w.y").alias("wy"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def _utm_sql(stations="f_station", meridian="-123", south="0", extra=""):
    """UTM of ``stations`` in SQL; ``meridian`` and the ``south`` offset may be columns."""
    radius, forward, _ = G._krueger()
    e = math.sqrt(G.WGS84_F * (2 - G.WGS84_F))
    x = " + ".join(["eta"] + [f"({c!r}) * COS({2 * j} * xi) * (EXP({2 * j} * eta) - EXP(-{2 * j} * eta)) / 2" for j, c in enumerate(forward, 1)])
    y = " + ".join(["xi"] + [f"({c!r}) * SIN({2 * j} * xi) * (EXP({2 * j} * eta) + EXP(-{2 * j} * eta)) / 2" for j, c in enumerate(forward, 1)])
    at = lambda v: f"(5e-1 * LN((1 + {v}) / (1 - {v})))"
    return f"""WITH a AS (SELECT station_id, latitude, longitude, RADIANS(longitude - ({meridian})) AS lam, SIN(RADIANS(latitude)) AS s{extra} FROM {stations}),
      b AS (SELECT *, {at('s')} - ({e!r}) * {at(f'({e!r} * s)')} AS q FROM a),
      c AS (SELECT *, (EXP(q) - EXP(-q)) / 2 AS t FROM b),
      d AS (SELECT *, ATAN2(t, COS(lam)) AS xi, {at('(SIN(lam) / SQRT(1 + t * t))')} AS eta FROM c)
    SELECT station_id, 500000 + 9996e-4 * {radius!r} * ({x}) AS east, 9996e-4 * {radius!r} * ({y}) + {south} AS north,
      6378137e0 * RADIANS(longitude) AS merc_x, 6378137e0 * LN(TAN(PI() / 4 + RADIANS(latitude) / 2)) AS merc_y,
      latitude AS back_lat, longitude AS back_lon{extra} FROM d"""


@query("f12_reproject", _utm_sql(), "east, north, merc_x, merc_y, back_lat, back_lon", digits=4)
def f12(t):
    lon, lat = F.col("longitude"), F.col("latitude")
    east, north = G.reproject(lon, lat, 4326, 32610)
    mx, my = G.reproject(lon, lat, 4326, 3857)
    df = t.f_station.select("station_id", east.alias("east"), north.alias("north"), mx.alias("merc_x"), my.alias("merc_y"))
    back_lon, back_lat = G.reproject(F.col("east"), F.col("north"), 32610, 4326)
    return df.withColumn("back_lat", back_lat).withColumn("back_lon", back_lon)


#: Positions all around the globe, every other one south of the equator.
GLOBE = """SELECT station_id, CASE WHEN station_id % 2 = 0 THEN latitude ELSE -latitude END AS latitude, (longitude + 124) * 36 - 180 AS longitude,
    CASE WHEN station_id % 2 = 0 THEN 32601 ELSE 32701 END + CAST(FLOOR((longitude + 124) * 6) AS INT) AS srid FROM f_station"""


@query("f12_any_zone", "SELECT station_id, srid, east, north, back_lat, back_lon FROM (" + _utm_sql(
    f"({GLOBE}) st", "(srid % 100) * 6 - 183", "CASE WHEN srid >= 32700 THEN 10000000 ELSE 0 END", ", srid") + ") u", "east, north, back_lat, back_lon")
def f12_zones(t):
    df = t.sql(GLOBE)
    own = G.utm_srid(F.col("longitude"), F.col("latitude"))
    moved = df.select("station_id", own.alias("srid"), G.reproject_rows(F.col("longitude"), F.col("latitude"), F.lit(4326), own).alias("p"))
    back = moved.withColumn("b", G.reproject_rows(F.col("p.x"), F.col("p.y"), F.col("srid"), F.lit(4326)))
    return back.select("station_id", "srid", F.col("p.x").alias("east"), F.col("p.y").alias("north"), F.col("b.y").alias("back_lat"), F.col("b.x").alias("back_lon"))


@query("f13_area_centroid", """SELECT array_id, (minx + (maxx - minx) * 7 / 18) AS cx, (miny + (maxy - miny) * 7 / 18) AS cy FROM f_rect""", "cx, cy")
def f13(t):
    # The quad (0,0), (1,0), (2/3,2/3), (0,1) scaled to the box: two equal triangles, centroid at 7/18 of each side.
    x0, y0, w, h = F.col("minx"), F.col("miny"), F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    ring = F.array(G.point(x0, y0), G.point(x0 + w, y0), G.point(x0 + w * 2 / 3, y0 + h * 2 / 3), G.point(x0, y0 + h))
    cx, cy = G.centroid(ring)
    return t.f_rect.select("array_id", cx.alias("cx"), cy.alias("cy"))


SOURCES = "SELECT s_suppkey AS source, CAST(700 + s_suppkey * 37 % 2100 AS INT) AS width, CAST(600 + s_suppkey * 53 % 1900 AS INT) AS height FROM supplier"
GRID = f"""WITH s AS ({SOURCES}), r AS (SELECT *, UNNEST(RANGE(0, CAST(CEIL(height / 640e0) AS BIGINT))) AS tile_row FROM s),
    g AS (SELECT *, UNNEST(RANGE(0, CAST(CEIL(width / 640e0) AS BIGINT))) AS tile_col FROM r),
    f AS (SELECT source, tile_row, tile_col, tile_col * 640 AS x_off, tile_row * 640 AS y_off,
      LEAST(640, width - tile_col * 640) AS tile_w, LEAST(640, height - tile_row * 640) AS tile_h FROM g)"""


def grid(t):
    tr = F.array(F.lit(0.6), F.lit(0.0), F.lit(586000.0) + F.col("source") * 1000, F.lit(0.0), F.lit(-0.6), F.lit(4095000.0))
    return S.tile_grid(t.sql(SOURCES).withColumn("transform", tr))


@query("f14_tile_grid", GRID + """ SELECT *, 6e-1 * x_off + 586000 + source * 1000 AS minx, -6e-1 * y_off + 4095000 AS maxy,
    6e-1 * (x_off + tile_w) + 586000 + source * 1000 AS maxx, -6e-1 * (y_off + tile_h) + 4095000 AS miny FROM f""", "minx, miny, maxx, maxy")
def f14(t):
    return grid(t).drop("width", "height", "transform")


@query("w13_tile_numbers", GRID + """, n AS (SELECT source, tile_row, tile_col, ROW_NUMBER() OVER (ORDER BY source, tile_row, tile_col) - 1 AS tile_no FROM f)
    SELECT *, CONCAT('tile_', LPAD(CAST(tile_no AS VARCHAR), 6, '0'), '.png') AS tile_name FROM n""")
def w13(t):
    g = grid(t).select("source", "tile_row", "tile_col")
    key = (F.col("source") * 1_000_000 + F.col("tile_row") * 1000 + F.col("tile_col")).cast("bigint")
    return S.number_tiles(g.withColumn("_k", key), "_k").drop("_k")


@query("w13_array_ids", """SELECT array_id AS raw_id, ROW_NUMBER() OVER (ORDER BY array_id) - 1 AS array_id FROM f_rect WHERE array_id % 10 <> 0""")
def w13_arrays(t):
    # Every tenth ring is collapsed to a line and must not get an id.
    flat = F.when(F.col("array_id") % 10 == 0, F.col("miny")).otherwise(F.col("maxy"))
    df = t.f_rect.select(F.col("array_id").alias("raw_id"), G.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), flat).alias("ring"))
    return S.array_ids(df, "raw_id").drop("ring")


@query("f25_tile_footprint", GRID + """ SELECT source, tile_row, tile_col, CASE WHEN source % 2 = 0 THEN x_off * 1e0 ELSE 6e-1 * x_off END AS minx,
    CASE WHEN source % 2 = 0 THEN (y_off + tile_h) * 1e0 ELSE 4095000 - 6e-1 * y_off END AS maxy FROM f""", "minx, maxy")
def f25(t):
    g = grid(t)
    stored = F.when(F.col("source") % 2 == 0, F.struct(
        F.col("x_off").cast("double").alias("minx"), F.col("y_off").cast("double").alias("miny"),
        (F.col("x_off") + F.col("tile_w")).cast("double").alias("maxx"), (F.col("y_off") + F.col("tile_h")).cast("double").alias("maxy")))
    tr = F.array(F.lit(0.6), F.lit(0.0), 0.6 * F.col("x_off"), F.lit(0.0), F.lit(-0.6), 4095000 - 0.6 * F.col("y_off"))
    minx, _, _, maxy = G.bounds(F.col("ring"))
    return g.withColumn("ring", G.tile_footprint(stored, tr, F.col("tile_w"), F.col("tile_h"))).select(
        "source", "tile_row", "tile_col", minx.alias("minx"), maxy.alias("maxy"))


@query("f26_normalised_to_pixels", "SELECT tile_id, gt_idx, x1 AS minx, y2 AS maxy, (x2 - x1) * (y2 - y1) AS area FROM f_gt", "minx, maxy, area")
def f26(t):
    norm = G.box_ring(F.col("x1") / 640, F.col("y1") / 640, F.col("x2") / 640, F.col("y2") / 640)
    px = G.scale_ring(norm, 640, 640)
    minx, _, _, maxy = G.bounds(F.col("ring"))
    return t.f_gt.withColumn("ring", px).select("tile_id", "gt_idx", minx.alias("minx"), maxy.alias("maxy"), G.area(F.col("ring")).alias("area"))


@query("a37_extent", """SELECT array_id % 7 AS aoi, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy,
    (MIN(minx) + MAX(maxx)) / 2 AS center_x, (MIN(miny) + MAX(maxy)) / 2 AS center_y FROM f_rect GROUP BY 1""",
       "minx, miny, maxx, maxy, center_x, center_y")
def a37(t):
    return S.extent(rings(t).withColumn("aoi", F.col("array_id") % 7), "aoi")


GAP = "SQRT(POWER(GREATEST(0e0, b.minx - a.maxx, a.minx - b.maxx), 2) + POWER(GREATEST(0e0, b.miny - a.maxy, a.miny - b.maxy), 2))"


@query("j12_neighbor_features", f"""
    WITH p AS (SELECT a.array_id, {GAP} AS d, (b.maxx - b.minx) * (b.maxy - b.miny) AS area FROM f_rect a JOIN f_rect b ON a.array_id <> b.array_id
      AND b.minx <= a.maxx + 100 AND b.maxx >= a.minx - 100 AND b.miny <= a.maxy + 100 AND b.maxy >= a.miny - 100)
    SELECT r.array_id, COUNT(*) FILTER (WHERE d <= 50) AS neighbor_count_50m, COUNT(*) FILTER (WHERE d <= 100) AS neighbor_count_100m,
      MIN(d) AS distance_to_nearest_array_m, AVG(CASE WHEN d <= 100 THEN area END) AS mean_neighbor_area_100m
    FROM f_rect r LEFT JOIN p USING (array_id) GROUP BY 1""", "distance_to_nearest_array_m, mean_neighbor_area_100m")
def j12(t):
    return S.neighbor_features(rings(t))


POINTS = """SELECT CAST(c_custkey * 41 % 10000 AS DOUBLE) / 1000 + 32.5 AS lat, CAST(c_custkey * 67 % 10000 AS DOUBLE) / 1000 - 124 AS lon FROM customer"""


@query("j13_min_distance", f"""
    WITH p AS (SELECT lat AS latitude, lon AS longitude FROM ({POINTS}) x)
    SELECT a.station_id, COALESCE(MIN({HAV.format(a='a', b='b')}), 5000) AS distance_m FROM f_station a LEFT JOIN p b
      ON ABS(b.latitude - a.latitude) <= 5e3 / 111e3 AND ABS(b.longitude - a.longitude) <= 5e3 / (111e3 * GREATEST(1e-1, COS(RADIANS(a.latitude))))
    GROUP BY 1""", "distance_m", digits=3)
def j13(t):
    return S.min_distance(t.f_station, t.sql(POINTS), "distance_m")


RASTER = "SELECT p_partkey % 40 AS col, CAST(FLOOR(p_partkey / 40) AS BIGINT) AS row, p_size AS value FROM part"


@query("j14_raster_at_point", f"""
    WITH r AS ({RASTER}), s AS (SELECT station_id, CAST(FLOOR((longitude + 124) / 25e-2) AS BIGINT) AS col, CAST(FLOOR((latitude - 42) / -25e-2) AS BIGINT) AS row FROM f_station)
    SELECT s.station_id, r.value FROM s LEFT JOIN r ON r.row = s.row AND r.col = s.col AND s.row >= 0 AND s.col BETWEEN 0 AND 39""")
def j14(t):
    return S.raster_value(t.f_station, t.sql(RASTER), (0.25, 0, -124, 0, -0.25, 42), 1 << 30, 40).select("station_id", "value")


@query("j15_grid_cell", """SELECT station_id, CAST(ROUND_EVEN((latitude + 90) / 5e-1, 0) AS INT) AS grid_row, CAST(ROUND_EVEN((longitude + 180) / 625e-3, 0) AS INT) % 576 AS grid_col FROM f_station""")
def j15(t):
    row, col = G.grid_cell(F.col("latitude"), F.col("longitude"))
    return t.f_station.select("station_id", row.alias("grid_row"), col.alias("grid_col"))


#: Scenes cover the squares that arrays stand in, about as many to a square at any size.
SCENES = """SELECT s_suppkey AS scene_id, s_suppkey AS rank, CAST(s_suppkey * 131 % 2900 AS DOUBLE) - 50 + FLOOR(s_suppkey / 133) * 3000 AS minx,
    CAST(s_suppkey * 197 % 2900 AS DOUBLE) - 50 AS miny, CAST(s_suppkey * 131 % 2900 AS DOUBLE) + 350 + FLOOR(s_suppkey / 133) * 3000 AS maxx,
    CAST(s_suppkey * 197 % 2900 AS DOUBLE) + 350 AS maxy FROM supplier"""


@query("j16_best_scene", f"""
    WITH s AS ({SCENES}), o AS (SELECT b.array_id, s.scene_id, s.rank, GREATEST(0e0, LEAST(b.maxx, s.maxx) - GREATEST(b.minx, s.minx))
        * GREATEST(0e0, LEAST(b.maxy, s.maxy) - GREATEST(b.miny, s.miny)) / ((b.maxx - b.minx) * (b.maxy - b.miny)) AS overlap FROM f_rect b CROSS JOIN s),
      k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY array_id ORDER BY LEAST(overlap, 999e-3) DESC, rank) AS rn FROM o WHERE overlap > 0)
    SELECT r.array_id, k.scene_id, k.overlap FROM f_rect r LEFT JOIN k ON k.array_id = r.array_id AND k.rn = 1""", "overlap")
def j16(t):
    return S.best_scene(t.f_rect, t.sql(SCENES))


@query("j17_clip_to_tiles", """
    WITH g AS (SELECT c AS tile_col, r AS tile_row FROM (SELECT UNNEST(RANGE(0, 5)) AS c) x CROSS JOIN (SELECT UNNEST(RANGE(0, 5)) AS r) y),
      w AS (SELECT *, tile_col * 640e0 AS x0, tile_row * 640e0 AS y0, LEAST(640e0, 3030 - tile_col * 640e0) AS tw, LEAST(640e0, 3020 - tile_row * 640e0) AS th FROM g),
      c AS (SELECT array_id, tile_row, tile_col, (GREATEST(x0, LEAST(x0 + tw, minx)) - x0) / 640 AS minx, (GREATEST(y0, LEAST(y0 + th, miny)) - y0) / 640 AS miny,
        (GREATEST(x0, LEAST(x0 + tw, maxx)) - x0) / 640 AS maxx, (GREATEST(y0, LEAST(y0 + th, maxy)) - y0) / 640 AS maxy
        FROM f_rect JOIN w ON maxx >= x0 AND minx <= x0 + tw AND maxy >= y0 AND miny <= y0 + th)
    SELECT * FROM c WHERE maxx > minx""", "minx, miny, maxx, maxy", digits=9)
def j17(t):
    # Only consecutive repeats go: a box touching a tile from above or below keeps three vertices, from the side two.
    out = S.clip_to_tiles(rings(t), "array_id", F.lit(3030), F.lit(3020))
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    return out.select("array_id", "tile_row", "tile_col", minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


COMP = """WITH RECURSIVE r AS (SELECT * FROM f_rect WHERE (maxx - minx) * (maxy - miny) > 1),
    e AS MATERIALIZED (SELECT a.array_id AS a, b.array_id AS b FROM r a JOIN r b ON a.array_id <> b.array_id
      AND LEAST(a.maxx, b.maxx) >= GREATEST(a.minx, b.minx) AND LEAST(a.maxy, b.maxy) >= GREATEST(a.miny, b.miny)
      AND (LEAST(a.maxx, b.maxx) > GREATEST(a.minx, b.minx) OR LEAST(a.maxy, b.maxy) > GREATEST(a.miny, b.miny))),
    reach AS (SELECT array_id AS id, array_id AS other FROM r UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
    comp AS (SELECT id AS array_id, MIN(other) AS component FROM reach GROUP BY 1)"""


@query("a29_dissolve_components", COMP + " SELECT array_id, component FROM comp")
def a29(t):
    return P.dissolve(t.f_rect).select("array_id", "component")


UNION_AREA = COMP + """, m AS (SELECT c.component, r.* FROM comp c JOIN r USING (array_id)),
    x AS (SELECT component, minx AS s0 FROM m UNION SELECT component, maxx FROM m),
    s AS (SELECT component, s0, LEAD(s0) OVER (PARTITION BY component ORDER BY s0) AS s1 FROM x),
    i AS (SELECT s.component, s0, s1, miny, maxy, MAX(maxy) OVER (PARTITION BY s.component, s0 ORDER BY miny, maxy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
      FROM s JOIN m ON m.component = s.component AND minx <= s0 AND maxx >= s1),
    u AS (SELECT component, SUM((s1 - s0) * GREATEST(0e0, maxy - GREATEST(miny, COALESCE(seen, miny)))) AS union_area FROM i GROUP BY 1),
    n AS (SELECT component, COUNT(*) AS n_members FROM comp GROUP BY 1)
    SELECT * FROM u JOIN n USING (component)"""


@query("a29_dissolve_union_area", UNION_AREA, "union_area")
def a29_area(t):
    parts = P.dissolve(t.f_rect)
    return P.union_area(parts, ["component"]).join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_members")), "component")


def turned_rings(t):
    # Turned boxes overlap as the boxes do, while the boxes around them overlap far more often.
    return rings(t).select("array_id", P.turned(F.col("ring")).alias("ring"))


@query("a29_dissolve_polygons", COMP + " SELECT array_id, component FROM comp")
def a29_polygons(t):
    return P.dissolve_polygons(turned_rings(t), min_area=25.0).select("array_id", "component")


@query("a29_polygon_union_area", UNION_AREA, "union_area")
def a29_polygon_area(t):
    parts = P.dissolve_polygons(turned_rings(t), min_area=25.0)
    areas = P.polygon_union_area(parts, ["component"], 500.0).withColumn("union_area", F.col("union_area") / 25)
    return areas.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_members")), "component")


CLUSTERS = """WITH RECURSIVE c AS (SELECT tile_id, gt_idx, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM f_gt),
    e AS MATERIALIZED (SELECT a.tile_id, a.gt_idx AS a, b.gt_idx AS b FROM c a JOIN c b ON a.tile_id = b.tile_id AND a.gt_idx <> b.gt_idx
      AND SQRT(POWER(a.cx - b.cx, 2) + POWER(a.cy - b.cy, 2)) <= 20),
    reach AS (SELECT tile_id, gt_idx AS id, gt_idx AS other FROM c UNION SELECT reach.tile_id, reach.id, e.b FROM reach JOIN e ON e.tile_id = reach.tile_id AND e.a = reach.other),
    cl AS (SELECT tile_id, id AS gt_idx, MIN(other) AS cluster FROM reach GROUP BY 1, 2)"""


def panels(t):
    return t.f_gt.withColumn("cx", (F.col("x1") + F.col("x2")) / 2).withColumn("cy", (F.col("y1") + F.col("y2")) / 2)


@query("a30_merge_panels", CLUSTERS + " SELECT * FROM cl")
def a30(t):
    return C.merge_panels(panels(t))


@query("a30_merged_hulls", CLUSTERS + """ SELECT cl.tile_id, cl.cluster, MIN(x1) AS minx, MIN(y1) AS miny, MAX(x2) AS maxx, MAX(y2) AS maxy
    FROM cl JOIN f_gt g ON g.tile_id = cl.tile_id AND g.gt_idx = cl.gt_idx GROUP BY 1, 2""", "minx, miny, maxx, maxy")
def a30_hulls(t):
    joined = C.merge_panels(panels(t), keep=["x1", "y1", "x2", "y2"])
    corner = F.explode(G.box_ring(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    points = joined.select("tile_id", "cluster", corner.alias("p")).select("tile_id", "cluster", "p.x", "p.y")
    minx, miny, maxx, maxy = G.bounds(F.col("hull"))
    return C.group_hulls(points, ["tile_id", "cluster"]).select(
        "tile_id", "cluster", minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


@query("m01_spatial_clusters", """
    WITH m AS (SELECT AVG(latitude) AS ml FROM f_station), b AS (SELECT station_id,
        CAST(FLOOR(latitude * (1e0 / (1e0 / 111e0 * 50e0))) AS BIGINT) * 10000 + CAST(FLOOR(longitude * (1e0 / (1e0 / (111e0 * GREATEST(1e-1, COS(RADIANS(ml)))) * 50e0))) AS BIGINT) AS bin
      FROM f_station CROSS JOIN m)
    SELECT station_id, DENSE_RANK() OVER (ORDER BY bin) - 1 AS cluster FROM b""")
def m01(t):
    return S.spatial_clusters(t.f_station, 50.0).select("station_id", "cluster")
