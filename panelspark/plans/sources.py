"""Queries: scans and sinks, over raw payload texts that Spark builds from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.functions import multi as M
from panelspark.functions import names as N
from panelspark.functions import numeric as X
from panelspark.operators import daily as D
from panelspark.operators import labels as L
from panelspark.plans.detect import DET, detections
from panelspark.plans.registry import query
from panelspark.sources import scans as S
from panelspark.sources import sinks as K

STATION_TABLE = "SELECT s_suppkey AS station_id, s_nationkey AS state_no, s_acctbal FROM supplier"


def station_docs(t):
    """One JSON object keyed by station per station, with a mixed-type ratio and a nested annual block."""
    p = t.f_panel
    year = F.struct("year", F.array(
        F.col("year").cast("string"), F.when(F.col("iwsr_censored"), F.lit(">0.99")).otherwise(F.col("iwsr").cast("string")),
        F.col("iwsr_lower").cast("string"), F.col("iwsr_upper").cast("string")).alias("e"))
    annual = p.groupBy("station_id").agg(F.array_sort(F.collect_list(year)).alias("_y"))
    header = F.array(F.array(*[F.lit(h) for h in ("Year", "IWSR", "IWSR lower", "IWSR upper")]))
    st = t.f_station.join(annual, "station_id")
    sid = F.col("station_id")
    ratio = F.when(sid % 5 == 0, F.lit(">0.99")).when(sid % 17 != 0, (F.lit(0.9) + (sid % 100) / 1000.0).cast("string"))
    rec = F.struct(
        F.when(sid % 19 != 0, F.col("latitude")).alias("Latitude"), F.col("longitude").alias("Longitude"), ratio.alias("IWSR"),
        F.concat(header, F.transform("_y", lambda y: y["e"])).alias("Annual IWSR"))
    return st.select(F.to_json(F.create_map(sid.cast("string"), rec)).alias("value"))


@query("s03_station_json", """SELECT CAST(station_id AS VARCHAR) AS station_id, latitude, longitude,
    CASE WHEN station_id % 5 = 0 THEN 995e-3 ELSE 9e-1 + (station_id % 100) / 1e3 END AS iwsr, station_id % 5 = 0 AS iwsr_censored
    FROM f_station WHERE (station_id % 17 <> 0 OR station_id % 5 = 0) AND station_id % 19 <> 0""", "latitude, longitude, iwsr")
def s03(t):
    return S.station_summary(S.station_records(station_docs(t))).select("station_id", "latitude", "longitude", "iwsr", "iwsr_censored")


@query("s04_station_panel_json", """SELECT CAST(p.station_id AS VARCHAR) AS station_id, p.year, s.latitude,
    CASE WHEN iwsr_censored THEN 995e-3 ELSE iwsr END AS iwsr, iwsr_censored, iwsr_lower, iwsr_upper
    FROM f_panel p JOIN f_station s ON s.station_id = p.station_id WHERE p.station_id % 19 <> 0""", "latitude, iwsr, iwsr_lower, iwsr_upper", digits=9)
def s04(t):
    return S.station_panel(S.station_records(station_docs(t))).select(
        "station_id", "year", "latitude", "iwsr", "iwsr_censored", "iwsr_lower", "iwsr_upper")


def payloads(df, block, variables, keys, time):
    """Column-array documents, one per key group (a station-year here)."""
    rows = F.array_sort(F.collect_list(F.struct(time, *variables)))
    g = df.groupBy(*keys).agg(rows.alias("_r"))
    pick = lambda name: F.transform("_r", lambda x: x[name])
    cols = [F.transform(pick(time), lambda v: v.cast("string")).alias("time"), *[pick(v).alias(v) for v in variables]]
    # Nulls inside the arrays must survive the text form.
    return g.select(*keys, F.to_json(F.struct(F.struct(*cols).alias(block)), {"ignoreNullFields": "false"}).alias("value"))


@query("s05_weather_payload", """SELECT station_id, dt, precipitation_sum, CASE WHEN station_id % 5 <> 0 THEN wind_speed_10m_max END AS wind_speed_10m_max
    FROM f_daily""", "precipitation_sum, wind_speed_10m_max")
def s05(t):
    days, keys = t.f_daily.withColumn("yr", F.year("dt")), ["station_id", "yr"]
    # Every fifth station's payload lacks the wind.
    docs = payloads(days.where("station_id % 5 <> 0"), "daily", ["precipitation_sum", "wind_speed_10m_max"], keys, "dt").unionByName(
        payloads(days.where("station_id % 5 = 0"), "daily", ["precipitation_sum"], keys, "dt"))
    broken = docs.select("station_id", "yr", F.lit('{"error": true, "reason": "limit"}').alias("value"))
    rows, _ = S.weather_payload(docs.unionByName(broken), ["precipitation_sum", "wind_speed_10m_max"])
    return rows


@query("s06_air_quality_payload", """SELECT station_id, CAST(ts AS DATE) AS dt, AVG(pm2_5) AS pm2_5, AVG(pm10) AS pm10
    FROM f_hourly WHERE ts >= TIMESTAMP '2013-01-01 00:00:00' GROUP BY 1, 2""", "pm2_5, pm10")
def s06(t):
    # A document holds at most a thousand readings, however busy the station.
    h = t.f_hourly.withColumn("chunk", F.floor(F.col("event_id") / 1000))
    docs = payloads(h, "hourly", ["pm2_5", "pm10"], ["station_id", "chunk"], "ts")
    rows, _ = S.air_quality_payload(docs)
    return rows.groupBy("station_id", F.to_date("ts").alias("dt")).agg(F.avg("pm2_5").alias("pm2_5"), F.avg("pm10").alias("pm10"))


ASCII = """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS dt, l_linenumber,
    CASE l_linenumber WHEN 1 THEN 'DUSMASS25' WHEN 2 THEN 'BCSMASS' WHEN 3 THEN 'OCSMASS' WHEN 4 THEN 'SO4SMASS'
         WHEN 5 THEN 'SSSMASS25' WHEN 6 THEN 'DUSMASS' ELSE 'SSSMASS' END AS v, l_quantity FROM lineitem"""


@query("s07_reanalysis_text", f"""WITH s AS ({ASCII}), m AS (SELECT station_id, dt, v, AVG(CASE WHEN l_quantity = 7 THEN NULL ELSE l_quantity END) AS q FROM s GROUP BY 1, 2, 3)
    SELECT station_id, dt, SUM(CASE WHEN v NOT IN ('DUSMASS', 'SSSMASS') THEN COALESCE(q, 0) ELSE 0 END) AS pm2_5,
      SUM(CASE WHEN v NOT IN ('DUSMASS25', 'SSSMASS25') THEN COALESCE(q, 0) ELSE 0 END) AS pm10 FROM m GROUP BY 1, 2""", "pm2_5, pm10")
def s07(t):
    value = F.when(F.col("l_quantity") == 7, F.lit("nan")).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit("e-9")))
    line = F.concat(F.col("v"), F.lit("."), F.col("v"), F.lit("["), F.col("v"), F.lit(".time="), F.col("l_linenumber").cast("string"), F.lit("], "), value)
    text = t.sql(ASCII).select("station_id", "dt", F.explode(F.array(F.lit("Dataset {"), line)).alias("value"))
    return D.species_means(S.reanalysis_lines(text, ["station_id", "dt"]), ["station_id", "dt"])


@query("s08_elevation_payload", "SELECT station_id, CAST(station_id * 7 % 900 AS DOUBLE) AS elevation_m FROM f_station WHERE station_id % 9 <> 0", "elevation_m")
def s08(t):
    sid = F.col("station_id")
    doc = F.when(sid % 9 == 0, F.lit('{"elevation": []}')).otherwise(F.concat(F.lit('{"elevation": ['), (sid * 7 % 900).cast("string"), F.lit(".0]}")))
    return S.elevation_payload(t.f_station.select("station_id", doc.alias("value")))[0]


ROADS = """SELECT c_custkey, CAST(c_custkey * 41 % 10000 AS DOUBLE) / 1000 + 32.5 AS lat, CAST(c_custkey * 67 % 10000 AS DOUBLE) / 1000 - 124 AS lon,
    CASE c_custkey % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' ELSE 'secondary_link' END AS kind FROM customer"""


@query("s09_map_elements", f"""SELECT kind, lat, lon FROM ({ROADS}) r WHERE c_custkey % 3 = 0
    UNION ALL SELECT kind, lat + 1e-2, lon FROM ({ROADS}) r WHERE c_custkey % 3 <> 0
    UNION ALL SELECT kind, lat, lon + 1e-2 FROM ({ROADS}) r WHERE c_custkey % 3 <> 0""", "lat, lon")
def s09(t):
    node = F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    way = F.array(F.struct((F.col("lat") + 0.01).alias("lat"), F.col("lon").alias("lon")), F.struct(F.col("lat").alias("lat"), (F.col("lon") + 0.01).alias("lon")))
    is_node = F.col("c_custkey") % 3 == 0
    el = F.struct(F.when(is_node, node["lat"]).alias("lat"), F.when(is_node, node["lon"]).alias("lon"),
                  F.create_map(F.lit("highway"), F.col("kind")).alias("tags"), F.when(~is_node, way).alias("geometry"))
    docs = t.sql(ROADS).select(F.to_json(F.struct(F.array(el).alias("elements"))).alias("value"))
    return S.map_elements(docs).select(F.col("tags")["highway"].alias("kind"), "lat", "lon")


@query("s09_highway_filter", f"SELECT kind, COUNT(*) AS n FROM ({ROADS}) r WHERE kind <> 'residential' GROUP BY 1")
def s09_filter(t):
    tags = F.create_map(F.lit("highway"), F.col("kind"))
    return t.sql(ROADS).where(S.is_highway(tags)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s10_geojson_scan", "SELECT array_id, 32610 AS srid, minx, miny, maxx, maxy FROM f_rect", "minx, miny, maxx, maxy")
def s10(t):
    ring = G.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    feature = K.feature_json(ring, F.struct(F.col("array_id").alias("id"), F.lit("solar_array").alias("class_name")))
    docs = t.f_rect.select(F.concat(
        F.lit('{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32610"}}, "features": ['),
        feature, F.lit("]}")).alias("value"))
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    return S.geojson_collection(docs).select(F.col("properties")["id"].cast("bigint").alias("array_id"), "srid",
                                             minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))


@query("s10_f10_f13_multipolygons", """WITH b AS (SELECT *, maxx - minx AS w, maxy - miny AS h, (minx + maxx) / 2 AS mx, (miny + maxy) / 2 AS my FROM f_rect)
    SELECT array_id, 2 AS n_parts, 175e-2 * w * h AS area_m2, 5 * (w + h) AS perimeter_m, (75e-2 * mx + mx + w + 10) / 175e-2 AS centroid_x, my AS centroid_y,
      minx, maxx + w + 10 AS maxx, FALSE AS in_hole, TRUE AS in_part FROM b""", "area_m2, perimeter_m, centroid_x, centroid_y, minx, maxx")
def s10_multi(t):
    # A box with a hole of half its sides in the middle, and a second box beside it; every other one turns the other way.
    at = lambda x, y: f"concat('[', {x}, ',', {y}, ']')"
    ring = lambda x0, y0, x1, y1: "concat('[', array_join(" + f"CASE WHEN array_id % 2 = 0 THEN {{0}} ELSE reverse({{0}}) END".format(
        f"array({at(x0, y0)}, {at(x1, y0)}, {at(x1, y1)}, {at(x0, y1)}, {at(x0, y0)})") + ", ','), ']')"
    w, h = "(maxx - minx)", "(maxy - miny)"
    outline, hole = ring("minx", "miny", "maxx", "maxy"), ring(f"minx + {w} / 4", f"miny + {h} / 4", f"maxx - {w} / 4", f"maxy - {h} / 4")
    beside = ring(f"minx + {w} + 10", "miny", f"maxx + {w} + 10", "maxy")
    feature = f"""concat('{{"type": "Feature", "properties": {{"id": "', array_id, '"}}, "geometry": {{"type": "MultiPolygon", "coordinates": [[', {outline}, ',', {hole}, '],[', {beside}, ']]}}}}')"""
    docs = t.f_rect.selectExpr(f"""concat('{{"type": "FeatureCollection", "features": [', {feature}, ']}}') as value""", "minx as west", "miny as south", "maxx as east", "maxy as north")
    rows, g = S.geojson_collection(docs), F.col("polygons")
    cx, cy = M.centroid(g)
    minx, _, maxx, _ = M.bounds(g)
    mx, my = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    return rows.select(
        F.col("properties")["id"].cast("bigint").alias("array_id"), F.size(g).alias("n_parts"), M.area(g).alias("area_m2"), M.perimeter(g).alias("perimeter_m"),
        cx.alias("centroid_x"), cy.alias("centroid_y"), minx.alias("minx"), maxx.alias("maxx"), M.contains(g, mx, my).alias("in_hole"),
        M.contains(g, mx + (F.col("east") - F.col("west")) + 10, my).alias("in_part"))


@query("s11_geojson_features", """SELECT array_id, risk_score, maxx FROM f_rect JOIN f_risk USING (array_id)""", "risk_score, maxx")
def s11(t):
    ring = G.box_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    text = t.f_rect.join(t.f_risk, "array_id", "left").select(K.feature_json(ring, F.struct("array_id", "risk_score")).alias("value"))
    rows = S.feature_rows(text.select(F.from_json("value", S.FEATURE_TYPE).alias("feature")))
    return rows.select(F.col("properties")["array_id"].cast("bigint").alias("array_id"),
                       F.col("properties")["risk_score"].cast("double").alias("risk_score"), G.bounds(F.col("ring"))[2].alias("maxx"))


@query("s12_label_lines", """SELECT tile_id, line_no, 0 AS class_id, 3 AS n_points, CASE WHEN line_no = 3 THEN 75e-2 ELSE 1e0 END AS conf,
    CAST(SPLIT_PART(line, ' ', 2) AS DOUBLE) AS first_x, CAST(SPLIT_PART(line, ' ', 7) AS DOUBLE) AS last_y FROM f_line WHERE line_no <> 4""",
       "conf, first_x, last_y")
def s12(t):
    p = S.label_lines(t.f_line)
    return p.select("tile_id", "line_no", "class_id", F.size("ring").alias("n_points"), "conf",
                    F.col("ring")[0]["x"].alias("first_x"), F.element_at("ring", -1)["y"].alias("last_y"))


def _six(v):
    return f"PRINTF('%.6f', {v})"


@query("s13_label_text", f"""SELECT tile_id, gt_idx, CONCAT('0 ', {_six('x1 / 1000')}, ' ', {_six('y1 / 1000')}, ' ', {_six('x2 / 1000')}, ' ', {_six('y1 / 1000')}, ' ',
    {_six('x2 / 1000')}, ' ', {_six('y2 / 1000')}, ' ', {_six('x1 / 1000')}, ' ', {_six('y2 / 1000')}) AS line FROM f_gt""")
def s13(t):
    ring = G.box_ring(F.col("x1") / 1000, F.col("y1") / 1000, F.col("x2") / 1000, F.col("y2") / 1000)
    return t.f_gt.select("tile_id", "gt_idx", K.label_line(ring).alias("line"))


@query("s14_coco_lines", f"""SELECT CONCAT('img_', CAST(g.tile_id AS VARCHAR)) AS tile, gt_idx AS ann_id, CASE WHEN gt_idx NOT IN (2, 5) THEN
    CONCAT('0 ', {_six('x1 / 1000')}, ' ', {_six('y1 / 800')}, ' ', {_six('x2 / 1000')}, ' ', {_six('y1 / 800')}, ' ', {_six('x2 / 1000')}, ' ', {_six('y2 / 800')}) END AS line
    FROM f_gt g WHERE gt_idx NOT IN (2, 5)
    UNION ALL SELECT DISTINCT CONCAT('img_', CAST(tile_id AS VARCHAR)), CAST(NULL AS BIGINT), NULL FROM f_gt a
      WHERE NOT EXISTS (SELECT 1 FROM f_gt b WHERE b.tile_id = a.tile_id AND b.gt_idx NOT IN (2, 5))""")
def s14(t):
    seg = F.when(F.col("gt_idx") == 2, F.lit('{"counts": [1, 2], "size": [3, 4]}')).when(F.col("gt_idx") == 5, F.lit("[[1.0, 2.0, 3.0, 4.0]]")).otherwise(
        F.to_json(F.array(F.array("x1", "y1", "x2", "y1", "x2", "y2"))))
    ann = F.concat(F.lit('{"id": '), F.col("gt_idx").cast("string"), F.lit(', "image_id": '), F.col("tile_id").cast("string"), F.lit(', "segmentation": '), seg, F.lit("}"))
    # One document per image here; a document may hold any number of images.
    per = t.f_gt.groupBy("tile_id", F.floor(F.col("gt_idx") / 1000)).agg(F.array_join(F.collect_list(ann), ", ").alias("_a"))
    doc = F.concat(F.lit('{"images": [{"id": '), F.col("tile_id").cast("string"), F.lit(', "file_name": "sub/img_'), F.col("tile_id").cast("string"),
                   F.lit('.jpg", "width": 1000, "height": 800}], "annotations": ['), F.col("_a"), F.lit("]}"))
    return S.coco_lines(per.select(doc.alias("value"))).select("tile", "ann_id", "line")


PATHS = """SELECT o_orderkey, CONCAT('/data/export/', CASE o_orderkey % 5 WHEN 0 THEN 'images/train/' WHEN 1 THEN 'valid/images/' WHEN 2 THEN 'labels/val/'
    WHEN 3 THEN 'test/labels/' ELSE 'misc/' END, 'tile_', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 5 < 2 THEN '.png' ELSE '.txt' END) AS path FROM orders"""


@query("s15_export_layout", f"""SELECT path, CASE o_orderkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'val' WHEN 3 THEN 'test' END AS split,
    CASE WHEN o_orderkey % 5 < 2 THEN 'image' ELSE 'label' END AS kind, CONCAT('tile_', CAST(o_orderkey AS VARCHAR)) AS stem FROM ({PATHS}) p""")
def s15(t):
    return S.export_layout(t.sql(PATHS)).drop("o_orderkey")


@query("s16_tile_index", """SELECT CONCAT('tile_', CAST(o_orderkey AS VARCHAR), '.png') AS tile_name, 'EPSG:32610' AS crs, 640 AS width,
    CAST(o_orderkey AS DOUBLE) AS origin_x FROM orders""", "origin_x")
def s16(t):
    key = F.col("o_orderkey")
    entry = F.struct(F.array(F.lit(0.6), F.lit(0.0), key.cast("double"), F.lit(0.0), F.lit(-0.6), F.lit(0.0)).alias("transform"),
                     F.lit("EPSG:32610").alias("crs"), F.lit(640).alias("width"), F.lit(640).alias("height"))
    tiles = F.create_map(F.concat(F.lit("tile_"), key.cast("string"), F.lit(".png")), entry)
    doc = F.when(key % 2 == 0, F.to_json(F.struct(tiles.alias("tiles")))).otherwise(F.to_json(tiles))
    return S.tile_index(t.orders.select(doc.alias("value"))).select("tile_name", "crs", "width", F.col("transform")[2].alias("origin_x"))


STATIC = """SELECT c_custkey AS row_no, CAST(c_custkey % 300 AS DOUBLE) / 1000 + 35.0002 AS latitude, CAST(c_custkey % 300 * 3 AS DOUBLE) / 1000 - 119.9998 AS longitude,
    c_acctbal AS elevation_m, CASE c_custkey % 4 WHEN 0 THEN 'cropland' WHEN 1 THEN 'built_up' WHEN 2 THEN 'unknown' ELSE 'grass' END AS bucket FROM customer"""


@query("s21_static_lookup", f"""WITH s AS ({STATIC}), k AS (SELECT CAST(ROUND_EVEN(latitude * 1000, 0) AS BIGINT) AS lat_key, CAST(ROUND_EVEN(longitude * 1000, 0) AS BIGINT) AS lon_key, elevation_m, bucket, row_no FROM s)
    SELECT lat_key, lon_key, ARG_MAX(elevation_m, row_no) AS elevation_m, ARG_MAX(bucket, row_no) AS bucket FROM k GROUP BY 1, 2""", "elevation_m", digits=2)
def s21(t):
    return S.static_lookup(t.sql(STATIC), "row_no")


SITES = """SELECT p_partkey AS site_id, CAST(p_partkey % 400 AS DOUBLE) / 1000 + 35.00021 AS latitude, CAST(p_partkey % 400 * 3 AS DOUBLE) / 1000 - 119.99979 AS longitude FROM part"""


@query("j04_static_features", f"""WITH s AS ({STATIC}), k AS (SELECT CAST(ROUND_EVEN(latitude * 1000, 0) AS BIGINT) AS a, CAST(ROUND_EVEN(longitude * 1000, 0) AS BIGINT) AS b, elevation_m, bucket, row_no FROM s),
    l AS (SELECT a, b, ARG_MAX(elevation_m, row_no) AS elevation_m, ARG_MAX(bucket, row_no) AS bucket FROM k GROUP BY 1, 2)
    SELECT site_id, COALESCE(l.elevation_m, -1) AS elevation_m, CASE WHEN bucket = 'cropland' THEN 1e0 ELSE 0e0 END AS worldcover_cropland, l.a IS NOT NULL AS from_lookup
    FROM ({SITES}) p LEFT JOIN l ON l.a = CAST(ROUND_EVEN(latitude * 1000, 0) AS BIGINT) AND l.b = CAST(ROUND_EVEN(longitude * 1000, 0) AS BIGINT)""",
       "elevation_m, worldcover_cropland", digits=2)
def j04(t):
    from panelspark.operators.joins import with_static_features
    lookup = S.static_lookup(t.sql(STATIC), "row_no")
    out = with_static_features(t.sql(SITES), lookup, {"elevation_m": F.lit(-1.0)}, bucket="bucket")
    return out.select("site_id", "elevation_m", "worldcover_cropland", "from_lookup")


@query("s22_run_metrics", """SELECT CONCAT('run_', CAST(n_nationkey AS VARCHAR)) AS run, 'binary' AS target, (600 + n_nationkey * 7) / 1e3 AS auc,
    CASE WHEN n_nationkey % 3 = 0 THEN (100 + n_nationkey) / 1e3 END AS spearman, 2 AS n_auc FROM nation""", "auc, spearman")
def s22(t):
    k = F.col("n_nationkey")
    doc = F.to_json(F.struct(((600 + k * 7) / 1000.0).alias("mean_auc"), F.when(k % 3 == 0, (100 + k) / 1000.0).alias("mean_spearman"),
                             F.array((k / 100.0), (k / 50.0)).alias("fold_aucs")))
    raw = t.nation.select(F.concat(F.lit("run_"), k.cast("string")).alias("run"), doc.alias("value"))
    return S.run_metrics(raw).select("run", "target", "auc", "spearman", F.size("fold_aucs").alias("n_auc"))


FEEDBACK = """SELECT CONCAT('p', CAST(o_orderkey % 7 AS STRING)) AS partner_id, CAST(o_custkey AS BIGINT) AS array_id, CAST(o_orderdate AS DATE) AS cleaned_at,
    CAST(100 + o_orderkey % 50 AS DOUBLE) AS pre_clean_kwh_7d, CAST(100 + o_orderkey % 50 + o_orderkey % 23 AS DOUBLE) AS post_clean_kwh_7d FROM orders"""
PCT = X.round_binary_sql("((post_clean_kwh_7d - pre_clean_kwh_7d) / pre_clean_kwh_7d * 100)", 2)
CENTROIDS = """SELECT CONCAT('p', CAST(p.n AS STRING)) AS partner_id, c.c_custkey AS array_id, CAST(c.c_custkey % 90 AS DOUBLE) AS latitude, CAST(c.c_custkey % 170 AS DOUBLE) AS longitude
    FROM (SELECT c_custkey, c_custkey % 7 AS n FROM customer UNION SELECT c_custkey, c_custkey % 5 AS n FROM customer) c
    JOIN (SELECT n_nationkey AS n FROM nation) p ON c.n = p.n"""


@query("s23_feedback_labels", f"""WITH f AS (SELECT *, {PCT} AS pct FROM ({FEEDBACK}) x), c AS ({CENTROIDS})
    SELECT CONCAT(f.partner_id, '_array_', CAST(f.array_id AS VARCHAR)) AS station_id, c.latitude, c.longitude, f.cleaned_at AS as_of,
      GREATEST(0e0, 1 - pct / 100) AS iwsr, CAST(GREATEST(0e0, 1 - pct / 100) < 0.97 AS INT) AS label, CAST(EXTRACT(YEAR FROM f.cleaned_at) AS INT) AS year, TRUE AS is_feedback
    FROM f JOIN c ON c.partner_id = f.partner_id AND c.array_id = f.array_id""", "latitude, longitude, iwsr")
def s23(t):
    events = K.feedback_record(t.sql(FEEDBACK)).drop("submitted_at")
    return L.feedback_labels(events, t.sql(CENTROIDS), 0.97)[0]


@query("j06_unmatched_feedback", f"""WITH f AS ({FEEDBACK}), c AS ({CENTROIDS}) SELECT partner_id, array_id, cleaned_at FROM f
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.partner_id = f.partner_id AND c.array_id = f.array_id)""")
def j06(t):
    events = K.feedback_record(t.sql(FEEDBACK)).drop("submitted_at")
    return L.feedback_labels(events, t.sql(CENTROIDS), 0.97)[1].select("partner_id", "array_id", "cleaned_at")


@query("s24_f20_feedback_recovery", f"SELECT partner_id, array_id, cleaned_at, {PCT} AS actual_recovery_pct FROM ({FEEDBACK}) x", "actual_recovery_pct")
def s24(t):
    return K.feedback_record(t.sql(FEEDBACK)).select("partner_id", "array_id", "cleaned_at", "actual_recovery_pct")


@query("f21_pseudo_ratio", f"SELECT partner_id, array_id, cleaned_at, GREATEST(0e0, 1 - {PCT} / 100) AS iwsr FROM ({FEEDBACK}) x", "iwsr")
def f21(t):
    return K.feedback_record(t.sql(FEEDBACK)).select("partner_id", "array_id", "cleaned_at", X.pseudo_iwsr(F.col("actual_recovery_pct")).alias("iwsr"))


VERTICES = """SELECT l_orderkey * 10 + l_linenumber AS polygon_id, CAST(3 + (l_linenumber + 1) % 3 AS INT) AS number_vertices, l_quantity AS lat1, l_tax AS lon1,
    l_quantity + 1 AS lat2, l_tax AS lon2, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity + 1 END AS lat3, l_tax + 1 AS lon3, l_quantity AS lat4, l_tax + 1 AS lon4,
    l_quantity AS lat5, l_tax + 2 AS lon5 FROM lineitem"""


@query("s25_wide_vertices", f"""WITH v AS (SELECT polygon_id, CASE WHEN lat3 IS NULL THEN number_vertices - 1 ELSE number_vertices END AS n_points, lat1, lon1 FROM ({VERTICES}) x)
    SELECT polygon_id, n_points, lat1 AS first_y, lon1 AS first_x FROM v WHERE n_points >= 3""", "first_y, first_x")
def s25(t):
    return S.wide_vertices(t.sql(VERTICES), ["polygon_id"]).select(
        "polygon_id", F.size("ring").alias("n_points"), F.col("ring")[0]["y"].alias("first_y"), F.col("ring")[0]["x"].alias("first_x"))


@query("j03_vertices_with_image", """SELECT l_orderkey * 10 + l_linenumber AS polygon_id, CONCAT('img_', CAST(o_orderkey AS VARCHAR)) AS image_name
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 4 <> 0""")
def j03(t):
    from panelspark.operators.joins import vertices_with_image
    meta = t.orders.where("o_orderkey % 4 <> 0").select(
        F.col("o_orderkey").alias("order_no"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("image_name"), "o_totalprice")
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("polygon_id"), F.col("l_orderkey").alias("order_no"))
    return vertices_with_image(rows, meta, "order_no").drop("order_no")


@query("s26_recommendation_payload", None)
def s26(t):
    from panelspark.plans.recommend import decisions
    doc = K.recommendation_payload(decisions(t))
    return doc.select("aoi_id", F.to_json(F.struct(*[c for c in doc.columns if c != "aoi_id"])).alias("payload"))


S18_DIGITS = {"iou": 4, "conf": 4, "pred_area_px": 2, "gt_area_px": 2, "pred_centroid_x": 2, "pred_centroid_y": 2, "gt_centroid_x": 2,
              "gt_centroid_y": 2, "distance_to_image_edge_px": 2, "pred_aspect": 3, "gt_aspect": 3}


@query("s18_per_detection_table", DET + " SELECT tile_id, 'aerial' AS domain, 'test' AS split, class, num_other_panels_in_tile, 'run_1' AS weights_run, "
       + ", ".join(f"{X.round_binary_sql(c, d)} AS {c}" for c, d in S18_DIGITS.items()) + " FROM det", ", ".join(S18_DIGITS))
def s18(t):
    return K.per_detection_table(detections(t), "aerial", "test", "run_1")


@query("s29_unseen_tiles", "SELECT DISTINCT tile_id FROM f_gt WHERE tile_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def s29(t):
    log = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("tile_id"))
    return S.unseen(t.f_gt.select("tile_id").distinct(), log)


@query("s30_forecast_payload", "SELECT aoi_id, CAST(day_no AS INT) AS day_no, rain_mm FROM f_forecast", "rain_mm")
def s30(t):
    rows = t.f_forecast.groupBy("aoi_id").agg(F.array_sort(F.collect_list(F.struct("day_no", F.when(F.col("rain_mm") != 0, F.col("rain_mm")).alias("r")))).alias("_r"))
    doc = F.to_json(F.struct(F.struct(F.transform("_r", lambda x: x["r"]).alias("precipitation_sum")).alias("daily")), {"ignoreNullFields": "false"})
    return S.forecast_payload(rows.select("aoi_id", doc.alias("value")))


@query("f15_p14_censored_ratio", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE l_linenumber WHEN 1 THEN 995e-3 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE l_tax END AS iwsr,
    l_linenumber IN (1, 2) AS censored FROM lineitem""", "iwsr")
def f15(t):
    text = F.when(F.col("l_linenumber") == 1, ">0.99").when(F.col("l_linenumber") == 2, ">x").when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_tax").cast("string"))
    value, flag = X.censored_ratio(text)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", value.alias("iwsr"), flag.alias("censored"))


@query("f16_reanalysis_stream", """SELECT o_orderkey, CASE WHEN y >= 2011 THEN '400' WHEN y >= 2001 THEN '300' WHEN y >= 1992 THEN '200' ELSE '100' END AS stream
    FROM (SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) + (o_orderkey % 40) - 15 AS y FROM orders) x""")
def f16(t):
    year = F.year("o_orderdate") + F.col("o_orderkey") % 40 - 15
    return t.orders.select("o_orderkey", X.reanalysis_stream(year).alias("stream"))


@query("f18_blank_and_round", f"""SELECT c_custkey, CASE WHEN c_custkey % 10 NOT IN (0, 1) THEN {X.round_binary_sql('c_acctbal / 7e0', 3)} END AS v FROM customer""", "v")
def f18(t):
    k = F.col("c_custkey") % 10
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 7.0)
    return t.customer.select("c_custkey", X.blank_round(v, 3).alias("v"))


NAMES = """SELECT o_orderkey, CONCAT('tile_', LPAD(CAST(o_orderkey AS STRING), 6, '0'), CASE o_orderkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '_png.rf.a1B2c3.jpg' ELSE '_png.rf.Z9.png' END) AS name,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'other_file.tif' ELSE CONCAT('naip_', CASE WHEN o_orderkey % 2 = 0 THEN 'sc' ELSE 'kern' END, '_', CAST(2016 + o_orderkey % 8 AS STRING), '_512_', CAST(o_orderkey AS STRING), '.tif') END AS source FROM orders"""


@query("p17_source_name", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 NOT IN (0, 1) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'sc' ELSE 'kern' END END AS region,
    CASE WHEN o_orderkey % 6 NOT IN (0, 1) THEN CAST(2016 + o_orderkey % 8 AS INT) END AS vintage FROM ({NAMES}) n""")
def p17(t):
    return t.sql(NAMES).select("o_orderkey", N.region(F.col("source")).alias("region"), N.vintage(F.col("source")).alias("vintage"))


@query("p18_canonical_tile", f"SELECT name, CONCAT('tile_', LPAD(CAST(o_orderkey AS VARCHAR), 6, '0'), '.png') AS tile, TRUE AS idempotent FROM ({NAMES}) n")
def p18(t):
    tile = N.canonical_tile(F.col("name"))
    return t.sql(NAMES).select("name", tile.alias("tile"), (N.canonical_tile(tile) == tile).alias("idempotent"))


@query("p20_partner_id", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN FALSE WHEN 1 THEN FALSE ELSE TRUE END AS valid FROM customer""")
def p20(t):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("-p"), k.cast("string"))).when(k % 5 == 1, F.lit("bad id!")).otherwise(F.concat(F.lit("p_"), k.cast("string")))
    return t.customer.select("c_custkey", N.valid_partner(name).alias("valid"))


@query("f19_window_text", """SELECT o_orderkey, CONCAT(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), ' → ', CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR)) AS w FROM orders""")
def f19(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.format_string("%s → %s", day.cast("string"), F.date_add(day, 7).cast("string")).alias("w"))


@query("f23_month_year", "SELECT o_orderkey, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS month_of_year, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year FROM orders")
def f23(t):
    return t.orders.select("o_orderkey", F.month("o_orderdate").alias("month_of_year"), F.year("o_orderdate").alias("year"))


@query("u04_s27_training_list", """SELECT path, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT CONCAT('a/', CAST(s_suppkey AS VARCHAR)) AS path FROM supplier CROSS JOIN RANGE(4)
    UNION ALL SELECT CONCAT('b/', CAST(p_partkey AS VARCHAR)) FROM part) u GROUP BY 1""")
def u04(t):
    a = t.supplier.select(F.concat(F.lit("a/"), F.col("s_suppkey").cast("string")).alias("path"))
    b = t.part.select(F.concat(F.lit("b/"), F.col("p_partkey").cast("string")).alias("path"))
    return K.training_list(a, b, 4).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


AOI_SPECS = """SELECT c_custkey, CASE c_custkey % 8
      WHEN 0 THEN CONCAT('-122.', CAST(100 + c_custkey % 800 AS STRING), ',36.5,-120.5,37.25') WHEN 1 THEN '0,0,0,0' WHEN 2 THEN '1,2,3' WHEN 3 THEN 'a,b,c,d'
      WHEN 4 THEN '-190,10,-170,20' WHEN 5 THEN 'Santa Cruz' WHEN 6 THEN 'nowhere' ELSE '10,-95,20,-80' END AS spec FROM customer"""


@query("p19_area_specs", f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'bbox' WHEN 5 THEN 'scene' END AS source,
      CASE c_custkey % 8 WHEN 0 THEN SUBSTR(SHA1(CONCAT('{{"coordinates":[[[-122.', RTRIM(CAST(100 + c_custkey % 800 AS VARCHAR), '0'), ',36.5],[-120.5,36.5],[-120.5,37.25],[-122.',
        RTRIM(CAST(100 + c_custkey % 800 AS VARCHAR), '0'), ',37.25],[-122.', RTRIM(CAST(100 + c_custkey % 800 AS VARCHAR), '0'), ',36.5]]],"type":"Polygon"}}')), 1, 10) WHEN 5 THEN 'santa_cruz' END AS aoi_id,
      CASE c_custkey % 8 WHEN 1 THEN 'degenerate' WHEN 2 THEN 'not_four_parts' WHEN 3 THEN 'not_numeric' WHEN 4 THEN 'longitude_range' WHEN 6 THEN 'unknown_scene' WHEN 7 THEN 'latitude_range' END AS error
    FROM ({AOI_SPECS}) a""")
def p19(t):
    from panelspark.operators.areas import parse_specs
    scenes = t.region.where("r_regionkey = 0").select(
        F.lit("santa_cruz").alias("scene"), F.lit(-122.1).alias("minx"), F.lit(36.85).alias("miny"), F.lit(-121.85).alias("maxx"), F.lit(37.05).alias("maxy"))
    return parse_specs(t.sql(AOI_SPECS), scenes).select("c_custkey", "source", "aoi_id", "error")
