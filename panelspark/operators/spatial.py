"""Spatial joins as grid-cell equi-joins, array geometry features, tiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.operators.cells import meeting
from panelspark.operators.components import convex_hull
from panelspark.operators.scale import sequential_ids
from panelspark.session import cut_lineage, spread


def in_box(df: DataFrame, box: Sequence[float] | None, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Inclusive (minx, miny, maxx, maxy) filter; plain comparisons, so a file scan can take them."""
    if box is None:
        return df
    minx, miny, maxx, maxy = box
    return df.where(F.col(lon).between(minx, maxx) & F.col(lat).between(miny, maxy))


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def box_gap(a: str, b: str) -> Column:
    """Distance between the boxes ``{a}minx..maxy`` and ``{b}minx..maxy``: a lower bound for what lies in them."""
    c = lambda side, n: F.col(f"{side}{n}")
    dx = F.greatest(F.lit(0.0), c(b, "minx") - c(a, "maxx"), c(a, "minx") - c(b, "maxx"))
    dy = F.greatest(F.lit(0.0), c(b, "miny") - c(a, "maxy"), c(a, "miny") - c(b, "maxy"))
    return F.sqrt(dx * dx + dy * dy)


def ring_edges(ring: Column) -> Column:
    """Edges of a ring with their number."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, nxt, lambda p, q: F.struct(
        p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))
    return F.transform(pairs, lambda e, i: F.struct(
        i.alias("i"), e["px"].alias("px"), e["py"].alias("py"), e["qx"].alias("qx"), e["qy"].alias("qy")))


def _point_segment2(x: Column, y: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """Squared distance from a point to a segment."""
    dx, dy = qx - px, qy - py
    along = F.try_divide((x - px) * dx + (y - py) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)), F.lit(0.0))
    ex, ey = x - px - t * dx, y - py - t * dy
    return ex * ex + ey * ey


def ring_distances(pairs: DataFrame, keys: Sequence[str], a: str = "a_edges", b: str = "b_edges",
                   boxed: str = "boxed", gap: str = "gap") -> DataFrame:
    """Exact polygon distance per pair (keys, d): 0 when outlines cross or one holds the other.

    A pair becomes one row per edge combination, so all the arithmetic is plain generated code and the minimum is
    combined inside the task. Pairs flagged ``boxed`` (both are axis-aligned boxes) carry their distance in ``gap``
    and need no edges.
    """
    one = lambda e: F.when(F.col(boxed), F.slice(F.col(e), 1, 1)).otherwise(F.col(e))
    rows = pairs.select(*keys, boxed, gap, F.inline(one(a)).alias("ai", "apx", "apy", "aqx", "aqy"), b)
    rows = rows.select(*keys, boxed, gap, "ai", "apx", "apy", "aqx", "aqy", F.inline(one(b)).alias("bi", "bpx", "bpy", "bqx", "bqy"))
    ap, aq = (F.col("apx"), F.col("apy")), (F.col("aqx"), F.col("aqy"))
    bp, bq = (F.col("bpx"), F.col("bpy")), (F.col("bqx"), F.col("bqy"))
    near = F.least(_point_segment2(*ap, *bp, *bq), _point_segment2(*aq, *bp, *bq),
                   _point_segment2(*bp, *ap, *aq), _point_segment2(*bq, *ap, *aq))
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    crossing = (side(ap, aq, bp) * side(ap, aq, bq) < 0) & (side(bp, bq, ap) * side(bp, bq, aq) < 0)
    # Ray casting: how often a ray from the first vertex of one ring meets the edges of the other.
    ray = lambda v, p, q: ((p[1] > v[1]) != (q[1] > v[1])) & (
        v[0] < p[0] + F.try_divide((q[0] - p[0]) * (v[1] - p[1]), q[1] - p[1]))
    d2 = F.when(F.col(boxed), F.col(gap) * F.col(gap)).when(crossing, F.lit(0.0)).otherwise(near)
    found = rows.groupBy(*keys).agg(
        F.min(d2).alias("_d2"), F.first(boxed).alias("_boxed"), F.first(gap).alias("_gap"),
        F.count_if((F.col("ai") == 0) & ray(ap, bp, bq)).alias("_in_b"), F.count_if((F.col("bi") == 0) & ray(bp, ap, aq)).alias("_in_a"))
    inside = (F.col("_in_b") % 2 == 1) | (F.col("_in_a") % 2 == 1)
    return found.select(*keys, F.when(F.col("_boxed"), F.col("_gap")).when(inside, F.lit(0.0)).otherwise(F.sqrt("_d2")).alias("d"))


def neighbor_features(arrays: DataFrame, key: str = "array_id", radii: Sequence[float] = (50.0, 100.0),
                      cell: float | None = None) -> DataFrame:
    """Neighbours within each radius, nearest distance, mean neighbour area within the 100 m radius.

    Candidates are arrays whose box meets the own box grown by the largest radius; both sides are replicated to
    the grid cells they cover, crowded cells cut smaller, and meet in an equi-join. Identical rings are handled once with their count, so a
    pile of copies adds no pairs. Without a candidate the distance and mean are null.
    """
    reach = max(radii)
    size = cell or 2 * reach
    shapes = arrays.groupBy("ring").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("head"))
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    shapes = shapes.select("ring", "copies", "head", minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"),
                           maxy.alias("maxy"), G.area(F.col("ring")).alias("area"), ring_edges(F.col("ring")).alias("edges"))
    is_box = (F.size("ring") == 4) & (F.col("area") == (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    shapes = shapes.withColumn("is_box", is_box)
    box = lambda side, grown: [(F.col(c) + d * grown).alias(f"{side}_{c}") for c, d in (("minx", -1), ("miny", -1), ("maxx", 1), ("maxy", 1))]
    own = shapes.select(*[F.col(c).alias(f"o_{c}") for c in ("head", "minx", "miny", "maxx", "maxy", "edges", "is_box")], *box("l", reach))
    other = shapes.drop("ring").select("*", *box("r", 0.0))
    # A shape meets itself once; that row stands for its other copies, at distance zero.
    itself = F.col("o_head") == F.col("head")
    pairs = meeting(own, other, size).select(
        "o_head", F.when(itself, F.col("copies") - 1).otherwise(F.col("copies")).alias("times"), "head", "area",
        (itself | (F.col("is_box") & F.col("o_is_box"))).alias("boxed"), box_gap("o_", "").alias("gap"),
        F.col("o_edges").alias("a_edges"), F.col("edges").alias("b_edges")).where(F.col("times") > 0)
    pairs = ring_distances(pairs, ["o_head", "head", "times", "area"])
    near = F.col("d") <= 100.0
    found = pairs.groupBy(F.col("o_head").alias("head")).agg(
        *[F.coalesce(F.sum(F.when(F.col("d") <= r, F.col("times"))), F.lit(0)).alias(f"neighbor_count_{int(r)}m") for r in radii],
        F.min("d").alias("distance_to_nearest_array_m"),
        (F.sum(F.when(near, F.col("times") * F.col("area"))) / F.sum(F.when(near, F.col("times")))).alias("mean_neighbor_area_100m"))
    counts = [f"neighbor_count_{int(r)}m" for r in radii]
    return arrays.select(key, "ring").join(shapes.select("ring", "head"), "ring").join(found, "head", "left").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "distance_to_nearest_array_m", "mean_neighbor_area_100m")


#: Sides of the cells that the nearest point is searched in, as parts of the first one.
STEP, STEPS = 4, 5


def _gap(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0.0), lo - v, v - hi)


def _at_least(lat: Column, lon: Column, cy: Column, cx: Column, side: float) -> Column:
    """No point of a cell is nearer than this."""
    south, west = cy * side, cx * side
    dy, dx = F.sin(F.radians(_gap(lat, south, south + side)) / 2), F.sin(F.radians(_gap(lon, west, west + side)) / 2)
    narrow = F.least(F.cos(F.radians(south)), F.cos(F.radians(south + side)))
    # A hair less, so that rounding never rules out a cell.
    return 2 * G.EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), dy * dy + F.cos(F.radians(lat)) * F.greatest(F.lit(0.0), narrow) * dx * dx))) * (1 - 1e-9) - 1e-6


def min_distance(sites: DataFrame, points: DataFrame, out: str, radius_m: float = 5000.0, key: str = "station_id",
                 cell_deg: float = 0.1) -> DataFrame:
    """Least haversine distance from a site to any point in its radius box; the radius when there is none.

    Points are summed up in cells of sides ``cell_deg``, a quarter of that and so on, each with one point of its own. A
    site visits the cells of its box and goes down into those only that may hold something nearer than the points it has
    seen, so what it meets depends on its distance and not on how many points a city has.
    """
    dlat, dlon = G.degrees_around(F.col("latitude"), radius_m)
    boxed = sites.select(key, F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude")).distinct().select(
        "*", dlat.alias("_dlat"), dlon.alias("_dlon"))
    sides = [cell_deg / STEP ** i for i in range(STEPS)]
    spots = points.select(F.col("lat").cast("double"), F.col("lon").cast("double")).where("lat is not null and lon is not null").distinct()
    fine = spots.select("lat", "lon", F.floor(F.col("lat") / sides[-1]).alias("_cy"), F.floor(F.col("lon") / sides[-1]).alias("_cx"))
    levels = [cut_lineage(fine.groupBy("_cy", "_cx").agg(F.min(F.struct("lat", "lon")).alias("_p")))]
    for _ in sides[1:]:
        up = levels[-1].groupBy(F.floor(F.col("_cy") / STEP).alias("_cy"), F.floor(F.col("_cx") / STEP).alias("_cx"))
        levels.append(cut_lineage(up.agg(F.min("_p").alias("_p"))))
    site = [key, "latitude", "longitude", "_dlat", "_dlon"]
    inside = lambda lat, lon: (F.abs(lat - F.col("latitude")) <= F.col("_dlat")) & (F.abs(lon - F.col("longitude")) <= F.col("_dlon"))
    here = boxed.withColumn("_cy", F.explode(_cells(F.col("latitude") - F.col("_dlat"), F.col("latitude") + F.col("_dlat"), cell_deg))).withColumn(
        "_cx", F.explode(_cells(F.col("longitude") - F.col("_dlon"), F.col("longitude") + F.col("_dlon"), cell_deg))).withColumn("_best", F.lit(None).cast("double"))
    for i, side in enumerate(sides):
        if i:
            child = lambda c: F.explode(F.sequence(c * STEP, c * STEP + (STEP - 1)))
            here = here.withColumn("_cy", child(F.col("_cy"))).withColumn("_cx", child(F.col("_cx")))
        met = here.join(levels[-1 - i], ["_cy", "_cx"])
        own = F.when(inside(F.col("_p.lat"), F.col("_p.lon")), G.haversine_m(F.col("latitude"), F.col("longitude"), F.col("_p.lat"), F.col("_p.lon")))
        best = F.min(F.least(F.col("_best"), own)).over(W.partitionBy(*site))
        low = _at_least(F.col("latitude"), F.col("longitude"), F.col("_cy"), F.col("_cx"), side)
        here = cut_lineage(met.withColumn("_best", best).where(F.col("_best").isNull() | (low <= F.col("_best"))).select(*site, "_cy", "_cx", "_best"))
    hit = here.join(fine, ["_cy", "_cx"]).where(inside(F.col("lat"), F.col("lon")))
    d = G.haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    best = hit.groupBy(key).agg(F.min(d).alias(out))
    return sites.select(key).join(best, key, "left").select(key, F.coalesce(out, F.lit(float(radius_m))).alias(out))


def raster_value(points: DataFrame, raster: DataFrame, transform: Sequence[float], height: int, width: int,
                 x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Raster value under a point; raster is (row, col, value), outside gives null."""
    t = F.array(*[F.lit(float(v)) for v in transform])
    p = G.invert_affine(G.point(F.col(x), F.col(y)), t)
    at = points.withColumn("_p", p).withColumn("row", F.floor("_p.y").cast("bigint")).withColumn(
        "col", F.floor("_p.x").cast("bigint")).drop("_p")
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    return at.withColumn("row", F.when(inside, F.col("row"))).withColumn("col", F.when(inside, F.col("col"))).join(
        raster, ["row", "col"], "left")


def best_scene(boxes: DataFrame, scenes: DataFrame, key: str = "array_id", cell: float = 1000.0) -> DataFrame:
    """Scene covering most of each box; the first in rank order once coverage reaches 0.999."""
    cols = ("minx", "miny", "maxx", "maxy")
    b = boxes.select(key, *cols, *[F.col(c).alias(f"l_{c}") for c in cols])
    s = scenes.select("scene_id", "rank", *[F.col(c).alias(f"s_{c}") for c in cols], *[F.col(c).alias(f"r_{c}") for c in cols])
    w = F.least("maxx", "s_maxx") - F.greatest("minx", "s_minx")
    h = F.least("maxy", "s_maxy") - F.greatest("miny", "s_miny")
    overlap = F.try_divide(w * h, (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    cand = meeting(b, s, cell).where((w > 0) & (h > 0)).withColumn("overlap", overlap)
    best = cand.groupBy(key).agg(F.max_by(
        F.struct("scene_id", "overlap"), F.struct(F.least(F.col("overlap"), F.lit(0.999)), -F.col("rank"))).alias("_b"))
    return boxes.select(key).join(best, key, "left").select(key, "_b.scene_id", "_b.overlap")


def clip_to_tiles(polygons: DataFrame, key: str, width: Column, height: Column, tile: int = 640) -> DataFrame:
    """Each polygon in every tile it reaches, clamped, normalised by the tile size, at least 3 vertices left.

    Tiles follow from the bounding box by arithmetic; vertices are clamped and consecutive repeats dropped.
    """
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    last_col, last_row = F.ceil(width / tile) - 1, F.ceil(height / tile) - 1
    first = lambda lo: F.greatest(F.lit(0), F.ceil(lo / tile) - 1)
    sized = polygons.select("*", width.cast("double").alias("_w"), height.cast("double").alias("_h"), minx.alias("_minx"),
                            miny.alias("_miny"), maxx.alias("_maxx"), maxy.alias("_maxy"),
                            last_col.alias("_lc"), last_row.alias("_lr"))
    span = lambda lo, hi, last: F.when(
        F.least(F.floor(hi / tile), last) >= first(lo), F.sequence(first(lo), F.least(F.floor(hi / tile), last)))
    tiles = sized.withColumn("tile_col", F.explode(span(F.col("_minx"), F.col("_maxx"), F.col("_lc")))).withColumn(
        "tile_row", F.explode(span(F.col("_miny"), F.col("_maxy"), F.col("_lr"))))
    x0, y0 = F.col("tile_col") * float(tile), F.col("tile_row") * float(tile)
    tw, th = F.least(F.lit(float(tile)), F.col("_w") - x0), F.least(F.lit(float(tile)), F.col("_h") - y0)
    tiles = tiles.withColumn("_x0", x0).withColumn("_y0", y0).withColumn("_tw", tw).withColumn("_th", th).where(
        (F.col("_maxx") >= x0) & (F.col("_minx") <= x0 + tw) & (F.col("_maxy") >= y0) & (F.col("_miny") <= y0 + th))
    return tiles.withColumn("ring", clip_ring(F.col("ring"), F.col("_x0"), F.col("_y0"), F.col("_tw"), F.col("_th"), tile)).where(
        F.size("ring") >= 3).select(key, "tile_row", "tile_col", "ring")


def clip_ring(ring: Column, x0: Column, y0: Column, w: Column, h: Column, out: float) -> Column:
    """Clamp to a window, normalise, drop consecutive repeats."""
    clamp = lambda v, lo, size: F.greatest(lo, F.least(lo + size, v))
    moved = F.transform(ring, lambda p: G.point((clamp(p["x"], x0, w) - x0) / float(out), (clamp(p["y"], y0, h) - y0) / float(out)))
    return F.filter(moved, lambda p, i: (i == 0) | (p != F.get(moved, i - 1)))


def tile_grid(sources: DataFrame, key: str = "source", tile: int = 640) -> DataFrame:
    """one row per tile of each source raster: offsets, clipped size, world bounds when a transform is given."""
    cols = F.sequence(F.lit(0), F.ceil(F.col("width") / tile).cast("int") - 1)
    rows = F.sequence(F.lit(0), F.ceil(F.col("height") / tile).cast("int") - 1)
    g = sources.withColumn("tile_row", F.explode(rows)).withColumn("tile_col", F.explode(cols))
    x, y = F.col("tile_col") * tile, F.col("tile_row") * tile
    g = g.withColumn("x_off", x).withColumn("y_off", y).withColumn(
        "tile_w", F.least(F.lit(tile), F.col("width") - x)).withColumn("tile_h", F.least(F.lit(tile), F.col("height") - y))
    if "transform" in sources.columns:
        t = F.col("transform")
        left, top = t[0] * F.col("x_off") + t[2], t[4] * F.col("y_off") + t[5]
        g = g.withColumn("minx", left).withColumn("maxy", top).withColumn(
            "maxx", left + F.col("tile_w") * t[0]).withColumn("miny", top + F.col("tile_h") * t[4])
    return g


def number_tiles(tiles: DataFrame, order_key: str) -> DataFrame:
    """Running tile numbers over all sources, in the order of a unique numeric key, and the tile name."""
    return sequential_ids(tiles, order_key, "tile_no").withColumn("tile_name", F.format_string("tile_%06d.png", "tile_no"))


def array_ids(arrays: DataFrame, order_key: str) -> DataFrame:
    """Ids for arrays that survive the geometry filter."""
    return sequential_ids(arrays.where(G.is_usable(F.col("ring"))), order_key, "array_id")


def geometry_features(arrays: DataFrame, key: str = "array_id") -> DataFrame:
    """Per-array shape columns. The two hull columns take one Arrow pass for the hull ring. Rows are spread over
    all tasks first: the work is in the columns, and a table of many arrays may be one small file."""
    ring = G.open_ring(F.col("ring"))
    base = spread(arrays.select(key, "ring")).withColumn("ring", ring).withColumn("_hull", convex_hull("ring"))
    area, perimeter = G.area(F.col("ring")), G.perimeter(F.col("ring"))
    cx, cy = G.centroid(F.col("ring"))
    return base.select(
        key, area.alias("area_m2"), perimeter.alias("perimeter_m"), G.compactness(area, perimeter).alias("compactness"),
        G.aspect(F.col("ring")).alias("bbox_aspect_ratio"),
        F.when(G.area(F.col("_hull")) > 0, area / G.area(F.col("_hull"))).alias("convex_hull_ratio"),
        orientation(F.col("_hull")).alias("orientation_deg"), cx.alias("centroid_x"), cy.alias("centroid_y"))


def orientation(hull: Column) -> Column:
    """principal-axis azimuth in [0, 180) of the hull vertices, the closing vertex counted twice."""
    mean = lambda v, n: F.aggregate(v, F.lit(0.0), lambda s, q: s + q) / n
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("xx", "yy", "xy")])

    def moments(closed: Column, m: Column) -> Column:
        dx, dy = lambda p: p["x"] - m["x"], lambda p: p["y"] - m["y"]
        return F.aggregate(closed, zero, lambda s, p: F.struct(
            (s["xx"] + dx(p) * dx(p)).alias("xx"), (s["yy"] + dy(p) * dy(p)).alias("yy"), (s["xy"] + dx(p) * dy(p)).alias("xy")))

    def angle(closed: Column) -> Column:
        middle = F.struct(mean(G.xs(closed), F.size(closed)).alias("x"), mean(G.ys(closed), F.size(closed)).alias("y"))
        return G.let(G.let(middle, lambda m: moments(closed, m)), lambda t: F.degrees(F.atan2(2 * t["xy"], t["xx"] - t["yy"]) / 2))

    return F.when(F.size(hull) >= 3, F.pmod(G.let(F.concat(hull, F.slice(hull, 1, 1)), angle), F.lit(180.0)))


def spatial_clusters(df: DataFrame, km: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Dense ids of floor bins; the longitude step follows the cosine of the mean latitude."""
    mean = df.agg(F.avg(lat).alias("_mean"))
    step_lat = 1.0 / 111.0 * km
    step_lon = F.lit(1.0) / (F.lit(111.0) * F.greatest(F.lit(0.1), F.cos(F.radians("_mean")))) * F.lit(km)
    bins = df.crossJoin(F.broadcast(mean)).withColumn(
        "_bin", F.floor(F.col(lat) * F.lit(1.0 / step_lat)).cast("bigint") * 10_000
        + F.floor(F.col(lon) * (F.lit(1.0) / step_lon)).cast("bigint")).drop("_mean")
    ids = sequential_ids(bins.select("_bin").distinct(), "_bin", "cluster")
    return bins.join(ids, "_bin").drop("_bin")


def extent(arrays: DataFrame, *keys: str) -> DataFrame:
    """Bounds and center of a polygon set."""
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    box = arrays.groupBy(*keys).agg(F.min(minx).alias("minx"), F.min(miny).alias("miny"),
                                    F.max(maxx).alias("maxx"), F.max(maxy).alias("maxy"))
    return box.withColumn("center_x", (F.col("minx") + F.col("maxx")) / 2).withColumn(
        "center_y", (F.col("miny") + F.col("maxy")) / 2)
