"""Small literal cases with known answers."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from panelspark.config import EquivalentDay, Kimber, Recommend
from panelspark.functions import geo as G
from panelspark.functions import numeric as X
from panelspark.operators import areas, buckets
from panelspark.operators import daily as D
from panelspark.operators import detect as M
from panelspark.operators import labels as L
from panelspark.operators import physics as P
from panelspark.operators import recommend as R
from panelspark.operators import spatial as S
from panelspark.operators import stats as ST

DAY0 = dt.date(2026, 1, 1)
TODAY = dt.date(2026, 5, 5)


def series(spark, rain=None, **cols):
    n = len(rain if rain is not None else next(iter(cols.values())))
    names = ["station_id", "as_of", "dt"] + (["precipitation_sum"] if rain is not None else []) + list(cols)
    last = DAY0 + dt.timedelta(days=n - 1)
    rows = [(1, last, DAY0 + dt.timedelta(days=i), *([rain[i]] if rain is not None else []), *[v[i] for v in cols.values()])
            for i in range(n)]
    kinds = ", ".join(["station_id LONG", "as_of DATE", "dt DATE"] + [f"{c} DOUBLE" for c in names[3:]])
    return spark.createDataFrame(rows, kinds)


KEYS = ["station_id", "as_of"]


def test_window_sum(spark):
    rows = series(spark, [2.5 * i for i in range(12)])
    assert D.window_stats(rows, KEYS, [("precipitation_sum", 4, "sum", "s")]).first()["s"] == 95
    with pytest.raises(ValueError):
        D.window_stats(rows, KEYS, [("precipitation_sum", 4, "median", "s")])


@pytest.mark.parametrize("rain, want", [([7.5, 0.2, 0, 0.9], 3), ([0.4, 0, 1.0, 6, 0, 0.3], 2), ([0.9, 0], 2)])
def test_dry_streak(spark, rain, want):
    rows = series(spark, [float(v) for v in rain])
    assert D.streaks(rows, KEYS).first()["dry_day_streak"] == want


def test_streak_counts_observations(spark):
    rows = series(spark, [8.2, None, 0.4, None, None, 0.0, 0.1])
    got = D.streaks(rows, KEYS).first()
    assert (got["dry_day_streak"], got["days_since_rain_5mm"]) == (3, 3)


def test_rain_recency(spark):
    assert D.streaks(series(spark, [1.0, 6.5, 4.9, 0.0]), KEYS).first()["days_since_rain_5mm"] == 2


def test_kimber_reset(spark):
    rows = series(spark, [0.2, 0.0, 4.2, 0.0, 0.9, 0.0], pm2_5=[33.0] * 6)
    got = [r["soiling_ratio"] for r in P.kimber_ratio(rows, KEYS, Kimber(deposition_per_pm25=0.01)).orderBy("dt").collect()]
    assert got[2] == 1.0 and got[3] == pytest.approx(0.67) and got[3] > got[1]


def test_kimber_floor(spark):
    rows = series(spark, [0.5] * 40, pm2_5=[80.0] * 40)
    got = [r["soiling_ratio"] for r in P.kimber_ratio(rows, KEYS, Kimber(deposition_per_pm25=0.004)).orderBy("dt").collect()]
    assert got[-1] == 0.0 and min(got) >= 0.0


def test_kimber_negative_readings_follow_the_loop(spark):
    pm = [40.0, -5.0, 30.0, 60.0, -80.0, 10.0, -3.0, 50.0]
    rain = [0.0, 0, 0, 0, 0, 2.0, 0, 0]
    rows = series(spark, [float(v) for v in rain], pm2_5=pm)
    got = [r["soiling_ratio"] for r in P.kimber_ratio(rows, KEYS, Kimber(deposition_per_pm25=0.01)).orderBy("dt").collect()]
    now, want = 1.0, []
    for p, r in zip(pm, rain):
        now = 1.0 if r >= 1 else max(0.0, now - 0.01 * p)
        want.append(now)
    assert got == pytest.approx(want, abs=1e-12)


def test_missing_pollutant_takes_defaults(spark):
    rows = series(spark, [0.3] * 4, pm2_5=[None] * 4)
    got = [r["soiling_ratio"] for r in P.kimber_ratio(rows, KEYS, Kimber(deposition_per_pm25=0.02)).orderBy("dt").collect()]
    assert got == pytest.approx([0.8, 0.6, 0.4, 0.2])


def test_equivalent_days_follow_the_loop(spark):
    rain = [0.0, 3.0, 0.0, 12.0, None, 0.0, 9.9]
    pm10 = [10.0, 80.0, 120.0, 40.0, 90.0, None, 10.0]
    rows = series(spark, rain, pm10=pm10)
    fill = sorted(v for v in pm10 if v is not None)
    mid = (fill[2] + fill[3]) / 2
    eq, want = 0.0, []
    for r, p in zip(rain, pm10):
        r, p = r or 0.0, mid if p is None else p
        f = 0.0 if r >= 10 else 1 - (r - 1) / 9 if r >= 1 else 1 + 0.02 * (p - 50) if p > 50 else 1.0
        eq = f * (eq + 1)
        want.append(eq)
    got = [r["eqd"] for r in P.equivalent_days(rows, KEYS).orderBy("dt").collect()]
    assert got == pytest.approx(want, abs=1e-12)
    end = P.terminal_equivalent_days(rows, KEYS).first()
    assert end["eqd"] == pytest.approx(want[-1]) and end["last_rain_date"] == DAY0 + dt.timedelta(days=3)


def test_score_is_null_free_and_bounded(spark):
    got = P.score_series(series(spark, [0.0] * 400, pm10=[500.0] * 400), KEYS, EquivalentDay(sl_sat=0.1)).first()
    assert got["risk_score"] == 1.0 and got["last_rain_date"] is None


def decision(spark, scores, last, rain):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(scores)], "aoi_id INT, array_id INT, risk_score DOUBLE")
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate(rain)], "aoi_id INT, day_no INT, rain_mm DOUBLE")
    a = spark.createDataFrame([(1, last)], "aoi_id INT, last_cleaned DATE")
    return R.recommend_areas(s, f, a, F.lit(TODAY)), s


@pytest.mark.parametrize("scores, last, rain, rule", [
    ([0.15, 0.41, 0.33, 0.58], dt.date(2025, 11, 3), [0.0] * 7, "below_risk_threshold"),
    ([0.72, 0.95], dt.date(2026, 4, 20), [0.0] * 7, "below_age_threshold"),
    ([0.72, 0.95], dt.date(2025, 12, 20), [0.4, 0, 2.6, 0, 2.2, 0, 0], "deferred_due_to_rain"),
    ([0.72, 0.95], dt.date(2025, 12, 20), [0.0] * 7, "weather_window_open"),
])
def test_rules(spark, scores, last, rain, rule):
    got, s = decision(spark, scores, last, [float(v) for v in rain])
    row = got.first()
    assert row["rule_fired"] == rule
    actions = {r["action"] for r in R.recommend_arrays(s, got).collect()}
    if rule == "weather_window_open":
        assert row["window_start"] == dt.date(2026, 5, 6) and row["window_end"] == dt.date(2026, 5, 11)
        assert actions == {"clean"}
    else:
        assert row["window_start"] is None and actions == {"monitor"}


def test_area_risk_pick(spark):
    got, _ = decision(spark, [0.0] * 9 + [0.95], dt.date(2026, 1, 1), [0.0] * 7)
    assert got.first()["aoi_risk"] == 0.95
    got, _ = decision(spark, [None, None], dt.date(2026, 1, 1), [0.0] * 7)
    assert got.first()["aoi_risk"] == 0.0 and got.first()["n_arrays"] == 2


def test_recommend_defaults():
    assert Recommend().risk_threshold == 0.6 and Recommend().forecast_days == 7


def clip(spark, points, x0, y0, w, h, out=640):
    df = spark.createDataFrame([([(float(x), float(y)) for x, y in points],)], "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    c = F.lit
    row = df.select(S.clip_ring(F.col("ring"), c(float(x0)), c(float(y0)), c(float(w)), c(float(h)), out).alias("r")).first()
    return [(p["x"], p["y"]) for p in row["r"]]


def test_clip_inside_edge_and_offset(spark):
    quad = [(100, 100), (200, 100), (200, 200), (100, 200)]
    assert clip(spark, quad, 0, 0, 640, 640) == [(x / 640, y / 640) for x, y in quad]
    edge = clip(spark, [(150, 150), (300, 150), (300, 300), (150, 300)], 0, 0, 200, 200)
    assert max(x for x, _ in edge) == 200 / 640
    moved = clip(spark, [(700, 700), (800, 700), (800, 800)], 640, 640, 640, 640)
    assert moved[0] == (60 / 640, 60 / 640) and len(moved) == 3


def test_tiles_reached(spark):
    ring = [(600.0, 600.0), (700.0, 600.0), (700.0, 700.0), (600.0, 700.0)]
    df = spark.createDataFrame([(1, ring)], "id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    got = {(r["tile_row"], r["tile_col"]) for r in S.clip_to_tiles(df, "id", F.lit(1280), F.lit(1280)).collect()}
    assert got == {(0, 0), (0, 1), (1, 0), (1, 1)}


def specs(spark, values):
    scenes = spark.createDataFrame([("santa_cruz", -122.1, 36.85, -121.85, 37.05)], "scene STRING, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    df = spark.createDataFrame([(v,) for v in values], "spec STRING")
    return {r["spec"]: r for r in areas.parse_specs(df, scenes).collect()}


def test_area_specs(spark):
    got = specs(spark, ["-122.1,36.9,-122.0,37.0", "0,0,0,0", "1,2,3", "SANTA-cruz", "a,b,c,d", "nowhere"])
    ok = got["-122.1,36.9,-122.0,37.0"]
    corners = [[-122.1, 36.9], [-122.0, 36.9], [-122.0, 37.0], [-122.1, 37.0], [-122.1, 36.9]]
    text = json.dumps({"type": "Polygon", "coordinates": [corners]}, sort_keys=True, separators=(",", ":"))
    assert ok["aoi_id"] == hashlib.sha1(text.encode()).hexdigest()[:10] and ok["error"] is None
    assert got["SANTA-cruz"]["source"] == "scene" and got["SANTA-cruz"]["aoi_id"] == "santa_cruz"
    assert [got[k]["error"] for k in ("0,0,0,0", "1,2,3", "a,b,c,d", "nowhere")] == [
        "degenerate", "not_four_parts", "not_numeric", "unknown_scene"]


def test_area_geojson(spark):
    square = [[[-122.0, 36.9], [-121.9, 36.9], [-121.9, 37.0], [-122.0, 37.0], [-122.0, 36.9]]]
    bow = [[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]
    docs = {
        "feature": {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square}},
        "bare": {"type": "Polygon", "coordinates": square},
        "collection": {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": square}}]},
        "empty": {"type": "FeatureCollection", "features": []},
        "crs": {"type": "Polygon", "coordinates": square, "crs": {"properties": {"name": "EPSG:3857"}}},
        "bow": {"type": "Polygon", "coordinates": bow},
        "point": {"type": "Point", "coordinates": [0, 0]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "k STRING, value STRING")
    got = {r["k"]: r for r in areas.parse_geojson_areas(df).collect()}
    assert [got[k]["error"] for k in ("feature", "bare", "collection")] == [None] * 3
    assert len({got[k]["aoi_id"] for k in ("feature", "bare", "collection")}) == 1
    assert {k: got[k]["error"] for k in ("empty", "crs", "bow", "point")} == {
        "empty": "no_features", "crs": "not_wgs84", "bow": "invalid_polygon", "point": "not_a_polygon"}


def test_clause_filter(spark):
    df = spark.createDataFrame([("fp", 0.6, None), ("fp", 0.4, 1.0), ("fn", None, 2.0)], "class STRING, conf DOUBLE, iou DOUBLE")
    keep = lambda e: df.where(buckets.clause_filter(e, df.columns)).count()
    assert keep("class=fp AND conf>0.5") == 1 and keep("class='fn' and iou>=2") == 1
    assert keep("conf != 0.6") == 2 and keep("conf<1") == 2 and keep("missing=x") == 0
    for bad in ("class~fp", "conf>high", ""):
        with pytest.raises(ValueError):
            buckets.clause_filter(bad)


@pytest.mark.parametrize("x, n", [(0.1545, 3), (0.0525, 3), (2.675, 2), (0.5, 0), (1.5, 0), (-0.1545, 3), (1234.5678, 2), (1e-9, 3)])
def test_round_binary(spark, x, n):
    got = spark.range(1).select(X.round_binary(F.lit(x), n).alias("v")).first()["v"]
    assert got == round(x, n)


def test_reproject_round_trip_and_known_point(spark):
    df = spark.range(1).select(F.lit(-122.03).alias("lon"), F.lit(36.97).alias("lat"))
    east, north = G.to_utm(F.col("lon"), F.col("lat"))
    back = G.from_utm(F.col("e"), F.col("n"))
    r = df.select("lon", "lat", east.alias("e"), north.alias("n")).select("*", back[0].alias("x"), back[1].alias("y")).first()
    assert r["x"] == pytest.approx(-122.03, abs=1e-10) and r["y"] == pytest.approx(36.97, abs=1e-10)
    # On the central meridian the easting is the false easting and the northing the scaled meridian arc.
    c = spark.range(1).select(*[v.alias(k) for k, v in zip("en", G.to_utm(F.lit(-123.0), F.lit(45.0)))]).first()
    assert c["e"] == pytest.approx(500000.0, abs=1e-6) and c["n"] == pytest.approx(0.9996 * 4984944.378, abs=1e-2)
    with pytest.raises(ValueError):
        G.reproject(F.lit(0.0), F.lit(0.0), 4326, 27700)


def test_ks_identical_and_disjoint(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", float(i)) for i in range(20)] + [("c", 100.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    same, apart = ST.ks_test(df, "v", "g", "a", "b").first(), ST.ks_test(df, "v", "g", "a", "c").first()
    assert same["d"] == 0.0 and apart["d"] == 1.0 and apart["p"] < 1e-6


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0)], "s DOUBLE, y INT")
    assert ST.roc_auc(df, "s", "y").first()["auc"] is None


def test_feedback_formulas(spark):
    r = spark.range(1).select(X.recovery_pct(F.lit(100.0), F.lit(112.345)).alias("a"), X.pseudo_iwsr(F.lit(150.0)).alias("b"),
                              X.recovery_pct(F.lit(0.0), F.lit(1.0)).alias("c")).first()
    assert r["a"] == round((112.345 - 100.0) / 100.0 * 100, 2) and r["b"] == 0.0 and r["c"] is None


def test_greedy_match_leaves_the_rest(spark):
    box = "tile_id INT, {} LONG, {} x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    p = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, 0.7, 50.0, 50.0, 60.0, 60.0)],
                              box.format("pred_idx", "conf DOUBLE,"))
    g = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.0, 0.0, 10.0, 10.0), (1, 3, 90.0, 90.0, 99.0, 99.0)], box.format("gt_idx", ""))
    m = {(r["pred_idx"], r["gt_idx"]) for r in M.match(p, g).collect()}
    assert m == {(1, 1), (2, 2)}
    classes = sorted(r["class"] for r in M.match_outcomes(p, g, M.match(p, g)).collect())
    assert classes == ["fn", "fp", "tp", "tp"]


def test_ramp_and_gates(spark):
    df = spark.createDataFrame([(0, 0.568, 0.5), (1, 0.487, 0.2), (2, 0.50, 0.2)], "step INT, map50 DOUBLE, precision DOUBLE")
    got = [(r["halt"], r["status"]) for r in L.ramp_steps(df).orderBy("step").collect()]
    assert got == [(False, "ok"), (True, "halt"), (False, "soft_halt")]


def test_orientation_of_tilted_rectangle(spark):
    angle = math.radians(30)
    ring = [(x * math.cos(angle) - y * math.sin(angle), x * math.sin(angle) + y * math.cos(angle)) for x, y in ((0, 0), (20, 0), (20, 1), (0, 1))]
    df = spark.createDataFrame([(1, ring)], "array_id INT, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>")
    assert S.geometry_features(df).first()["orientation_deg"] == pytest.approx(30, abs=3)
