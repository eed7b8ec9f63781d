"""Cases in which rows, vertices, areas or decisions were once lost."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelspark.functions import numeric
from panelspark.operators import areas, buckets, quality, recommend
from panelspark.sources import scans


def test_payload_without_a_variable(spark):
    raw = spark.createDataFrame([
        (1, json.dumps({"daily": {"time": ["2021-05-01", "2021-05-02"], "rain": [1.5, None]}})),
        (2, json.dumps({"daily": {"time": ["2021-05-01"], "rain": [2.5], "wind": [3.0]}})),
        (3, json.dumps({"daily": {"time": ["2021-05-01", "2021-05-02"], "rain": [1.0], "wind": [3.0, 4.0]}})),
        (4, json.dumps({"error": True}))], "station_id int, value string")
    rows, bad = scans.weather_payload(raw, ["rain", "wind"])
    assert sorted((r.station_id, str(r.dt), r.rain, r.wind) for r in rows.collect()) == [(1, "2021-05-01", 1.5, None), (1, "2021-05-02", None, None), (2, "2021-05-01", 2.5, 3.0)]
    assert sorted(r.station_id for r in bad.collect()) == [3, 4]


def test_fourteen_vertices(spark):
    row = {"polygon_id": 1, "number_vertices": 14} | {f"lat{i}": float(i) for i in range(1, 15)} | {f"lon{i}": float(-i) for i in range(1, 15)}
    ring = scans.wide_vertices(spark.createDataFrame([row]), ["polygon_id"]).first()["ring"]
    assert [p["y"] for p in ring] == [float(i) for i in range(1, 15)]


def test_area_without_arrays(spark):
    scores = spark.createDataFrame([(1, 0.9)], "aoi_id long, risk_score double")
    forecast = spark.createDataFrame([(1, 0, 0.0), (2, 0, 0.0)], "aoi_id long, day_no int, rain_mm double")
    known = spark.createDataFrame([(1, None), (2, None)], "aoi_id long, last_cleaned date")
    got = {r.aoi_id: r for r in recommend.recommend_areas(scores, forecast, known, F.lit("2024-06-01").cast("date")).collect()}
    assert got[2].rule_fired == "below_risk_threshold" and got[2].aoi_risk == 0 and got[2].n_arrays == 0
    assert got[1].n_arrays == 1


def polygon(rings, **more):
    return {"type": "Polygon", "coordinates": rings} | more


def canonical(rings):
    return hashlib.sha1(json.dumps({"coordinates": rings, "type": "Polygon"}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:10]


def test_reference_systems_holes_and_ids(spark):
    outer = [[0.0, 0.0], [10.0, 0.0], [10.0, 8.5], [0.0, 8.5], [0.0, 0.0]]
    hole = [[2.0, 2.0], [3.0, 2.0], [3.0, 3.25], [2.0, 2.0]]
    small = [[0.0001, 0.5], [0.25, 0.5], [0.25, 0.00002], [0.0001, 0.5]]
    docs = {
        "plain": polygon([outer]), "hole": polygon([outer, hole]), "small": polygon([small]), "text": polygon([outer], crs="EPSG:3857"),
        "text84": polygon([outer], crs="EPSG:4326"), "nameless": polygon([outer], crs={"type": "name"}),
        "named": polygon([outer], crs={"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}), "null": polygon([outer], crs=None)}
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "k string, value string")
    got = {r.k: r for r in areas.parse_geojson_areas(raw).collect()}
    assert {k for k, r in got.items() if r.error == "not_wgs84"} == {"text", "text84", "nameless"}
    assert got["plain"].aoi_id == got["named"].aoi_id == got["null"].aoi_id == canonical([outer])
    assert got["hole"].aoi_id == canonical([outer, hole]) and len(got["hole"].holes) == 1 and got["plain"].holes == []
    assert got["small"].aoi_id == canonical([small])


def test_decisions_add_up(spark):
    labels = spark.createDataFrame([(t, p) for t in (1, 2, 3, 4) for p in (1, 2, 3, 4)], "tile_id long, poly_no int")
    log = spark.createDataFrame([
        (1, "2024-01-01", "remove", "2"), (1, "2024-01-02", "keep", None),
        (2, "2024-01-01", "remove", "1"), (2, "2024-01-02", "remove", "1;3"),
        (3, "2024-01-01", "remove_all", None), (3, "2024-01-02", "flag_for_reannotation", None)], "tile_id long, ts string, action string, removed_indices string")
    got = sorted((r.tile_id, r.poly_no) for r in quality.replay_decisions(labels, log).collect())
    assert got == [(1, 1), (1, 3), (1, 4), (2, 3), (4, 1), (4, 2), (4, 3), (4, 4)]


def test_long_number_text(spark):
    text = ">" + "0" * 80 + ".5"
    assert spark.createDataFrame([(text,)], "t string").select(numeric.censored_ratio(F.col("t"))[0]).first()[0] == 0.75


def test_class_token_may_be_text(spark):
    rows = scans.label_lines(spark.createDataFrame([("panel 0.1 0.1 0.2 0.1 0.2 0.2",), ("0 0.1 x 0.2 0.1 0.2 0.2",)], "line string")).collect()
    assert len(rows) == 1 and rows[0].class_id is None and len(rows[0].ring) == 3


def test_conditions(spark):
    df = spark.createDataFrame([("a b", 3.0), ("c", None)], "name string, size double")
    count = lambda text: df.where(buckets.clause_filter(text, df.columns)).count()
    assert count("name = 'a b' AND size>=3") == 1 and count("name != c and size < 4") == 1 and count("size <= 9") == 1
    for wrong in ("name", "= 3", "size > many", "na me = 1", "name ="):
        with pytest.raises(ValueError):
            buckets.clause_filter(wrong)


def test_fold_runs_equal_the_greedy_order():
    import heapq
    import random

    from panelspark.operators.labels import fold_pattern

    rng = random.Random(0)
    for _ in range(300):
        k = rng.randint(1, 7)
        classes = sorted({rng.choice([1, 2, 3, 5, 8, 13, 40, 100, 1000]): rng.randint(1, 60) for _ in range(rng.randint(1, 6))}.items(), reverse=True)
        loads, want = [(0, f) for f in range(k)], []
        for size, many in classes:
            for _ in range(many):
                load, fold = heapq.heappop(loads)
                want.append(fold)
                heapq.heappush(loads, (load + size, fold))
        runs, got = fold_pattern(classes, k), []
        for size, many in classes:
            own = [r for r in runs if r[0] == size]
            for (_, first, turn), last in zip(own, [*[r[1] for r in own[1:]], many]):
                got += [turn[i % len(turn)] for i in range(last - first)]
        assert got == want
    assert len(fold_pattern([(10**6, 3), (1, 10**9)], 5)) < 20
