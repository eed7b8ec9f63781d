"""File round trips for the readers and writers."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.operators import lineage as LN
from panelspark.operators import quality as Q
from panelspark.operators.labels import feedback_labels
from panelspark.sources import scans as S
from panelspark.sources import sinks as K
from panelspark.streaming import streams as T

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def test_station_and_panel_csv(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("station_id,latitude,longitude,iwsr,year,extra\na,36.5,-121.0,0.97,2019,x\nb,40.0,-110.0,oops,2020,y\n")
    df = S.panel_csv(spark, str(f))
    assert dict(df.dtypes)["latitude"] == "double" and dict(df.dtypes)["year"] == "int"
    assert [(r["station_id"], r["iwsr"], r["extra"]) for r in df.orderBy("station_id").collect()] == [("a", 0.97, "x"), ("b", None, "y")]
    assert S.station_csv(spark, str(f), (-122.0, 36.0, -120.0, 37.0)).count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("station_id,latitude\na,1\n")
    with pytest.raises(ValueError, match="iwsr.*longitude"):
        S.station_csv(spark, str(bad))


def test_station_json(spark):
    doc = {
        "s1": {"Latitude": 36.5, "Longitude": -120.1, "IWSR": ">0.99", "Tilt": 20, "Annual IWSR": [["Year", "IWSR"], [2019, 0.96, 0.95, 0.97], [2020, ">0.99"], [2021], [2022, None]]},
        "s2": {"Latitude": None, "Longitude": 1.0, "IWSR": 0.9}, "s3": {"Latitude": 30.0, "Longitude": 1.0, "IWSR": "x", "Annual IWSR": [["Year"]]},
    }
    rec = S.station_records(spark.createDataFrame([(json.dumps(doc),)], "value STRING"))
    summary = S.station_summary(rec).collect()
    assert [(r["station_id"], r["iwsr"], r["iwsr_censored"], r["tilt_deg"]) for r in summary] == [("s1", 0.995, True, 20.0)]
    panel = S.station_panel(rec).orderBy("year").collect()
    assert [(r["year"], r["iwsr"], r["iwsr_censored"], r["iwsr_upper"]) for r in panel] == [(2019, 0.96, False, 0.97), (2020, 0.995, True, None)]


def test_weather_payload_and_quarantine(spark):
    good = {"daily": {"time": [f"2025-03-1{i}" for i in range(5)], "precipitation_sum": [1.3, 0, None, 0.4, 7.7]}}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, '{"error": true}'), (3, "not json")], "station_id INT, value STRING")
    rows, bad = S.weather_payload(df, ["precipitation_sum"])
    assert rows.count() == 5 and rows.where("precipitation_sum IS NULL").count() == 1
    assert sorted(r["station_id"] for r in bad.collect()) == [2, 3]


def test_hourly_payload_to_days(spark):
    from panelspark.operators.daily import daily_means
    hours = [f"2025-03-1{h // 24}T{h % 24:02d}:00" for h in range(72)]
    doc = {"hourly": {"time": hours, "pm2_5": [4.0 + h % 24 for h in range(72)], "pm10": [31.5 + h // 24 for h in range(72)]}}
    rows, _ = S.air_quality_payload(spark.createDataFrame([(1, json.dumps(doc))], "station_id INT, value STRING"))
    got = daily_means(rows, ["pm2_5", "pm10"]).collect()
    assert sorted((r["pm2_5"], r["pm10"]) for r in got) == [(15.5, 31.5), (15.5, 32.5), (15.5, 33.5)]


def test_reanalysis_text(spark):
    text = ["Dataset {", "BCSMASS.BCSMASS[BCSMASS.time=0][BCSMASS.lat=32], 1.5e-10", "BCSMASS.BCSMASS[BCSMASS.time=60][BCSMASS.lat=32], nan", "A.B[x], 3"]
    got = S.reanalysis_lines(spark.createDataFrame([(1, v) for v in text], "k INT, value STRING"), ["k"]).collect()
    assert [(r["variable"], r["value"]) for r in got] == [("BCSMASS", 1.5e-10), ("BCSMASS", None)]


def test_geojson_round_trip(spark, tmp_path):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(1, 0.5, square), (2, None, square)], f"array_id INT, risk_score DOUBLE, ring {RING}")
    K.write_geojson_seq(df, str(tmp_path / "seq"), ["array_id", "risk_score"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "seq")).collect()]
    one = json.loads(lines[0])
    assert one["type"] == "Feature" and one["geometry"]["coordinates"][0][0] == one["geometry"]["coordinates"][0][-1]
    f = tmp_path / "c.geojson"
    f.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}},
                             "features": [json.loads(v) for v in lines]}))
    back = S.read_geojson(spark, str(f))
    assert back.count() == 2 and back.first()["srid"] == 4326 and back.where(F.size("ring") == 4).count() == 2
    empty = tmp_path / "e.geojson"
    empty.write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(ValueError):
        S.read_geojson(spark, str(empty))


def test_label_files(spark, tmp_path):
    folder = tmp_path / "labels" / "train"
    folder.mkdir(parents=True)
    (folder / "t1.txt").write_text("0 0.1 0.1 0.2 0.1 0.2 0.2\n\n0 0.1 0.1 0.2 0.1 0.2 0.2 0.75\n0 a b c d e f\n0 0.1\n")
    lines = S.read_label_files(spark, str(tmp_path / "labels"))
    assert {(r["tile"], r["split"]) for r in lines.collect()} == {("t1", "train")}
    got = S.label_lines(lines).orderBy("line_no").collect()
    assert [(r["line_no"], r["conf"], len(r["ring"])) for r in got] == [(1, 1.0, 3), (3, 0.75, 3)]
    out = S.label_lines(lines).select("split", "tile", "line_no", K.label_line(F.col("ring"), F.col("class_id")).alias("line"))
    K.write_label_text(out, str(tmp_path / "out"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert text == ["0 0.100000 0.100000 0.200000 0.100000 0.200000 0.200000"] * 2


def png(path, rgb, w, h):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    folder = tmp_path / "images" / "val"
    folder.mkdir(parents=True)
    png(folder / "a.png", (30, 60, 90), 8, 6)
    imgs = S.read_images(spark, str(tmp_path / "images"))
    row = imgs.first()
    assert row["split"] == "val" and row["label_path"].endswith("/labels/val/a.txt")
    s = LN.image_stats(imgs).first()
    assert (s["img_w"], s["img_h"], s["r_mean"], s["g_mean"], s["b_mean"]) == (8, 6, 30.0, 60.0, 90.0)
    assert s["brightness"] == pytest.approx(60.0) and s["sharpness"] == pytest.approx(0.0, abs=1e-6) and s["r_std"] == 0.0
    files = S.export_files(spark, str(tmp_path)).collect()
    assert [(f["split"], f["kind"], f["stem"]) for f in files] == [("val", "image", "a")]


def test_per_detection_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t1", "tp", 0.9, None), ("t2", "fn", None, 3.5)], "tile_id STRING, class STRING, conf DOUBLE, gt_area_px DOUBLE")
    K.write_csv(df, str(tmp_path / "d"))
    back = S.per_detection_csv(spark, str(tmp_path / "d")).orderBy("tile_id").collect()
    assert [tuple(r) for r in back] == [("t1", "tp", 0.9, None), ("t2", "fn", None, 3.5)]


def test_tile_index_save(spark, tmp_path):
    doc = {"tiles": {"a.png": {"transform": [1, 0, 0, 0, -1, 0], "crs": "EPSG:32610", "width": 640, "height": 640}}}
    idx = S.tile_index(spark.createDataFrame([(json.dumps(doc),)], "value STRING"))
    K.write_tile_index(idx, str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).first()["tile_name"] == "a.png"
    with pytest.raises(ValueError):
        K.write_tile_index(idx.withColumn("width", F.lit(0)), str(tmp_path / "idx2"))
    with pytest.raises(ValueError):
        Q.merge_tile_indices([idx, idx])
    assert Q.merge_tile_indices([idx, idx], last_wins=True).count() == 1


def test_feedback_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    rec = {"array_id": 3, "partner_id": "p1", "cleaned_at": "2026-02-01", "pre_clean_kwh_7d": 100.0, "post_clean_kwh_7d": 108.0, "actual_recovery_pct": 8.0, "notes": None}
    (tmp_path / "p1" / "feedback.json").write_text(json.dumps([rec, {**rec, "array_id": 9}]))
    events = S.read_feedback(spark, str(tmp_path))
    cent = spark.createDataFrame([("p1", 3, 36.9, -122.0)], "partner_id STRING, array_id INT, latitude DOUBLE, longitude DOUBLE")
    rows, lost = feedback_labels(events, cent, 0.97)
    r = rows.first()
    assert (r["station_id"], r["iwsr"], r["label"], r["year"]) == ("p1_array_3", pytest.approx(0.92), 1, 2026)
    assert [x["array_id"] for x in lost.collect()] == [9]


def test_run_metrics_skip_missing(spark, tmp_path):
    for name, doc in (("b", {"mean_auc": 0.72849, "fold_aucs": [0.70012, 0.8]}), ("a", {"mean_auc": 0.6, "mean_spearman": -0.12345, "target_mode": "regression"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps(doc))
    (tmp_path / "empty").mkdir()
    got = S.read_run_metrics(spark, str(tmp_path)).collect()
    assert [(r["run"], r["target"], r["auc"], r["spearman"]) for r in got] == [("a", "regression", 0.6, -0.123), ("b", "binary", 0.728, None)]
    assert got[1]["fold_aucs"] == [0.7, 0.8]


def test_coco_skips_run_length(spark):
    doc = {"images": [{"id": 1, "file_name": "d/x.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "y.jpg", "width": 10, "height": 10}],
           "annotations": [{"id": 7, "image_id": 1, "segmentation": [[10, 5, 20, 5, 20, 25], [1, 2]]}, {"id": 8, "image_id": 1, "segmentation": {"counts": [1], "size": [2, 2]}}]}
    got = {r["tile"]: r["line"] for r in S.coco_lines(spark.createDataFrame([(json.dumps(doc),)], "value STRING")).collect()}
    assert got == {"x": "0 0.100000 0.100000 0.200000 0.100000 0.200000 0.500000", "y": None}


def test_manifest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    files = LN.file_hashes(spark, str(tmp_path / "in"))
    first = LN.manifest(spark, "tile", "v1", "r1", inputs=files, metrics={"n": 1})
    LN.append_manifest(first, str(tmp_path / "lineage"))
    (tmp_path / "in" / "a.txt").write_text("two")
    second = LN.manifest(spark, "recommend", "v1", "r1", inputs=LN.file_hashes(spark, str(tmp_path / "in")))
    LN.append_manifest(second, str(tmp_path / "lineage"))
    rows = spark.read.parquet(str(tmp_path / "lineage"))
    assert rows.select("inputs_hash").distinct().count() == 2
    assert LN.rollup(rows).first()["n_stages"] == 2
    with pytest.raises(ValueError):
        LN.manifest(spark, "unknown", "v1", "r1")
    with pytest.raises(ValueError):
        LN.manifest(spark, "tile", "v1", "r1", extra={"stage": "x"})


def test_matrix_pair_and_payload(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame([(1, 2.0, ring)], f"array_id INT, area_m2 DOUBLE, ring {RING}")
    K.write_matrix(df, str(tmp_path / "t"), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["array_id", "area_m2"]
    assert len(spark.read.parquet(str(tmp_path / "g")).first()["ring"]) == 3


def test_degenerate_rings_do_not_fail(spark):
    df = spark.createDataFrame([(1, []), (2, [(1.0, 1.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])], f"id INT, ring {RING}")
    cx, cy = G.centroid(F.col("ring"))
    got = df.select("id", G.is_usable(F.col("ring")).alias("ok"), cx.alias("cx")).orderBy("id").collect()
    assert [r["ok"] for r in got] == [False, False, False] and all(r["cx"] is None for r in got)


def test_stream_state_over_several_batches(spark, tmp_path):
    import datetime as dt

    from panelspark.operators import physics as P
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    rows = [(s, d, 12.0 if i % 13 == 5 else 3.0 if i % 7 == 2 else 0.0, 20.0 + i, 40.0 + i) for s in (1, 2) for i, d in enumerate(days)]
    kind = "station_id LONG, dt DATE, precipitation_sum DOUBLE, pm2_5 DOUBLE, pm10 DOUBLE"
    for i in range(4):
        part = [r for r in rows if days.index(r[1]) // 10 == i]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind.replace(" LONG", " BIGINT")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = T.run_to_parquet(T.soiling_state_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    batch = {(r["station_id"], r["dt"]): r["eqd"] for r in P.equivalent_days(spark.createDataFrame(rows, kind), ["station_id"]).collect()}
    assert len(got) == len({(r["station_id"], r["dt"]) for r in got}) == 2 * 38
    assert all(r["eqd"] == pytest.approx(batch[r["station_id"], r["dt"]], abs=1e-9) for r in got)
    assert {r["last_rain_date"] for r in got if r["dt"] < days[5]} == {None}


def test_large_files_and_many_inputs(spark, tmp_path):
    import hashlib

    folder = tmp_path / "in put"
    folder.mkdir()
    bodies = {f"f%{i} é.bin": bytes([i]) * (3_000_001 if i == 7 else i) for i in range(1, 61)}
    for name, body in bodies.items():
        (folder / name).write_bytes(body)
    files = LN.file_hashes(spark, str(folder))
    assert {r["name"]: r["sha256"] for r in files.collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    rows = [(k, n, hashlib.sha256(b).hexdigest()) for k in ("a", "b", None) for n, b in bodies.items() if k != "b" or len(n) % 2]
    df = spark.createDataFrame(rows, "k STRING, name STRING, sha256 STRING").repartition(5)
    want = {k: hashlib.sha256("".join(f"{n}\0{h}\n" for kk, n, h in sorted(rows, key=lambda r: r[1].encode()) if kk == k).encode()).hexdigest() for k in ("a", "b", None)}
    assert {r["k"]: r["inputs_hash"] for r in LN.inputs_hash(df, ["k"], order="name").collect()} == want
    row = LN.manifest(spark, "tile", "v1", "r1", inputs=files).first()
    assert len(row["inputs"]) == 60 and row["inputs"] == sorted(row["inputs"]) and row["inputs_hash"] == LN.inputs_hash(files).first()["inputs_hash"]
