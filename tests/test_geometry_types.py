"""Polygons with holes and parts, any UTM zone, long dry segments, one label file a tile."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelspark.config import EquivalentDay
from panelspark.functions import geo, multi
from panelspark.operators import physics
from panelspark.sources import label_files, scans

BOX = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def test_multipolygon_with_a_hole(spark):
    features = [("MultiPolygon", [[BOX(0, 0, 4, 4), BOX(1, 1, 2, 2)[::-1]], [BOX(10, 0, 2, 4)]]), ("Polygon", [BOX(5, 5, 2, 2)]), ("Polygon", [[[0, 0], [1, 1]]]),
                ("Point", [1, 2]), ("MultiPolygon", [])]
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"id": i}} for i, (k, c) in enumerate(features)]})
    rows = scans.geojson_collection(spark.createDataFrame([(text,)], "value STRING"))
    g = F.col("polygons")
    at = lambda x, y: multi.contains(g, F.lit(x), F.lit(y))
    got = {int(r.id): r for r in rows.select(F.col("properties")["id"].alias("id"), F.size(g).alias("parts"), multi.area(g).alias("area"), multi.perimeter(g).alias("length"),
           multi.centroid(g)[0].alias("cx"), multi.centroid(g)[1].alias("cy"), at(2.0, 2.1).alias("hole"), at(0.5, 2.1).alias("edge"), at(11.0, 1.1).alias("second"), "ring").collect()}
    assert set(got) == {0, 1}
    r = got[0]
    assert (r.parts, r.area, r.length) == (2, 20.0, 36.0) and (r.cx, r.cy) == (pytest.approx((12 * 2 + 8 * 11) / 20), pytest.approx(2.0))
    assert (r.hole, r.edge, r.second) == (False, True, True) and len(r.ring) == 4 and r.ring[1].x == 4.0
    assert got[1].area == 4.0 and got[1].cx == 6.0


def test_zones_mixed_in_a_table(spark):
    places = [(0, -122.03, 36.97), (1, 151.2, -33.9), (2, 179.9, 65.0), (3, -179.9, -1.0), (4, 2.29, 48.86), (5, 6.0, 0.0)]
    df = spark.createDataFrame(places, "i INT, lon DOUBLE, lat DOUBLE").withColumn("srid", geo.utm_srid(F.col("lon"), F.col("lat")))
    there = df.withColumn("p", geo.reproject_rows(F.col("lon"), F.col("lat"), F.lit(4326), F.col("srid")))
    back = there.withColumn("b", geo.reproject_rows(F.col("p.x"), F.col("p.y"), F.col("srid"), F.lit(4326))).collect()
    assert [r.srid for r in back] == [32610, 32756, 32660, 32701, 32631, 32632]
    for r in back:
        assert abs(r.b.x - r.lon) * 111_000 < 1e-6 and abs(r.b.y - r.lat) * 111_000 < 1e-6 and 160_000 < r.p.x < 840_000
    assert back[1].p.y > 6e6 and back[0].p.y == pytest.approx(4_092_000, abs=2_000)
    # Equator and a neighbour's zone: the same place, one zone on.
    other = df.where("i = 0").select(geo.point(*geo.to_utm(F.col("lon"), F.col("lat"), 11)).alias("p")).first()["p"]
    assert other.x < 100_000
    with pytest.raises(Exception, match="27700 is not supported"):
        df.select(geo.reproject_rows(F.col("lon"), F.col("lat"), F.lit(27700), F.lit(4326))).collect()
    with pytest.raises(ValueError):
        geo.reproject(F.col("lon"), F.col("lat"), 4326, 32661)


def test_thirty_dry_years(spark):
    n = 11_000
    days = spark.range(n).select(F.lit(1).alias("station_id"), F.date_add(F.lit("1990-01-01"), F.col("id").cast("int")).alias("dt"), F.lit(0.0).alias("precipitation_sum"), F.lit(0.0).alias("pm10"))
    got = physics.equivalent_days(days, ["station_id"], EquivalentDay()).orderBy("dt").select("eqd").collect()
    state = 0.0
    for r in got:
        state += 1
        assert r.eqd == pytest.approx(state, rel=1e-12)
    assert len(got) == n


def test_one_file_a_tile(spark, tmp_path):
    rows = [(f"tile_{t}", i, f"0 {t} {i}", "train" if t % 2 else "val") for t in range(40) for i in range(t % 5 + 1)]
    df = spark.createDataFrame(rows, "tile STRING, line_no INT, line STRING, split STRING").repartition(7)
    label_files.write_label_files(df, str(tmp_path), split="split")
    label_files.write_label_files(df, f"file:{tmp_path}", split="split")  # again: the same files
    found = {}
    for folder, _, names in os.walk(tmp_path):
        for name in names:
            with open(os.path.join(folder, name)) as f:
                assert name not in found
                found[name] = (os.path.relpath(folder, tmp_path).split(os.sep), f.read().splitlines())
    assert set(found) == {f"tile_{t}.txt" for t in range(40)}
    for t in range(40):
        (split, digits), lines = found[f"tile_{t}.txt"]
        assert split == ("train" if t % 2 else "val") and len(digits) == 2 and lines == [f"0 {t} {i}" for i in range(t % 5 + 1)]


def test_label_archives_hold_the_same_files(spark, tmp_path):
    import zipfile

    rows = [(f"tile_{t}", i, f"0 {t} {i}", "train" if t % 2 else "val") for t in range(40) for i in range(t % 5 + 1)]
    df = spark.createDataFrame(rows, "tile STRING, line_no INT, line STRING, split STRING").repartition(7)
    label_files.write_label_files(df, f"{tmp_path}/files", split="split")
    label_files.write_label_archives(df, f"file:{tmp_path}/zips", split="split")
    want = {str(f.relative_to(tmp_path / "files")): f.read_bytes() for f in (tmp_path / "files").rglob("*.txt")}
    got = {}
    for path in (tmp_path / "zips").iterdir():
        assert path.suffix == ".zip"
        with zipfile.ZipFile(path) as archive:
            for name in archive.namelist():
                assert name not in got
                got[name] = archive.read(name)
    assert got == want and len(want) == 40
    lines = {(r.name, r.line) for r in label_files.read_label_archives(spark, f"{tmp_path}/zips").collect()}
    assert lines == {(name, line) for name, text in want.items() for line in text.decode().splitlines()}
