"""Polygons, crowded cells, crowded tiles, nearest points and mask sums against brute force."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import cells, detect, polygons, quality, spatial

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def quad(cx, cy, w, h, turn):
    c, s = math.cos(turn), math.sin(turn)
    return [(cx + c * x - s * y, cy + s * x + c * y) for x, y in ((-w, -h), (w, -h), (w, h), (-w, h))]


def test_rings_that_touch():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)
    yes = [square, square + [2, 0], square + [2, 1], square / 2 + 0.5, square * 3 - 2, np.array([[1, 0], [2, 1], [1, 2], [0, 1]], float),
           np.array([[-1, 1], [1, -1], [3, 1], [1, 3]], float), np.array([[0, 0], [2, 2], [4, 1]], float), np.array([[0, 0], [2, 2], [0, 4]], float)]
    no = [square + [2, 2], square + [3, 0], np.array([[3, 0], [4, 1], [3, 2], [2, 1]], float), np.array([[2.5, 0], [4, 1.5], [4, -2]], float),
          np.array([[0, 4.5], [4.5, 0], [5, 5]], float)]
    for ring in yes:
        assert polygons.rings_overlap(square, ring) and polygons.rings_overlap(ring, square)
    for ring in no:
        assert not polygons.rings_overlap(square, ring) and not polygons.rings_overlap(ring, square)


def components(n, pairs):
    forest = polygons.Forest(n)
    for a, b in pairs:
        forest.up[forest.root(a)] = forest.root(b)
    groups = {}
    for i in range(n):
        groups.setdefault(forest.root(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def sample(rings, x0, x1, step):
    """Which points of a fine grid lie in a ring."""
    axis = np.arange(x0, x1, step) + step / 2.1
    grid = np.stack(np.meshgrid(axis, axis), -1).reshape(-1, 2)
    return np.array([polygons.inside(grid, np.array(r)) for r in rings])


def test_dissolve_polygons(spark):
    rng = random.Random(3)
    rings = [quad(rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(3, 20), rng.uniform(2, 6), rng.uniform(0, 3)) for _ in range(130)]
    rings += [rings[0], rings[0] + rings[0][:1], [(500.0, 500.0), (501.0, 500.0)], [(600.0, 600.0), (600.1, 600.0), (600.0, 600.1)]]
    got = {r.array_id: r.component for r in polygons.dissolve_polygons(
        spark.createDataFrame(list(enumerate(rings)), f"array_id LONG, ring {RING}"), cell=50.0).select("array_id", "component").collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(132), 2) if polygons.rings_overlap(np.array(rings[i][:4]), np.array(rings[j][:4]))]
    assert got == components(132, pairs) and len(set(got.values())) < 100
    # Boxes of turned rings overlap far more often than the rings do.
    boxes = [(min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r)) for r in rings[:132]]
    crowded = [(i, j) for i, j in itertools.combinations(range(132), 2)
               if boxes[i][0] <= boxes[j][2] and boxes[j][0] <= boxes[i][2] and boxes[i][1] <= boxes[j][3] and boxes[j][1] <= boxes[i][3]]
    assert len(pairs) < len(crowded)


def test_polygon_union_area(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(3):
        rings = [quad(rng.uniform(30, 90), rng.uniform(30, 90), rng.uniform(3, 20), rng.uniform(2, 9), rng.uniform(0, 3)) for _ in range(10 + 40 * k)]
        want[k] = sample(rings, 0, 120, 0.2).any(axis=0).sum() * 0.04
        rows += [(k, r) for r in rings + rings[:3]]
    got = polygons.polygon_union_area(spark.createDataFrame(rows, f"k INT, ring {RING}"), ["k"], 40.0).collect()
    assert {r.k: r.union_area for r in got} == {k: pytest.approx(v, rel=0.01) for k, v in want.items()}
    pile = [quad(100 + rng.uniform(-1, 1), 100 + rng.uniform(-1, 1), 40, 30, 0.3) for _ in range(120)]
    area = polygons.polygon_union_area(spark.createDataFrame([(1, r) for r in pile], f"k INT, ring {RING}"), ["k"]).first()["union_area"]
    assert area == pytest.approx(sample(pile, 40, 160, 0.2).any(axis=0).sum() * 0.04, rel=0.005)


def test_box_pile_area():
    rng = np.random.default_rng(12)
    low = rng.integers(0, 300, (5000, 2))
    boxes = np.concatenate([low, low + rng.integers(1, 12, (5000, 2))], axis=1)
    grid = np.zeros((320, 320), bool)
    for a, b, c, d in boxes:
        grid[a:c, b:d] = True
    assert polygons.covered_boxes(boxes.astype(float), 0, 0, 320, 320) == grid.sum()
    pile = np.concatenate([rng.uniform(0, 2, (20_000, 2)), rng.uniform(30, 32, (20_000, 2))], axis=1)
    outer = (pile[:, 2].max() - pile[:, 0].min()) * (pile[:, 3].max() - pile[:, 1].min())
    assert 28 * 28 < polygons.covered_boxes(pile, 0, 0, 50, 50) <= outer


def test_links_of_a_pile_stay_few(spark):
    rng = random.Random(5)
    boxes = [(i, (x := rng.uniform(0, 3)), (y := rng.uniform(0, 3)), x + 20 + rng.random(), y + 20 + rng.random()) for i in range(800)]
    boxes += [(800 + i, 50.0 + 3 * i, 0.0, 53.0 + 3 * i, 2.0) for i in range(50)]
    df = spark.createDataFrame(boxes, "array_id LONG, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    assert polygons.overlap_links(df, "array_id", 200.0, False).count() < 2000
    got = {r.array_id: r.component for r in polygons.dissolve(df).collect()}
    assert got == {i: 0 if i < 800 else 800 for i in range(850)}


@pytest.mark.parametrize("n", [1, 2, 400])
def test_links_join_what_overlaps(n):
    rng = np.random.default_rng(n)
    low = rng.integers(0, 60, (n, 2)).astype(float)
    boxes = np.concatenate([low, low + rng.integers(1, 6, (n, 2))], axis=1)
    wide = np.minimum(boxes[:, None, 2], boxes[None, :, 2]) - np.maximum(boxes[:, None, 0], boxes[None, :, 0])
    high = np.minimum(boxes[:, None, 3], boxes[None, :, 3]) - np.maximum(boxes[:, None, 1], boxes[None, :, 1])
    pairs = np.argwhere((wide >= 0) & (high >= 0) & ((wide > 0) | (high > 0)))
    found = polygons.links(boxes)
    assert len(found) < n and components(n, found) == components(n, pairs.tolist())


def test_crowded_cells_are_cut(spark):
    """Half of all boxes in one place: no cell holds more than the bound, and every meeting pair is met once."""
    rng = random.Random(6)
    spot = lambda half: (rng.uniform(0, 30), rng.uniform(0, 30)) if half else (rng.uniform(-2000, 2000), rng.uniform(-2000, 2000))
    box = lambda i: (lambda p: (i, p[0], p[1], p[0] + rng.uniform(0, 1), p[1] + rng.uniform(0, 1)))(spot(i % 2))
    a, b = [box(i) for i in range(2000)], [box(i) for i in range(1500)]
    cols = "{0}_id LONG, {0}_minx DOUBLE, {0}_miny DOUBLE, {0}_maxx DOUBLE, {0}_maxy DOUBLE"
    left, right = spark.createDataFrame(a, cols.format("l")), spark.createDataFrame(b, cols.format("r"))
    boxes = left.toDF("id", *cells.BOX).unionByName(right.toDF("id", *cells.BOX))
    placed = cells.assigned(boxes, 200.0, bound=60)
    assert placed.groupBy("_level", "_cx", "_cy").count().agg(F.max("count")).first()[0] <= 60
    assert placed.select("id", *cells.BOX).distinct().count() == boxes.distinct().count()
    x, y = np.array(a), np.array(b)
    meet = (x[:, None, 1] <= y[:, 3]) & (y[:, 1] <= x[:, None, 3]) & (x[:, None, 2] <= y[:, 4]) & (y[:, 2] <= x[:, None, 4])
    got = [(r.l_id, r.r_id) for r in cells.meeting(left, right, 200.0, bound=60).select("l_id", "r_id").collect()]
    assert sorted(got) == [(int(i), int(j)) for i, j in np.argwhere(meet)]
    # A pile can't be cut apart: its cell stays whole instead of growing copies.
    pile = spark.createDataFrame([(i, 0.0, 0.0, 150.0, 150.0) for i in range(500)], cols.format("l")).toDF("id", *cells.BOX)
    assert cells.assigned(pile, 200.0, bound=60).count() == 500


def plain_greedy(pairs):
    taken, gone_p, gone_t = [], set(), set()
    for i, (p, t) in enumerate(pairs):
        if p not in gone_p and t not in gone_t:
            gone_p.add(p)
            gone_t.add(t)
            taken.append(i)
    return taken


def test_greedy_rounds():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 60, 4000):
        pred = np.sort(rng.integers(0, max(1, n // 3), n))
        truth = rng.integers(0, max(1, n // 4), n)
        assert sorted(detect.greedy(pred, truth).tolist()) == plain_greedy(list(zip(pred.tolist(), truth.tolist())))
    # A chain: each prediction wants what the one before took, and then the next.
    pred = np.repeat(np.arange(50_000), 2)
    truth = np.maximum(0, pred - 1 + np.tile([0, 1], 50_000))
    start = time.perf_counter()
    assert sorted(detect.greedy(pred, truth).tolist()) == plain_greedy(list(zip(pred.tolist(), truth.tolist())))
    assert time.perf_counter() - start < 5


def test_crowded_tile_takes_seconds(spark):
    rng = np.random.default_rng(9)
    def boxes(n):
        low = rng.uniform(0, 600, (n, 2))
        return np.concatenate([low, low + rng.uniform(15, 40, (n, 2))], axis=1)
    n = 5000
    gts = boxes(n)
    preds = gts[rng.permutation(n)] + rng.normal(0, 2, (n, 4))
    box = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    g = spark.createDataFrame([(1, i, *b) for i, b in enumerate(gts.tolist())], f"tile_id INT, gt_idx LONG, {box}")
    p = spark.createDataFrame([(1, i, 1 - i / n, *b) for i, b in enumerate(preds.tolist())], f"tile_id INT, pred_idx LONG, conf DOUBLE, {box}")
    pairs = detect.overlap_pairs(p, g, 0.5).select("pred_idx", "iou", "gt_idx").collect()
    order = sorted((r.pred_idx, -r.iou, r.gt_idx) for r in pairs)
    want = {order[i][::2] for i in plain_greedy([(a, c) for a, _, c in order])}
    start = time.perf_counter()
    got = {(r.pred_idx, r.gt_idx) for r in detect.match(p, g, 0.5).collect()}
    assert time.perf_counter() - start < 30 and got == want and len(got) > 3000


def test_nearest_point_of_a_city(spark):
    rng = random.Random(10)
    city = [(37 + rng.gauss(0, 0.004), -122 + rng.gauss(0, 0.004)) for _ in range(4000)]
    points = city + [(rng.uniform(36, 38), rng.uniform(-123, -121)) for _ in range(60)] + [city[0], (None, 1.0)]
    sites = [(i, 37 + rng.gauss(0, 0.03), -122 + rng.gauss(0, 0.03)) for i in range(80)] + [(100 + i, rng.uniform(36, 38), rng.uniform(-123, -121)) for i in range(60)]
    sites += [(200, *city[0]), (200, *city[0])]
    got = spatial.min_distance(spark.createDataFrame(sites, "station_id INT, latitude DOUBLE, longitude DOUBLE"),
                               spark.createDataFrame(points, "lat DOUBLE, lon DOUBLE"), "d").collect()
    assert len(got) == len(sites)

    def haversine(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    for (i, lat, lon), r in zip(sorted(sites), sorted(got)):
        dlat, dlon = 5000 / 111000, 5000 / (111000 * max(0.1, math.cos(math.radians(lat))))
        near = [haversine(lat, lon, *p) for p in points if p[0] is not None and abs(p[0] - lat) <= dlat and abs(p[1] - lon) <= dlon]
        assert r.station_id == i and r.d == pytest.approx(min(near, default=5000.0), abs=1e-6)


def test_mask_sums(spark):
    rng = random.Random(11)
    runs, masks = [], {}
    for _ in range(300):
        tile, y, x, w, label = rng.randrange(3), rng.randrange(12), rng.randrange(90), rng.randrange(0, 25), rng.random() < 0.5
        runs.append((tile, y, x, x + w, label))
        masks.setdefault((tile, label), np.zeros((12, 130), bool))[y, x : x + w] = True
    got = quality.mask_sums(spark.createDataFrame(runs, "tile_id INT, y INT, x0 INT, x1 INT, label BOOLEAN"), "tile_id", "label").collect()
    assert {tuple(r) for r in got} == {(t, int(masks[t, True].sum()), int((masks[t, True] & masks[t, False]).sum()), int((masks[t, True] | masks[t, False]).sum())) for t in range(3)}


def test_boxes_are_one_block_and_piles_count_once(spark):
    rng = random.Random(12)
    box = lambda x, y, w, h: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    tall = spark.createDataFrame([(1, box(3, 2, 5, 600))], f"id INT, ring {RING}")
    assert [tuple(b) for b in tall.select(quality.mask_blocks(F.col("ring"))).first()[0]] == [(2, 602, 3, 8)]
    sides = {True: [], False: []}
    for tile in range(6):
        for i in range(2 + tile * 3):
            for label in sides:
                x, y, w, h = rng.randrange(200), rng.randrange(200), rng.randrange(1, 90), rng.randrange(1, 90)
                sides[label].append((tile, i, 0.9 if i % 2 else 0.2, [*box(x, y, w, h)[: 3 if i % 4 == 3 else 4]]))
    schema = f"tile_id INT, {{}} INT, conf DOUBLE, ring {RING}"
    labels, preds = spark.createDataFrame(sides[True], schema.format("gt_idx")), spark.createDataFrame(sides[False], schema.format("pred_idx"))
    masks = {}
    for label, df, index in ((True, labels, "gt_idx"), (False, preds, "pred_idx")):
        for r in quality.mask_runs(df, ["tile_id", index]).collect():
            masks.setdefault((r.tile_id, label, r[index]), np.zeros((300, 300), bool))[r.y, r.x0 : r.x1] = True
    got = {r.tile_id: r for r in quality.label_disagreement(labels.drop("conf"), preds).collect()}
    for tile in range(6):
        own = {label: {i: m for (t, side, i), m in masks.items() if (t, side) == (tile, label)} for label in sides}
        iou = {(i, j): (a & b).sum() / (a | b).sum() for i, a in own[True].items() for j, b in own[False].items()}
        l, p = (np.any(list(own[label].values()), axis=0) for label in (True, False))
        n = 2 + tile * 3
        assert got[tile].overall_iou == pytest.approx((l & p).sum() / (l | p).sum(), abs=1e-12)
        assert got[tile].label_polys_uncovered == sum(max((iou.get((i, j), 0) for j in range(n)), default=0) < 0.3 for i in range(n))
        assert got[tile].confident_fps == sum(j % 2 == 1 and not any(iou.get((i, j), 0) for i in range(n)) for j in range(n))
