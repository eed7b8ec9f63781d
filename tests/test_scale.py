"""The paths for large and skewed inputs give the same answers as brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import components as C
from panelspark.operators import detect as M
from panelspark.operators import labels as L
from panelspark.operators import polygons as P
from panelspark.operators import quality as Q
from panelspark.operators import scale as SC
from panelspark.operators import spatial as S
from panelspark.operators import stats as ST

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def test_long_chain_of_conflicts(spark):
    """Boxes in a row, each prediction over two truths: every match decides the next one."""
    n, box = 10_000, "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    g = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 10.0 * i + 10, 10.0) for i in range(n)], f"tile_id INT, gt_idx LONG, {box}")
    p = spark.createDataFrame([(1, i, 1 - i / n, 10.0 * i - 5.5, 0.0, 10.0 * i + 4.5, 10.0) for i in range(n)], f"tile_id INT, pred_idx LONG, conf DOUBLE, {box}")
    # The left truth overlaps a bit more, but the one before took it, all the way from the first.
    want = {(i, i) for i in range(n)}
    got = {(r.pred_idx, r.gt_idx) for r in M.match(p, g, 0.2).collect()}
    assert got == want


def test_numbering(spark):
    rows = [(1, 0.5, 0.0, 0.0, 1.0, 1.0), (1, 0.9, 0.0, 0.0, 1.0, 1.0), (2, 0.1, 3.0, 0.0, 4.0, 1.0), (2, 0.1, 0.0, 0.0, 1.0, 1.0)]
    got = M.numbered(spark.createDataFrame(rows, "tile_id INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")).collect()
    assert {(r.tile_id, r.conf, r.x1): r.pred_idx for r in got} == {(1, 0.9, 0.0): 1, (1, 0.5, 0.0): 2, (2, 0.1, 0.0): 1, (2, 0.1, 3.0): 2}


def test_one_crowded_tile(spark):
    rng = random.Random(7)
    box = lambda: (x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(10, 60), y + rng.uniform(10, 60))
    gts, preds = [box() for _ in range(150)], [box() for _ in range(200)]
    g = spark.createDataFrame([(1, i, *b) for i, b in enumerate(gts)], "tile_id INT, gt_idx LONG, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    p = spark.createDataFrame([(1, i, 1.0 - i / 500, *b) for i, b in enumerate(preds)], "tile_id INT, pred_idx LONG, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
        return i / u

    want, free = set(), set(range(len(gts)))
    for i, a in enumerate(preds):
        best = max(free, key=lambda j: (iou(a, gts[j]), -j))
        if iou(a, gts[best]) >= 0.2:
            want.add((i, best))
            free.discard(best)
    got = {(r["pred_idx"], r["gt_idx"]) for r in M.match(p, g, 0.2).collect()}
    assert got == want


def test_sweep_equals_separate_matching(spark, tables):
    preds, gts = tables.f_pred, tables.f_gt
    sweep = {(r["conf"], r["iou"]): (r["tp"], r["fp"], r["fn"]) for r in M.threshold_sweep(preds, gts, [0.2, 0.6], [0.3, 0.5]).collect()}
    n_gt = gts.count()
    for conf, iou in sweep:
        kept = preds.where(F.col("conf") >= conf)
        tp = M.match(kept, gts, iou).count()
        assert sweep[conf, iou] == (tp, kept.count() - tp, n_gt - tp)


def skewed(spark, n=4000):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(n // 3, 0.25), np.round(rng.exponential(1.0, n // 3), 3), rng.normal(1e6, 1e-3, n - 2 * (n // 3))])
    g = rng.choice(["hot", "hot", "hot", "cold"], n)
    return v, g, spark.createDataFrame(list(zip(v.tolist(), g.tolist())), "v DOUBLE, g STRING")


def test_exact_quantiles(spark):
    v, g, df = skewed(spark)
    got = SC.exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
    assert [got["a"], got["b"], got["c"]] == pytest.approx(np.percentile(v, [5, 50, 95]).tolist(), abs=1e-9)
    for r in SC.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect():
        assert r["m"] == pytest.approx(float(np.median(v[g == r["g"]])), abs=1e-9)


def test_cumulative_and_ids(spark):
    v, _, df = skewed(spark)
    counts = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: r["c"] for r in SC.cumulative(counts, "v", {"c": "n"}).collect()}
    assert all(c == int((v <= x).sum()) for x, c in got.items())
    ids = [r["i"] for r in SC.sequential_ids(counts, "v", "i").orderBy("v").collect()]
    assert ids == list(range(len(got)))


def test_hash_positions_are_a_permutation(spark):
    got = SC.hash_positions(spark.range(5000), "id", 42, "p")
    rows = got.collect()
    assert sorted(r["p"] for r in rows) == list(range(5000)) and {r["total"] for r in rows} == {5000}
    again = {r["id"]: r["p"] for r in SC.hash_positions(spark.range(5000).repartition(3), "id", 42, "p").collect()}
    assert again == {r["id"]: r["p"] for r in rows}


def test_spearman_and_auc_with_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 6, 500), rng.integers(0, 9, 500)
    y = np.where(rng.random(500) < 0.5, x, y)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x INT, y INT")

    def rank(a):
        return np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])

    assert ST.spearman(df, "x", "y").first()["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-12)
    label = (y > 4).astype(int)
    d2 = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, label)], "s DOUBLE, y INT")
    pos, neg = x[label == 1], x[label == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert ST.roc_auc(d2, "s", "y").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_components_of_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    got = C.connected_components(spark.createDataFrame(chain + hub, "a LONG, b LONG")).collect()
    assert {r["component"] for r in got if r["id"] <= 200} == {0}
    assert {r["component"] for r in got if r["id"] >= 1000} == {1000}


def test_union_area(spark):
    rng = random.Random(2)
    boxes = [(rng.randrange(0, 400), rng.randrange(0, 400), rng.randrange(5, 90), rng.randrange(5, 90)) for _ in range(60)]
    grid = np.zeros((600, 600), dtype=bool)
    for x, y, w, h in boxes:
        grid[x:x + w, y:y + h] = True
    df = spark.createDataFrame([(1, float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in boxes * 2], "k INT, minx DOUBLE, miny DOUBLE, maxx DOUBLE, maxy DOUBLE")
    assert P.union_area(df, ["k"]).first()["union_area"] == float(grid.sum())


def random_rings(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        cx, cy, k = rng.uniform(0, 500), rng.uniform(0, 500), rng.choice([3, 4, 5, 6])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(k))
        out.append([(cx + rng.uniform(5, 20) * math.cos(t), cy + rng.uniform(5, 20) * math.sin(t)) for t in turns])
    return out


def brute_distance(a, b):
    def edges(r):
        return list(zip(r, r[1:] + r[:1]))

    def seg(p, s):
        (x1, y1), (x2, y2) = s
        d = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / d))
        return math.hypot(p[0] - x1 - t * (x2 - x1), p[1] - y1 - t * (y2 - y1))

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def inside(p, r):
        return sum(((u[1] > p[1]) != (v[1] > p[1])) and p[0] < (v[0] - u[0]) * (p[1] - u[1]) / (v[1] - u[1]) + u[0] for u, v in edges(r)) % 2 == 1

    for (p, q), (u, v) in itertools.product(edges(a), edges(b)):
        if side(p, q, u) * side(p, q, v) < 0 and side(u, v, p) * side(u, v, q) < 0:
            return 0.0
    if inside(a[0], b) or inside(b[0], a):
        return 0.0
    return min(min(seg(p, e) for p in a for e in edges(b)), min(seg(p, e) for p in b for e in edges(a)))


def test_neighbors_with_copies_and_rotated_rings(spark):
    rings = random_rings(70, 11)
    big = [[(200.0, 200.0), (330.0, 205.0), (325.0, 330.0), (205.0, 320.0)]]  # holds others
    rings = rings + big + [rings[0]] * 40
    df = spark.createDataFrame(list(enumerate(rings)), f"array_id INT, ring {RING}")
    got = {r["array_id"]: r for r in S.neighbor_features(df).collect()}
    box = lambda r: (min(p[0] for p in r), min(p[1] for p in r), max(p[0] for p in r), max(p[1] for p in r))
    area = lambda r: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1]))) / 2
    for i in list(range(0, 71, 3)) + [70, 75]:
        a = box(rings[i])
        cand = [j for j in range(len(rings)) if j != i and (b := box(rings[j]))[0] <= a[2] + 100 and b[2] >= a[0] - 100
                and b[1] <= a[3] + 100 and b[3] >= a[1] - 100]
        dist = [0.0 if rings[j] == rings[i] else brute_distance(rings[i], rings[j]) for j in cand]
        near = [area(rings[j]) for j, d in zip(cand, dist) if d <= 100]
        assert got[i]["neighbor_count_50m"] == sum(d <= 50 for d in dist)
        assert got[i]["neighbor_count_100m"] == len(near)
        assert got[i]["distance_to_nearest_array_m"] == (pytest.approx(min(dist), abs=1e-9) if dist else None)
        assert got[i]["mean_neighbor_area_100m"] == (pytest.approx(np.mean(near), rel=1e-9) if near else None)


def test_mask_runs_of_polygons(spark):
    rings = random_rings(12, 4)
    df = spark.createDataFrame(list(enumerate(rings)), f"id INT, ring {RING}")
    got = {}
    for r in Q.mask_runs(df, ["id"]).collect():
        got.setdefault(r["id"], set()).update((x, r["y"]) for x in range(r["x0"], r["x1"]))

    def inside(px, py, r):
        hit = False
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if (y1 <= py) != (y2 <= py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
                hit = not hit
        return hit

    for i, ring in enumerate(rings):
        want = {(x, y) for x in range(-30, 540) for y in range(-30, 540) if inside(x + 0.5, y + 0.5, ring)}
        assert got.get(i, set()) == want


def test_hull(spark):
    rng = random.Random(1)
    pts = [(1, float(rng.randrange(50)), float(rng.randrange(50))) for _ in range(500)]
    df = spark.createDataFrame(pts, "k INT, x DOUBLE, y DOUBLE")
    hull = [(p["x"], p["y"]) for p in C.group_hulls(df, ["k"]).first()["hull"]]
    turn = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2])]
    assert min(turn) > 0
    for _, x, y in pts:
        assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(hull, hull[1:] + hull[:1]))


def test_folds_keep_clusters_together_and_balanced(spark):
    df = spark.range(1000).withColumn("cluster", (F.sqrt("id")).cast("int"))
    got = L.assign_folds(df, "cluster", 5)
    assert got.groupBy("cluster").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 65 and sum(sizes) == 1000
