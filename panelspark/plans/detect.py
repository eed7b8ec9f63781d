"""Queries: detection evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.config import SweepGrid
from panelspark.operators import buckets as B
from panelspark.operators import detect as M
from panelspark.plans.registry import query

IOU_SQL = """(CASE WHEN {u} <= 0 THEN 0 ELSE {i} / {u} END)""".replace("{i}", "({ix} * {iy})")
_IX = "GREATEST(0e0, LEAST(p.x2, g.x2) - GREATEST(p.x1, g.x1))"
_IY = "GREATEST(0e0, LEAST(p.y2, g.y2) - GREATEST(p.y1, g.y1))"
_U = f"((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {_IX} * {_IY})"
IOU = f"({_IX} * {_IY} / {_U})"
PAIRS = f"""SELECT p.tile_id, p.pred_idx, g.gt_idx, p.conf, {IOU} AS iou
    FROM f_pred p JOIN f_gt g USING (tile_id) WHERE {IOU} >= {{thr}} AND {IOU} > 0"""


def match_sql(thr: str = "0.5", where: str = "TRUE", pairs: str | None = None) -> str:
    """Literal greedy loop as a recursion over the prediction number; gives CTE ``m``."""
    return f"""WITH RECURSIVE pr AS MATERIALIZED (SELECT * FROM ({pairs or PAIRS.format(thr=thr)}) z WHERE {where}),
      n AS (SELECT tile_id, MAX(pred_idx) AS n FROM pr GROUP BY 1),
      rec AS (
        SELECT tile_id, CAST(0 AS BIGINT) AS k, n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS gt FROM n
        UNION ALL
        SELECT tile_id, k + 1, n, CASE WHEN gt IS NULL THEN used ELSE LIST_APPEND(used, gt) END, gt FROM (
          SELECT r.tile_id, r.k, ANY_VALUE(r.n) AS n, ANY_VALUE(r.used) AS used,
            ARG_MIN(pr.gt_idx, ROW(-pr.iou, pr.gt_idx)) FILTER (WHERE pr.gt_idx IS NOT NULL) AS gt
          FROM rec r LEFT JOIN pr ON pr.tile_id = r.tile_id AND pr.pred_idx = r.k + 1
            AND NOT LIST_CONTAINS(r.used, pr.gt_idx)
          WHERE r.k < r.n GROUP BY r.tile_id, r.k) q),
      m AS (SELECT rec.tile_id, rec.k AS pred_idx, rec.gt AS gt_idx, pr.conf, pr.iou FROM rec
        JOIN pr ON pr.tile_id = rec.tile_id AND pr.pred_idx = rec.k AND pr.gt_idx = rec.gt)"""


_BOX = """({s}.x2 - {s}.x1) * ({s}.y2 - {s}.y1)"""
DET = match_sql() + """,
  g AS (SELECT *, (x2 - x1) * (y2 - y1) AS a, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
      GREATEST(x2 - x1, y2 - y1) / LEAST(x2 - x1, y2 - y1) AS ar FROM f_gt),
  p AS (SELECT *, (x2 - x1) * (y2 - y1) AS a, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
      GREATEST(x2 - x1, y2 - y1) / LEAST(x2 - x1, y2 - y1) AS ar FROM f_pred),
  ng AS (SELECT tile_id, COUNT(*) AS n FROM f_gt GROUP BY 1),
  d0 AS (
    SELECT m.tile_id, 'tp' AS class, m.pred_idx, m.gt_idx, m.iou, p.conf, p.a AS pa, g.a AS ga, p.cx AS px, p.cy AS py,
      g.cx AS gx, g.cy AS gy, p.ar AS par, g.ar AS gar
    FROM m JOIN p ON p.tile_id = m.tile_id AND p.pred_idx = m.pred_idx JOIN g ON g.tile_id = m.tile_id AND g.gt_idx = m.gt_idx
    UNION ALL
    SELECT p.tile_id, 'fp', p.pred_idx, NULL, NULL, p.conf, p.a, NULL, p.cx, p.cy, NULL, NULL, p.ar, NULL FROM p
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tile_id = p.tile_id AND m.pred_idx = p.pred_idx)
    UNION ALL
    SELECT g.tile_id, 'fn', NULL, g.gt_idx, NULL, NULL, NULL, g.a, NULL, NULL, g.cx, g.cy, NULL, g.ar FROM g
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tile_id = g.tile_id AND m.gt_idx = g.gt_idx)),
  det AS (SELECT d0.tile_id, class, pred_idx, gt_idx, iou, conf, pa AS pred_area_px, ga AS gt_area_px,
      px AS pred_centroid_x, py AS pred_centroid_y, gx AS gt_centroid_x, gy AS gt_centroid_y,
      CASE WHEN class = 'fp' THEN LEAST(px, py, 640 - px, 640 - py) ELSE LEAST(gx, gy, 640 - gx, 640 - gy) END AS distance_to_image_edge_px,
      CASE WHEN class = 'fp' THEN COALESCE(n, 0) ELSE GREATEST(0, n - 1) END AS num_other_panels_in_tile,
      par AS pred_aspect, gar AS gt_aspect
    FROM d0 LEFT JOIN ng ON ng.tile_id = d0.tile_id),
  b AS (SELECT *, CASE WHEN COALESCE(gt_area_px, pred_area_px) < 800 THEN 'small_lt800'
        WHEN COALESCE(gt_area_px, pred_area_px) < 4000 THEN 'medium_800_4000' ELSE 'large_ge4000' END AS size_bucket,
      CASE WHEN distance_to_image_edge_px < 40 THEN 'near_lt40' WHEN distance_to_image_edge_px < 120 THEN 'mid_40_120' ELSE 'far_ge120' END AS edge_bucket,
      CASE WHEN num_other_panels_in_tile = 0 THEN 'alone' WHEN num_other_panels_in_tile < 4 THEN 'few_1_3' ELSE 'crowded_ge4' END AS density_bucket
    FROM det)"""
CNT = ", ".join(f"COUNT(*) FILTER (WHERE class = '{c}') AS {c}" for c in ("tp", "fp", "fn"))


def matches(t):
    return M.match(t.f_pred, t.f_gt)


def detections(t):
    return M.matched_rows(t.f_pred, t.f_gt)


@query("j10_overlap_pairs", PAIRS.format(thr="0.3"), "conf, iou")
def j10(t):
    return M.overlap_pairs(t.f_pred, t.f_gt, 0.3)


@query("j11_greedy_match", match_sql() + " SELECT tile_id, pred_idx, gt_idx, conf, iou FROM m", "conf, iou")
def j11(t):
    return matches(t)


@query("j23_detection_rows", DET + " SELECT * FROM det",
       "iou, conf, pred_area_px, gt_area_px, pred_centroid_x, pred_centroid_y, gt_centroid_x, gt_centroid_y, "
       "distance_to_image_edge_px, pred_aspect, gt_aspect")
def j23(t):
    return detections(t)


@query("a03_detection_metrics", DET + f""", c AS (SELECT {CNT}, COUNT(DISTINCT tile_id) AS n_tiles FROM det),
    r AS (SELECT *, tp * 1e0 / (tp + fp) AS precision, tp * 1e0 / (tp + fn) AS recall FROM c)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r""", "precision, recall, f1")
def a03(t):
    return M.detection_metrics(detections(t))


MODES = DET + f""", c AS (SELECT size_bucket, edge_bucket, density_bucket, {CNT} FROM b
      GROUP BY GROUPING SETS ((), (size_bucket), (edge_bucket), (density_bucket))),
    modes AS (SELECT CASE WHEN size_bucket IS NOT NULL THEN 'size' WHEN edge_bucket IS NOT NULL THEN 'edge'
        WHEN density_bucket IS NOT NULL THEN 'density' ELSE 'overall' END AS dimension,
      COALESCE(size_bucket, edge_bucket, density_bucket, 'all') AS bucket, tp, fp, fn,
      CASE WHEN tp + fn > 0 THEN fn * 1e0 / (tp + fn) END AS fn_rate, CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) END AS precision FROM c)"""


@query("a04_failure_modes", MODES + " SELECT * FROM modes", "fn_rate, precision")
def a04(t):
    return M.failure_modes(detections(t))


# The fixture's boxes are all below the large-array limit, so the headline is checked with areas scaled by 4.
@query("a05_small_array_headline", DET + f""", z AS (
    SELECT COUNT(*) FILTER (WHERE class = 'fn' AND s < 800) * 1e0 / COUNT(*) FILTER (WHERE class <> 'fp' AND s < 800) AS small_fn_rate,
      COUNT(*) FILTER (WHERE class = 'fn' AND s >= 4000) * 1e0 / COUNT(*) FILTER (WHERE class <> 'fp' AND s >= 4000) AS large_fn_rate
    FROM (SELECT *, COALESCE(gt_area_px, pred_area_px) * 4 AS s FROM det) q)
    SELECT *, small_fn_rate / large_fn_rate AS ratio FROM z WHERE large_fn_rate > 0""",
       "small_fn_rate, large_fn_rate, ratio")
def a05(t):
    rows = detections(t).withColumn("gt_area_px", F.col("gt_area_px") * 4).withColumn(
        "pred_area_px", F.col("pred_area_px") * 4)
    return M.headline(M.failure_modes(rows))


@query("a06_worst_tiles", DET + f""", c AS (SELECT tile_id, {CNT}, COALESCE(AVG(iou), 0) AS mean_iou FROM det GROUP BY 1)
    SELECT tile_id, fp, fn, tp + fp + fn AS total, mean_iou FROM c ORDER BY fp + fn DESC, tile_id LIMIT 10""", "mean_iou")
def a06(t):
    return M.worst_tiles(detections(t))


@query("a31_confusion_counts", DET + f" SELECT tile_id, {CNT} FROM det GROUP BY ROLLUP (tile_id)")
def a31(t):
    return M.confusion(detections(t))


GRID = SweepGrid()
SWEEP = "WITH " + ", ".join(
    f"t{i} AS ({match_sql(str(x))} SELECT CAST({x} AS DOUBLE) AS iou, conf FROM m)" for i, x in enumerate(GRID.iou)
) + ", mm AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(GRID.iou))) + """),
    grid AS (SELECT CAST(c AS DOUBLE) AS conf, CAST(i AS DOUBLE) AS iou FROM (SELECT UNNEST([%s]) AS c) x CROSS JOIN (SELECT UNNEST([%s]) AS i) y),
    k AS (SELECT g.conf, g.iou, (SELECT COUNT(*) FROM mm WHERE mm.iou = g.iou AND mm.conf >= g.conf) AS tp,
      (SELECT COUNT(*) FROM f_pred p WHERE p.conf >= g.conf) AS np, (SELECT COUNT(*) FROM f_gt) AS ng FROM grid g),
    c AS (SELECT conf, iou, tp, np - tp AS fp, ng - tp AS fn FROM k),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0 END AS precision, tp * 1e0 / (tp + fn) AS recall FROM c),
    s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)""" % (
    ", ".join(map(str, GRID.conf)), ", ".join(map(str, GRID.iou)))


@query("d04_threshold_sweep", SWEEP + " SELECT * FROM s", "conf, iou, precision, recall, f1")
def d04(t):
    return M.threshold_sweep(t.f_pred, t.f_gt, GRID.conf, GRID.iou)


@query("o03_best_sweep_row", SWEEP + " SELECT * FROM s ORDER BY f1 DESC, conf, iou LIMIT 1",
       "conf, iou, precision, recall, f1")
def o03(t):
    return M.best_row(M.threshold_sweep(t.f_pred, t.f_gt, GRID.conf, GRID.iou), "f1", ["conf", "iou"])


AP_IOUS = [0.5 + 0.05 * i for i in range(10)]
AP_SQL = "WITH " + ", ".join(
    f"t{i} AS ({match_sql(repr(x))} SELECT CAST({x!r} AS DOUBLE) AS iou_threshold, conf FROM m)" for i, x in enumerate(AP_IOUS)
) + ", mm AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(10)) + """),
    grid AS (SELECT CAST(i AS DOUBLE) AS iou_threshold FROM (SELECT UNNEST([%s]) AS i) y),
    pt AS (SELECT g.iou_threshold, c.conf, c.n, (SELECT COUNT(*) FROM mm WHERE mm.iou_threshold = g.iou_threshold AND mm.conf = c.conf) AS tp
      FROM grid g CROSS JOIN (SELECT conf, COUNT(*) AS n FROM f_pred GROUP BY 1) c),
    cu AS (SELECT *, SUM(tp) OVER w * 1e0 / SUM(n) OVER w AS precision FROM pt WINDOW w AS (PARTITION BY iou_threshold ORDER BY conf DESC)),
    en AS (SELECT *, MAX(precision) OVER (PARTITION BY iou_threshold ORDER BY conf) AS envelope FROM cu)
    SELECT iou_threshold, SUM(tp * envelope) / (SELECT COUNT(*) FROM f_gt) AS average_precision FROM en GROUP BY 1""" % (
    ", ".join(map(repr, AP_IOUS)))


@query("a35_average_precision", AP_SQL, "iou_threshold, average_precision")
def a35(t):
    return M.average_precision(t.f_pred, t.f_gt, AP_IOUS)


@query("p09_buckets", DET + " SELECT tile_id, class, pred_idx, gt_idx, size_bucket, edge_bucket, density_bucket FROM b")
def p09(t):
    return M.with_buckets(detections(t)).select(
        "tile_id", "class", "pred_idx", "gt_idx", "size_bucket", "edge_bucket", "density_bucket")


@query("p10_clause_filter", DET + " SELECT tile_id, pred_idx, conf FROM det WHERE class = 'fp' AND conf > 0.5 AND num_other_panels_in_tile <> 2",
       "conf")
def p10(t):
    rows = detections(t)
    return rows.where(B.clause_filter("class=fp AND conf>0.5 and num_other_panels_in_tile != 2", rows.columns)).select(
        "tile_id", "pred_idx", "conf")


P11 = {
    "worst_small_fn": ("class = 'fn' AND gt_area_px < 800", "gt_area_px"),
    "edge_fn": ("class = 'fn' AND distance_to_image_edge_px < 40", "distance_to_image_edge_px"),
    "confident_fp": ("class = 'fp'", "conf DESC"),
    "large_fp": ("class = 'fp' AND pred_area_px >= 4000", "pred_area_px DESC"),
    "worst_iou_tp": ("class = 'tp'", "iou"),
}


@query("p11_bucket_presets", DET + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS bucket, * FROM (SELECT tile_id, pred_idx, gt_idx FROM det WHERE {w} "
    f"ORDER BY {o}, tile_id, pred_idx NULLS FIRST, gt_idx NULLS FIRST LIMIT 20) x{i}" for i, (n, (w, o)) in enumerate(P11.items())
) + ") SELECT * FROM u")
def p11(t):
    # The five buckets read one materialised per-detection table.
    rows = detections(t).persist()
    out = None
    for name, (where, rank) in B.presets().items():
        part = B.top_bucket(rows, where, rank).select(F.lit(name).alias("bucket"), "tile_id", "pred_idx", "gt_idx")
        out = part if out is None else out.unionByName(part)
    return out


@query("o02_top_bucket_by_tile", DET + """, s AS (SELECT * FROM det WHERE class = 'fp' AND conf > 0.3
      ORDER BY distance_to_image_edge_px, tile_id, pred_idx LIMIT 20)
    SELECT tile_id, COUNT(*) AS n_selected, STRING_AGG(CONCAT('fp:', pred_idx), ',' ORDER BY CONCAT('fp:', pred_idx)) AS selected FROM s GROUP BY 1""")
def o02(t):
    rows = detections(t)
    return B.by_tile(B.top_bucket(rows, B.clause_filter("class=fp AND conf>0.3"), F.asc("distance_to_image_edge_px")))


@query("o08_top_false_positive_tiles", DET + """ SELECT DISTINCT tile_id FROM (
    SELECT tile_id FROM det WHERE class = 'fp' AND conf >= 0.30 ORDER BY conf DESC, tile_id, pred_idx LIMIT 5) q""")
def o08(t):
    return B.distinct_tiles_of_top(detections(t))


@query("p25_fixed_denominator", DET + f""", c AS (SELECT {CNT}, COUNT(DISTINCT tile_id) AS n_tiles FROM det
      WHERE CONCAT(CASE tile_id % 3 WHEN 0 THEN 'train/sc_' WHEN 1 THEN 'test/sc_' ELSE 'test/kern_' END, tile_id) LIKE 'test/sc%'),
    r AS (SELECT *, tp * 1e0 / (tp + fp) AS precision, tp * 1e0 / (tp + fn) AS recall FROM c)
    SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM r""", "precision, recall, f1")
def p25(t):
    name = F.concat(F.element_at(F.array(F.lit("train/sc_"), F.lit("test/sc_"), F.lit("test/kern_")),
                                 (F.col("tile_id") % 3 + 1).cast("int")), F.col("tile_id"))
    keep = name.rlike("^test/sc_")
    preds, gts = t.f_pred.where(keep), t.f_gt.where(keep)
    return M.detection_metrics(M.matched_rows(preds, gts))
