"""Detection evaluation: overlap pairs, greedy one-to-one matching, per-detection rows, metrics, sweeps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.operators.scale import cumulative, default_ranges, with_ranges
from panelspark.session import cut_lineage

CELL_PX = 128.0
BOX = ("x1", "y1", "x2", "y2")


def box_iou(a: str, b: str) -> Column:
    """intersection over union of columns ``{a}x1..y2`` and ``{b}x1..y2``; 0 when the union is empty."""
    c = lambda side, n: F.col(f"{side}{n}")
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))) * F.greatest(
        zero, F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")))
    area = lambda s: F.greatest(zero, c(s, "x2") - c(s, "x1")) * F.greatest(zero, c(s, "y2") - c(s, "y1"))
    union = area(a) + area(b) - inter
    return F.when(union <= 0, zero).otherwise(inter / union)


def _cells(df: DataFrame, side: str, cell: float) -> DataFrame:
    """Replicate a box over the grid cells it covers; image boxes are bounded by the tile, so this is a small factor."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"{side}{lo}") / cell), F.floor(F.col(f"{side}{hi}") / cell))
    return df.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))


def overlap_pairs(preds: DataFrame, gts: DataFrame, iou_min: float = 0.5, keys: Sequence[str] = ("tile_id",),
                  cell: float = CELL_PX) -> DataFrame:
    """Prediction x truth pairs of a tile with IoU >= iou_min (and > 0).

    Boxes meet only inside a shared grid cell of the tile, never all-against-all; a pair sharing several cells is
    kept in the one that holds the corner of its intersection.
    """
    p = _cells(preds.select(*keys, "pred_idx", "conf", *[F.col(b).alias(f"p_{b}") for b in BOX]), "p_", cell)
    g = _cells(gts.select(*keys, "gt_idx", *[F.col(b).alias(f"g_{b}") for b in BOX]), "g_", cell)
    home = (F.floor(F.greatest("p_x1", "g_x1") / cell) == F.col("_cx")) & (
        F.floor(F.greatest("p_y1", "g_y1") / cell) == F.col("_cy"))
    pairs = p.join(g, [*keys, "_cx", "_cy"]).where(home).withColumn("iou", box_iou("p_", "g_"))
    return pairs.where((F.col("iou") >= iou_min) & (F.col("iou") > 0)).select(
        *keys, "pred_idx", "gt_idx", "conf", "iou")


#: Boxes that one task matches together, about; rounds that take fewer than one pair in so many go pair by pair.
TOGETHER, SPARSE = 200_000, 200
#: Pairs of boxes of a tile up to which all of them are tried; tiles with more use cells. Pairs that are tried at a time.
PAIRWISE, AT_ONCE = 2_500, 1 << 20


def first_rows(run: np.ndarray) -> np.ndarray:
    """Whether a row begins a run of equal numbers."""
    return np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, dtype=bool)


def greedy(pred: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Rows that greedy matching takes from candidate pairs sorted by prediction (best first), then by preference.

    A round takes all pairs that stand first both for their prediction and for their truth, which no other pair can
    forestall, and drops what they rule out: each conflict component is solved by itself, all of them at once. A long
    chain of conflicts, of which a round takes a few pairs only, is walked through instead.
    """
    taken, rows = [], np.arange(len(pred))
    earliest = np.zeros(int(truth.max()) + 1 if len(truth) else 0, dtype=np.int64)
    gone_p, gone_t = np.zeros(int(pred.max()) + 1 if len(pred) else 0, dtype=bool), np.zeros(len(earliest), dtype=bool)
    while len(rows):
        earliest[truth[rows[::-1]]] = rows[::-1]
        first = rows[first_rows(pred[rows])]
        hit = first[earliest[truth[first]] == first]
        taken.append(hit)
        gone_p[pred[hit]] = gone_t[truth[hit]] = True
        rows = rows[~(gone_p[pred[rows]] | gone_t[truth[rows]])]
        if len(hit) * SPARSE < len(rows):
            walked = []
            for i, p, t in zip(rows.tolist(), pred[rows].tolist(), truth[rows].tolist()):
                if not (gone_p[p] or gone_t[t]):
                    gone_p[p] = gone_t[t] = True
                    walked.append(i)
            taken.append(np.array(walked, dtype=np.int64))
            break
    return np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)


def _tile_numbers(keys: Sequence[str], preds: pa.Table, gts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's tile, the same on both sides; -1 where a key is null, which meets nothing."""
    tile = np.zeros(len(preds) + len(gts), dtype=np.int64)
    missing = np.zeros(len(tile), dtype=bool)
    for k in keys:
        codes = pc.dictionary_encode(pa.chunked_array([*preds[k].chunks, *gts[k].chunks], preds[k].type).combine_chunks())
        own = codes.indices.fill_null(len(codes.dictionary)).to_numpy().astype(np.int64)
        missing |= own == len(codes.dictionary)
        tile = np.unique(tile * (len(codes.dictionary) + 1) + own, return_inverse=True)[1]
    tile[missing] = -1
    return tile[: len(preds)], tile[len(preds) :]


def _corners(rows: pa.Table, side: str) -> np.ndarray:
    return np.stack([pc.fill_null(rows[side + c].cast(pa.float64()), float("nan")).to_numpy() for c in BOX], axis=1)


def _spread(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each of ``rows`` with the ``count`` places from ``first`` on, about AT_ONCE pairs at a time."""
    cuts = np.searchsorted(np.cumsum(count), np.arange(AT_ONCE, count.sum() + 1, AT_ONCE), side="left") + 1
    for part in np.split(np.arange(len(rows)), np.unique(cuts)):
        n = count[part]
        if n.sum():
            yield np.repeat(rows[part], n), np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _in_cells(rows: np.ndarray, boxes: np.ndarray, tile: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows once for every cell (tile, column, row of the grid) that their boxes cover."""
    rows = rows[np.isfinite(boxes[rows]).all(axis=1)]
    low, high = np.floor(boxes[rows, :2] / cell).astype(np.int64), np.floor(boxes[rows, 2:] / cell).astype(np.int64)
    wide, tall = np.maximum(high - low + 1, 0).T
    n = wide * tall
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    across = np.repeat(wide, n)
    at = np.repeat(low, n, axis=0) + np.stack([k % np.maximum(across, 1), k // np.maximum(across, 1)], axis=1)
    return np.repeat(rows, n), np.concatenate([np.repeat(tile[rows], n)[:, None], at], axis=1)


def box_candidates(p: np.ndarray, tile_p: np.ndarray, g: np.ndarray, tile_g: np.ndarray, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of p and g (boxes, n x 4; tiles ascending) of the same tile that may overlap, each pair once.

    All pairs of a tile with few; of others those that share a grid cell, kept in the cell with the corner of what they share.
    """
    n = int(max(tile_p.max(initial=-1), tile_g.max(initial=-1))) + 1
    known = lambda tile: np.bincount(tile[tile >= 0], minlength=n)
    count = known(tile_g)
    first = np.cumsum(count) - count + (tile_g < 0).sum()
    crowded = known(tile_p) * count > PAIRWISE
    few = np.flatnonzero((tile_p >= 0) & ~crowded[tile_p]) if n else np.zeros(0, dtype=np.int64)
    yield from _spread(few, first[tile_p[few]], count[tile_p[few]])
    if crowded.any():
        i, at_p = _in_cells(np.flatnonzero((tile_p >= 0) & crowded[tile_p]), p, tile_p, cell)
        j, at_g = _in_cells(np.flatnonzero((tile_g >= 0) & crowded[tile_g]), g, tile_g, cell)
        code = np.unique(np.concatenate([at_p, at_g]), axis=0, return_inverse=True)[1].ravel()
        code_p, code_g = code[: len(i)], code[len(i) :]
        order = np.argsort(code_g, kind="stable")
        held = np.bincount(code_g, minlength=int(code.max(initial=-1)) + 1)
        start = np.cumsum(held) - held
        for a, b in _spread(np.arange(len(i)), start[code_p], held[code_p]):
            left, right = i[a], j[order[b]]
            home = (np.floor(np.maximum(p[left, :2], g[right, :2]) / cell) == at_p[a, 1:]).all(axis=1)
            yield left[home], right[home]


def _ious(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """``box_iou`` of rows of boxes."""
    sides = np.maximum(0.0, np.minimum(p[:, 2:], g[:, 2:]) - np.maximum(p[:, :2], g[:, :2]))
    inter = sides[:, 0] * sides[:, 1]
    area = lambda b: np.maximum(0.0, b[:, 2] - b[:, 0]) * np.maximum(0.0, b[:, 3] - b[:, 1])
    union = area(p) + area(g) - inter
    return np.divide(inter, union, out=np.zeros(len(p)), where=union > 0)


def _solved(keys: Sequence[str], preds: pa.Table, gts: pa.Table, thresholds: Sequence[float]):
    """Both tables by tile and number, their tiles, and the (prediction, truth, IoU) rows taken at each threshold."""
    tile_p, tile_g = _tile_numbers(keys, preds, gts)
    by_p = np.lexsort((preds["p_pred_idx"].to_numpy(), tile_p))
    by_g = np.lexsort((gts["g_gt_idx"].to_numpy(), tile_g))
    preds, gts, tile_p, tile_g = preds.take(pa.array(by_p)), gts.take(pa.array(by_g)), tile_p[by_p], tile_g[by_g]
    p, g, lowest = _corners(preds, "p_"), _corners(gts, "g_"), min(thresholds)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for i, j in box_candidates(p, tile_p, g, tile_g, CELL_PX):
        iou = _ious(p[i], g[j])
        kept = (iou >= lowest) & (iou > 0)
        found.append((i[kept], j[kept], iou[kept]))
    i, j, iou = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((j, -iou, i))
    i, j, iou = i[order], j[order], iou[order]
    taken = []
    for t in thresholds:
        kept = np.flatnonzero(iou >= t)
        hit = kept[greedy(i[kept], j[kept])]
        taken.append((i[hit], j[hit], iou[hit]))
    return preds, gts, tile_p, tile_g, taken


def _matched(keys: Sequence[str], thresholds: Sequence[float]):
    """Boxes of many tiles to the pairs taken at each threshold."""

    def run(preds: pa.Table, gts: pa.Table) -> pa.Table:
        preds, gts, _, _, taken = _solved(keys, preds, gts, thresholds)
        out = []
        for t, (i, j, iou) in zip(thresholds, taken):
            rows = preds.select([*keys, "p_pred_idx", "p_conf"]).take(pa.array(i))
            out.append(pa.table([*[rows[k] for k in keys], pa.array(np.full(len(i), float(t))), rows["p_pred_idx"].cast(pa.int64()),
                                 gts["g_gt_idx"].take(pa.array(j)).cast(pa.int64()), rows["p_conf"], pa.array(iou)],
                                names=[*keys, "iou_threshold", "pred_idx", "gt_idx", "conf", "iou"]))
        return pa.concat_tables(out)

    return run


def _described(keys: Sequence[str], threshold: float):
    """Boxes of many tiles to one row per match, per prediction without and per truth without; a missing side is null."""

    def run(preds: pa.Table, gts: pa.Table) -> pa.Table:
        preds, gts, tile_p, tile_g, [(i, j, iou)] = _solved(keys, preds, gts, [threshold])
        count = np.bincount(tile_g[tile_g >= 0], minlength=int(tile_p.max(initial=0)) + 1)
        fp, fn = np.delete(np.arange(len(preds)), i), np.delete(np.arange(len(gts)), j)
        none = lambda n: np.full(len(n), -1, dtype=np.int64)
        of = lambda rows: pa.array(rows, mask=rows < 0)
        at_p, at_g = np.concatenate([i, fp, none(fn)]), np.concatenate([j, none(fp), fn])
        own, other = preds.take(of(at_p)), gts.take(of(at_g))
        tile = np.concatenate([tile_p[i], tile_p[fp], tile_g[fn]])
        truths = np.where(tile >= 0, count[tile], 0)
        return pa.table([
            *[pc.if_else(pa.array(at_p >= 0), own[k], other[k]) for k in keys], *[own[c] for c in own.column_names if c.startswith("p_")],
            *[other[c] for c in other.column_names if c.startswith("g_")], pa.array(np.concatenate([iou, np.zeros(len(fp) + len(fn))]), mask=(at_p < 0) | (at_g < 0)),
            pa.array(truths),
        ], names=[*keys, *[c for c in own.column_names if c.startswith("p_")], *[c for c in other.column_names if c.startswith("g_")], "iou", "_n"])

    return run


def _together(preds: DataFrame, gts: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()):
    """Both sides, whole tiles dealt to groups by their hash: about TOGETHER boxes a group. One shuffle of each side is all
    that matching moves; pairs are made inside a group and never written."""
    side = lambda df, s, own: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in (*own, *BOX, *[c for c in extra if c in df.columns])])
    p, g = side(preds, "p", ["pred_idx", "conf"]), side(gts, "g", ["gt_idx"])
    units = -(-(preds.count() + gts.count()) // TOGETHER) or 1
    unit = F.pmod(F.xxhash64(*keys), F.lit(units))
    return p, g, p.groupBy(unit).cogroup(g.groupBy(unit))


def match_many(preds: DataFrame, gts: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """J11 for several IoU thresholds at once: (keys, iou_threshold, pred_idx, gt_idx, conf, iou).

    Tiles are dealt to tasks by their hash; a task makes the pairs of all its tiles, at the lowest threshold, and
    matches them together, prediction by prediction in the order (prediction, higher IoU, lower truth).
    """
    keys = list(keys)
    p, _, both = _together(preds, gts, keys)
    kinds = dict(p.dtypes)
    layout = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "iou_threshold double, pred_idx bigint, gt_idx bigint", f"conf {kinds['p_conf']}", "iou double"])
    # Stored: what follows joins the matches several times.
    return cut_lineage(both.applyInArrow(_matched(keys, thresholds), layout))


def match(preds: DataFrame, gts: DataFrame, iou_threshold: float = 0.5, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Greedy one-to-one matches (keys, pred_idx, gt_idx, conf, iou); predictions are numbered best first."""
    return match_many(preds, gts, [iou_threshold], keys).drop("iou_threshold")


def numbered(preds: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """``pred_idx`` from 1, the most confident prediction of a tile first; ties by box."""
    return preds.withColumn("pred_idx", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("conf"), *BOX)))


def match_outcomes(preds: DataFrame, gts: DataFrame, matches: DataFrame,
                   keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One row per true positive, false positive, false negative."""
    keys = list(keys)
    tp = matches.select(*keys, F.lit("tp").alias("class"), "pred_idx", "gt_idx", "iou")
    fp = preds.join(matches, [*keys, "pred_idx"], "left_anti").select(
        *keys, F.lit("fp").alias("class"), "pred_idx", F.lit(None).cast("bigint").alias("gt_idx"),
        F.lit(None).cast("double").alias("iou"))
    fn = gts.join(matches, [*keys, "gt_idx"], "left_anti").select(
        *keys, F.lit("fn").alias("class"), F.lit(None).cast("bigint").alias("pred_idx"), "gt_idx",
        F.lit(None).cast("double").alias("iou"))
    return tp.unionByName(fp).unionByName(fn)


#: Measures that a side may bring along.
MEASURED = ("area_px", "cx", "cy", "aspect")


def _measures(columns: Sequence[str], prefix: str, side: str = "") -> list[Column]:
    c = lambda name: F.col(f"{side}{name}")
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    short, long = F.least(w, h), F.greatest(w, h)
    own = lambda name, d: c(name) if f"{side}{name}" in columns else d
    return [
        own("area_px", w * h).alias(f"{prefix}_area_px"),
        own("cx", (c("x1") + c("x2")) / 2).alias(f"{prefix}_centroid_x"),
        own("cy", (c("y1") + c("y2")) / 2).alias(f"{prefix}_centroid_y"),
        own("aspect", F.when(short > 0, long / short)).alias(f"{prefix}_aspect"),
    ]


def edge_distance(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """F04."""
    return F.least(cx, cy, w - cx, h - cy)


def _detection_columns(rows: DataFrame, keys: Sequence[str], width: float, height: float) -> DataFrame:
    """The columns of J23 from class, both sides' measures and ``_n``, the truths of the tile."""
    n = F.coalesce("_n", F.lit(0))
    at = lambda c: F.when(F.col("class") == "fp", F.col(f"pred_centroid_{c}")).otherwise(F.col(f"gt_centroid_{c}"))
    return rows.select(
        *keys, "class", "pred_idx", "gt_idx", "iou", "conf", "pred_area_px", "gt_area_px",
        "pred_centroid_x", "pred_centroid_y", "gt_centroid_x", "gt_centroid_y",
        edge_distance(at("x"), at("y"), F.lit(width), F.lit(height)).alias("distance_to_image_edge_px"),
        F.when(F.col("class") == "fp", n).otherwise(F.greatest(F.lit(0), n - 1)).alias("num_other_panels_in_tile"),
        "pred_aspect", "gt_aspect",
    )


def detection_rows(preds: DataFrame, gts: DataFrame, matches: DataFrame, width: float = 640.0,
                   height: float = 640.0, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """The per-detection table. Missing sides are null; positions come from the truth except for false positives."""
    keys = list(keys)
    p = preds.select(*keys, "pred_idx", "conf", *_measures(preds.columns, "pred"))
    g = gts.select(*keys, "gt_idx", *_measures(gts.columns, "gt"))
    taken = matches.select(*keys, "pred_idx", "gt_idx", "iou")
    # Predictions with their truth, if any; then the truths that none took.
    found = p.join(taken, [*keys, "pred_idx"], "left").join(g, [*keys, "gt_idx"], "left").withColumn(
        "class", F.when(F.col("gt_idx").isNotNull(), "tp").otherwise("fp"))
    missed = g.join(taken, [*keys, "gt_idx"], "left_anti").withColumn("class", F.lit("fn"))
    n_gt = gts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _detection_columns(found.unionByName(missed, allowMissingColumns=True).join(n_gt, keys, "left"), keys, width, height)


def matched_rows(preds: DataFrame, gts: DataFrame, iou_threshold: float = 0.5, width: float = 640.0, height: float = 640.0,
                 keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """J11 and J23 in one pass: the per-detection table of greedy matches, each side shuffled once and nothing joined."""
    keys = list(keys)
    p, g, both = _together(preds, gts, keys, MEASURED)
    layout = ", ".join([f"{c} {k}" for c, k in p.dtypes] + [f"{c} {k}" for c, k in g.dtypes if c not in keys] + ["iou double", "_n bigint"])
    rows = both.applyInArrow(_described(keys, iou_threshold), layout)
    kind = F.when(F.col("iou").isNotNull(), "tp").when(F.col("p_pred_idx").isNotNull(), "fp").otherwise("fn")
    return _detection_columns(rows.select(
        *keys, kind.alias("class"), F.col("p_pred_idx").alias("pred_idx"), F.col("g_gt_idx").cast("bigint").alias("gt_idx"), "iou",
        F.col("p_conf").alias("conf"), *_measures(p.columns, "pred", "p_"), *_measures(g.columns, "gt", "g_"), "_n"), keys, width, height)


def safe_ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, with ``empty`` (0 or null) when b is zero."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def precision_recall_f1(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1 from columns tp, fp, fn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", safe_ratio(2 * p * r, p + r))


def count_classes() -> list[Column]:
    return [F.count_if(F.col("class") == c).alias(c) for c in ("tp", "fp", "fn")]


def detection_metrics(rows: DataFrame) -> DataFrame:
    """A03 over a per-detection table."""
    return precision_recall_f1(rows.agg(*count_classes(), F.count_distinct("tile_id").alias("n_tiles")))


def with_buckets(rows: DataFrame) -> DataFrame:
    """Size, edge and density buckets."""
    area = F.coalesce("gt_area_px", "pred_area_px")
    edge, n = F.col("distance_to_image_edge_px"), F.col("num_other_panels_in_tile")
    unknown = lambda c, col: F.when(col.isNull() | F.isnan(col.cast("double")), "unknown")  # noqa: E731, ARG005
    return rows.withColumn(
        "size_bucket", unknown("a", area).when(area < 800, "small_lt800").when(area < 4000, "medium_800_4000")
        .otherwise("large_ge4000")
    ).withColumn(
        "edge_bucket", unknown("e", edge).when(edge < 40, "near_lt40").when(edge < 120, "mid_40_120")
        .otherwise("far_ge120")
    ).withColumn(
        "density_bucket", unknown("n", n).when(n == 0, "alone").when(n < 4, "few_1_3").otherwise("crowded_ge4"))


def failure_modes(rows: DataFrame) -> DataFrame:
    """Overall and per-bucket counts, miss rate, precision; one grouping-sets aggregation, pre-combined map side."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    sized = with_buckets(rows).select("class", "size_bucket", "edge_bucket", "density_bucket")
    dims = [F.col(c) for c in ("size_bucket", "edge_bucket", "density_bucket")]
    counts = sized.groupingSets([[], *[[d] for d in dims]], *dims).agg(*count_classes())
    kind = (F.when(F.col("size_bucket").isNotNull(), "size").when(F.col("edge_bucket").isNotNull(), "edge")
            .when(F.col("density_bucket").isNotNull(), "density").otherwise("overall"))
    return counts.select(
        kind.alias("dimension"), F.coalesce(*dims, F.lit("all")).alias("bucket"), "tp", "fp", "fn",
        safe_ratio(fn, tp + fn, None).alias("fn_rate"), safe_ratio(tp, tp + fp, None).alias("precision"))


def headline(modes: DataFrame) -> DataFrame:
    """How many times more often small arrays are missed than large ones; no row when undefined."""
    rate = lambda b: F.max(F.when((F.col("dimension") == "size") & (F.col("bucket") == b), F.col("fn_rate")))
    return modes.agg(rate("small_lt800").alias("small_fn_rate"), rate("large_ge4000").alias("large_fn_rate")).where(
        (F.col("large_fn_rate") > 0) & F.col("small_fn_rate").isNotNull()
    ).withColumn("ratio", F.col("small_fn_rate") / F.col("large_fn_rate"))


def worst_tiles(rows: DataFrame, top: int = 10) -> DataFrame:
    """Tiles with most misses and false alarms."""
    per_tile = rows.groupBy("tile_id").agg(
        *count_classes(), F.coalesce(F.avg(F.when(F.col("class") == "tp", F.col("iou"))), F.lit(0.0)).alias("mean_iou"))
    return per_tile.select(
        "tile_id", "fp", "fn", (F.col("fp") + F.col("fn") + F.col("tp")).alias("total"), "mean_iou"
    ).orderBy(F.desc(F.col("fp") + F.col("fn")), "tile_id").limit(top)


def confusion(rows: DataFrame) -> DataFrame:
    """Counts per tile and in total (tile_id null)."""
    return rows.rollup("tile_id").agg(*count_classes())


def threshold_sweep(preds: DataFrame, gts: DataFrame, confs: Sequence[float], ious: Sequence[float],
                    keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Counts and scores for every (confidence, IoU) combination.

    Greedy matching serves predictions best first, so dropping the weak ones never changes what the strong ones
    took: the matches at a confidence are the full matches restricted to it. Only one matching per IoU is run, and
    each confidence is a conditional count.
    """
    matched = match_many(preds, gts, ious, keys)
    over = lambda c: [F.count_if(F.col("conf") >= x).alias(f"{c}_{i}") for i, x in enumerate(confs)]
    tp = matched.groupBy("iou_threshold").agg(*over("t"))
    base = preds.agg(*over("p")).crossJoin(gts.agg(F.count(F.lit(1)).alias("_gt")))
    ious_df = preds.sparkSession.createDataFrame([(float(x),) for x in ious], "iou_threshold double")
    wide = ious_df.join(tp, "iou_threshold", "left").crossJoin(F.broadcast(base))
    combos = F.array(*[F.struct(
        F.lit(float(x)).alias("conf"), F.coalesce(f"t_{i}", F.lit(0)).alias("tp"), F.col(f"p_{i}").alias("np"))
        for i, x in enumerate(confs)])
    flat = wide.select("iou_threshold", "_gt", F.inline(combos))
    return precision_recall_f1(flat.select(
        "conf", F.col("iou_threshold").alias("iou"), "tp", (F.col("np") - F.col("tp")).alias("fp"),
        (F.col("_gt") - F.col("tp")).alias("fn")))


def best_row(sweep: DataFrame, metric: str, order: Sequence[str]) -> DataFrame:
    """The row with the highest metric, the first in ``order`` on ties."""
    return sweep.orderBy(F.desc(metric), *order).limit(1)


def average_precision(preds: DataFrame, gts: DataFrame, ious: Sequence[float],
                      keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Average precision per IoU threshold, area under the monotone precision envelope.

    Detections are first counted per distinct confidence; the running sums and the envelope work on those counts.
    """
    matched = match_many(preds, gts, ious, keys)
    every = preds.groupBy("conf").agg(F.count(F.lit(1)).alias("n")).crossJoin(
        F.broadcast(preds.sparkSession.createDataFrame([(float(x),) for x in ious], "iou_threshold double")))
    hits = matched.groupBy("iou_threshold", "conf").agg(F.count(F.lit(1)).alias("tp"))
    # One row per threshold and distinct confidence; written once because the two scans below each read it twice.
    points = cut_lineage(every.join(hits, ["iou_threshold", "conf"], "left").select(
        "iou_threshold", (-F.col("conf")).alias("weak"), "n", F.coalesce("tp", F.lit(0)).alias("tp")))
    run = cumulative(points, "weak", {"c_n": "n", "c_tp": "tp"}, ["iou_threshold"])
    total = gts.agg(F.count(F.lit(1)).alias("_gt"))
    curve = run.crossJoin(F.broadcast(total)).withColumn("precision", F.col("c_tp") / F.col("c_n"))
    # The envelope at a point is the best precision at this or any weaker confidence. Few distinct values of it
    # exist per recall step, so it is read off per hit count rather than with a whole-group window.
    steps = curve.groupBy("iou_threshold", "c_tp", "_gt").agg(
        F.max("precision").alias("precision"), F.max("tp").alias("tp"))
    back = cumulative_max(steps, ["iou_threshold"], "c_tp", "precision", "envelope")
    return back.groupBy("iou_threshold").agg(
        (F.sum(F.col("tp") * F.col("envelope")) / F.max("_gt")).alias("average_precision"))


def cumulative_max(df: DataFrame, part: Sequence[str], key: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Running maximum from the highest ``key`` down, in two levels (inside key ranges, then over range maxima)."""
    part = list(part)
    ranged = with_ranges(df, key, part, ranges or default_ranges(df))
    tops = ranged.groupBy(*part, "_range").agg(F.max(value).alias("_m"))
    above = W.partitionBy(*part).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    offsets = tops.select(*part, "_range", F.max("_m").over(above).alias("_above"))
    inside = W.partitionBy(*part, "_range").orderBy(F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(offsets, [*part, "_range"]).select(
        *df.columns, F.greatest(F.max(value).over(inside), F.col("_above")).alias(out))
