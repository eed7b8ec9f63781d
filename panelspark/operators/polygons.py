"""Dissolving real polygons: which rings overlap, sparse links between them, and the area they cover together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions import geo as G
from panelspark.operators.cells import BOX, assigned
from panelspark.operators.components import connected_components, numbered
from panelspark.session import cut_lineage

#: Rings in a cell up to which its area is swept at once, and how often a cell is cut in four before that.
FEW, DEEP = 32, 24
#: Fields of the sweep's table at a time; boxes in a window up to which they are laid on a grid.
SLABS, MANY = 1 << 20, 1000
#: Shapes in cells that one call of Python takes, about.
TOGETHER = 10_000


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether points lie in a ring, by even-odd count; for points off its outline."""
    p, q = ring, np.roll(ring, -1, axis=0)
    x, y = points[:, None, 0], points[:, None, 1]
    spans = (p[:, 1] > y) != (q[:, 1] > y)
    rise = np.where(q[:, 1] == p[:, 1], 1.0, q[:, 1] - p[:, 1])
    return (spans & (x < p[:, 0] + (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / rise)).sum(axis=1) % 2 == 1


def _enters(a: np.ndarray, b: np.ndarray, on: np.ndarray) -> bool:
    """Whether some part of a's outline runs inside b. ``on``: whether a vertex of b lies on an edge of a (edges, vertices);
    no edges cross otherwise."""
    p, q = a, np.roll(a, -1, axis=0)
    middles = []
    for i in range(len(a)):
        d = q[i] - p[i]
        length = d @ d
        if not length:
            continue
        t = (b[on[i]] - p[i]) @ d / length
        cut = np.unique(np.concatenate([[0.0, 1.0], t[(t > 0) & (t < 1)]]))
        middles.append(p[i] + d * ((cut[1:] + cut[:-1]) / 2)[:, None])
    return bool(middles) and bool(inside(np.concatenate(middles), b).any())


def rings_overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two simple rings (n x 2, open) share area or a piece of outline; a single shared point does not count."""
    if (a.min(axis=0) > b.max(axis=0)).any() or (b.min(axis=0) > a.max(axis=0)).any():
        return False
    p, q = a[:, None], np.roll(a, -1, axis=0)[:, None]
    r, s = b[None], np.roll(b, -1, axis=0)[None]
    o1, o2, o3, o4 = _cross(p, q, r), _cross(p, q, s), _cross(r, s, p), _cross(r, s, q)
    if ((o1 * o2 < 0) & (o3 * o4 < 0)).any():
        return True
    along = (o1 == 0) & (o2 == 0)
    if along.any():
        shared = np.minimum(np.maximum(p, q), np.maximum(r, s)) - np.maximum(np.minimum(p, q), np.minimum(r, s))
        if (along & (shared >= 0).all(axis=2) & (shared > 0).any(axis=2)).any():
            return True
    within = lambda v, lo, hi: ((v >= np.minimum(lo, hi)) & (v <= np.maximum(lo, hi))).all(axis=2)
    return _enters(a, b, (o1 == 0) & within(r, p, q)) or _enters(b, a, ((o3 == 0) & within(p, r, s)).T)


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def links(boxes: np.ndarray, joined: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs that join exactly the boxes (n x 4) that overlap or share a side, directly or over others: a star for each of
    their components, n - 1 pairs at most.

    A sweep from the left compares a box with those that reach its left side, and asks each component among them only
    until one of its members says yes. ``joined`` refines what overlaps (polygons in the boxes); without it a box that
    another one reaches around is left out of what follows, so a pile of near copies keeps few boxes in view.
    """
    forest, view = Forest(len(boxes)), np.zeros(0, dtype=np.int64)
    for i in np.argsort(boxes[:, 0], kind="stable").tolist():
        x0, y0, x1, y1 = boxes[i]
        seen = boxes[view]
        wide = np.minimum(seen[:, 2], x1) - x0
        high = np.minimum(seen[:, 3], y1) - np.maximum(seen[:, 1], y0)
        near = view[(wide >= 0) & (high >= 0) & ((wide > 0) | (high > 0))]
        if len(view) and (wide < 0).sum() * 2 > len(view):
            view = view[wide >= 0]
        for j in near.tolist():
            at = forest.root(j)
            if at != forest.root(i) and (joined is None or joined(i, j)):
                forest.up[forest.root(i)] = at
        if joined is None and len(near):
            own = boxes[near]
            if ((own[:, 1] <= y0) & (own[:, 3] >= y1) & (own[:, 2] >= x1)).any():
                continue
            view = view[~np.isin(view, near[(own[:, 1] >= y0) & (own[:, 3] <= y1) & (own[:, 2] <= x1)])]
        view = np.append(view, i)
    roots = [(forest.root(i), i) for i in range(len(boxes))]
    return [(a, b) for a, b in roots if a != b]


def _rings(column: pa.ChunkedArray) -> list[np.ndarray]:
    lists = column.combine_chunks()
    flat = lists.flatten()
    xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1).astype(np.float64)
    return np.split(xy, np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _by_cell(rows: pa.Table, at: Sequence[str]) -> list[pa.Table]:
    """The rows of each cell."""
    group = numbered(rows, at)
    order = np.argsort(group, kind="stable")
    rows, cuts = rows.take(pa.array(order)).combine_chunks(), np.flatnonzero(np.diff(group[order], prepend=-1))
    return [rows.slice(i, n) for i, n in zip(cuts.tolist(), np.diff(np.append(cuts, len(rows))).tolist())]


def _link_cells(key: str, polygons: bool):
    def run(rows: pa.Table) -> pa.Table:
        # A cell with one shape gives no link.
        group = numbered(rows, ["_level", "_cx", "_cy"])
        rows = rows.filter(pa.array(np.bincount(group)[group] > 1))
        a, b = [], []
        start = 0
        cells = _by_cell(rows, ["_level", "_cx", "_cy"]) if len(rows) else []
        for cell in cells:
            boxes = np.stack([cell[c].to_numpy() for c in BOX], axis=1)
            joined = None
            if polygons:
                lists = cell["ring"]
                known: dict[int, np.ndarray] = {}
                ring = lambda i: known[i] if i in known else known.setdefault(i, _rings(lists.slice(i, 1))[0])  # noqa: B023, E731
                joined = lambda i, j: rings_overlap(ring(i), ring(j))  # noqa: B023, E731
            for i, j in links(boxes, joined):
                a.append(start + i)
                b.append(start + j)
            start += len(cell)
        ids = pa.concat_arrays([c for cell in cells for c in cell[key].chunks]) if cells else rows[key].combine_chunks()
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return run


def _dealt(placed: DataFrame, at: Sequence[str]) -> DataFrame:
    """With ``_unit``: whole cells dealt to groups of about TOGETHER shapes by their hash; a group is one call of Python."""
    units = -(-placed.count() // TOGETHER) or 1
    return placed.withColumn("_unit", F.pmod(F.xxhash64(*at), F.lit(units)))


def overlap_links(shapes: DataFrame, key: str, cell: float, polygons: bool) -> DataFrame:
    """(a, b): links that join exactly the shapes that overlap or share a piece of outline, directly or over others.

    Boxes are those of minx … maxy; with ``polygons`` the ``ring`` decides. Every cell gives a forest of its own shapes,
    so links stay below the shapes' number in cells, however many of them lie on each other.
    """
    kind = dict(shapes.dtypes)[key]
    columns = [key, *BOX, *(["ring"] if polygons else [])]
    placed = _dealt(assigned(shapes.select(*columns), cell), ["_level", "_cx", "_cy"])
    # Stored: which of several possible forests a cell gives depends on the order of its rows.
    return cut_lineage(placed.groupBy("_unit").applyInArrow(_link_cells(key, polygons), f"a {kind}, b {kind}").distinct())


def dissolve_polygons(polygons: DataFrame, key: str = "array_id", cell: float = 200.0, min_area: float = 1.0) -> DataFrame:
    """(key, component, ring) of polygons larger than ``min_area``: those that share area or a piece of outline are one
    array, named by its smallest key. Equal rings count once; fewer than three points or no area: dropped."""
    ring = G.open_ring(F.col("ring"))
    sized = polygons.select(key, ring.alias("ring")).where((F.size("ring") >= 3) & (G.area(F.col("ring")) > min_area))
    minx, miny, maxx, maxy = G.bounds(F.col("ring"))
    heads = sized.groupBy("ring").agg(F.min(key).alias("_head")).select("ring", "_head", minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))
    found = connected_components(overlap_links(heads, "_head", cell, True)).withColumnRenamed("id", "_head")
    return sized.join(heads.select("ring", "_head"), "ring").join(found, "_head", "left").select(key, F.coalesce("component", "_head").alias("component"), "ring")


def dissolve(boxes: DataFrame, key: str = "array_id", cell: float = 200.0, min_area: float = 1.0) -> DataFrame:
    """A29 for boxes: (key, component, minx … maxy) after dropping boxes of at most ``min_area``. Equal boxes count once."""
    kept = boxes.where((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) > min_area)
    heads = kept.groupBy(*BOX).agg(F.min(key).alias("_head"))
    found = connected_components(overlap_links(heads, "_head", cell, False)).withColumnRenamed("id", "_head")
    return kept.join(heads, list(BOX)).join(found, "_head", "left").select(key, F.coalesce("component", "_head").alias("component"), *BOX)


def _swept(p: np.ndarray, q: np.ndarray, owner: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area that rings (edges p to q) cover together in a window. Between neighbouring breaks (vertices, crossings, where edges leave the
    window) outlines don't meet, so what is covered at the middle stands for the slab."""
    ends = np.flatnonzero(np.diff(owner)) + 1
    at = [p[:, 0]]
    dx, dy = q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]
    slope = np.divide(dx, dy, out=np.zeros_like(dx), where=dy != 0)
    for y in (y0, y1):
        at.append((p[:, 0] + (y - p[:, 1]) * slope)[(np.minimum(p[:, 1], q[:, 1]) < y) & (np.maximum(p[:, 1], q[:, 1]) > y)])
    det = dx[:, None] * dy[None] - dy[:, None] * dx[None]
    wx, wy = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
    safe = np.where(det == 0, 1.0, det)
    t, u = (wx * dy[None] - wy * dx[None]) / safe, (wx * dy[:, None] - wy * dx[:, None]) / safe
    hit = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    at.append((p[:, None, 0] + t * dx[:, None])[hit])
    breaks = np.concatenate(at)
    breaks = np.unique(np.concatenate([[x0, x1], breaks[(breaks > x0) & (breaks < x1)]]))
    total, step = 0.0, max(1, SLABS // len(p))
    for i in range(0, len(breaks) - 1, step):
        part = breaks[i : i + step + 1]
        x = ((part[1:] + part[:-1]) / 2)[:, None]
        crossed = (p[:, 0] > x) != (q[:, 0] > x)
        y = np.where(crossed, p[:, 1] + (x - p[:, 0]) / np.where(dx == 0, 1.0, dx) * dy, np.inf)
        # Of each ring's crossings in order, every two enclose a covered stretch.
        sides = [np.sort(own, axis=1) for own in np.split(y, ends, axis=1)]
        low = np.clip(np.concatenate([own[:, 0 : own.shape[1] // 2 * 2 : 2] for own in sides], axis=1), y0, y1)
        high = np.clip(np.concatenate([own[:, 1::2] for own in sides], axis=1), y0, y1)
        rank = np.argsort(low, axis=1, kind="stable")
        low, high = np.take_along_axis(low, rank, 1), np.maximum.accumulate(np.take_along_axis(high, rank, 1), axis=1)
        before = np.concatenate([np.full((len(x), 1), y0), high[:, :-1]], axis=1)
        total += float(np.maximum(0.0, high - np.maximum(low, before)).sum(axis=1) @ np.diff(part))
    return total


def covered(rings: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> float:
    """Area that rings cover together in a window. A window that one ring covers is done; one with many outlines in it is
    cut in four, so that only what lies along the outer outline of a pile is swept."""
    owner = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    return _covered(np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings]), owner, x0, y0, x1, y1, 0)


def _covered(p: np.ndarray, q: np.ndarray, owner: np.ndarray, x0: float, y0: float, x1: float, y1: float, depth: int) -> float:
    """``covered`` for the edges p to q of rings, which stand together."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    first, last, still_out = np.zeros(len(p)), np.ones(len(p)), np.zeros(len(p), dtype=bool)
    for axis, lo, hi in ((0, x0, x1), (1, y0, y1)):
        d = q[:, axis] - p[:, axis]
        still = d == 0
        step = np.where(still, 1.0, d)
        a, b = (lo - p[:, axis]) / step, (hi - p[:, axis]) / step
        still_out |= still & ((p[:, axis] <= lo) | (p[:, axis] >= hi))
        first = np.where(still, first, np.maximum(first, np.minimum(a, b)))
        last = np.where(still, last, np.minimum(last, np.maximum(a, b)))
    cuts = np.add.reduceat((last > first) & ~still_out, starts) > 0
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    # A ring whose outline stays outside covers the window if it covers its centre.
    rise = np.where(q[:, 1] == p[:, 1], 1.0, q[:, 1] - p[:, 1])
    ray = ((p[:, 1] > y) != (q[:, 1] > y)) & (x < p[:, 0] + (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / rise)
    if (~cuts & (np.add.reduceat(ray, starts, dtype=np.int64) % 2 == 1)).any():
        return (x1 - x0) * (y1 - y0)
    if not cuts.any():
        return 0.0
    kept = np.repeat(cuts, np.diff(np.append(starts, len(p))))
    p, q, owner = p[kept], q[kept], owner[kept]
    if cuts.sum() <= FEW or depth == DEEP:
        return _swept(p, q, owner, x0, y0, x1, y1)
    return sum(_covered(p, q, owner, *window, depth + 1) for window in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1)))


def covered_boxes(boxes: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area that boxes (n x 4) cover together in a window. Up to MANY are laid on the grid of their own sides, whose fields
    are counted by running sums; of more, the window is cut at the middle of its boxes' sides."""
    boxes = np.clip(boxes, [x0, y0, x0, y0], [x1, y1, x1, y1])
    boxes = boxes[(boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])]
    if not len(boxes):
        return 0.0
    if ((boxes == [x0, y0, x1, y1]).all(axis=1)).any():
        return (x1 - x0) * (y1 - y0)
    xs, ys = np.unique(boxes[:, [0, 2]]), np.unique(boxes[:, [1, 3]])
    if len(boxes) <= MANY:
        counts = np.zeros((len(xs), len(ys)), dtype=np.int32)
        left, right, low, high = (np.searchsorted(v, boxes[:, i]) for v, i in ((xs, 0), (xs, 2), (ys, 1), (ys, 3)))
        for i, j, step in ((left, low, 1), (right, high, 1), (left, high, -1), (right, low, -1)):
            np.add.at(counts, (i, j), step)
        open_ = counts.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
        return float(np.diff(xs) @ open_ @ np.diff(ys))
    if len(xs) >= len(ys):
        at = float(xs[len(xs) // 2])
        return covered_boxes(boxes, x0, y0, at, y1) + covered_boxes(boxes, at, y0, x1, y1)
    at = float(ys[len(ys) // 2])
    return covered_boxes(boxes, x0, y0, x1, at) + covered_boxes(boxes, x0, at, x1, y1)


def _convex_area(ring: np.ndarray) -> float | None:
    """The area of a ring of three or four points that turns one way only; of others none is given."""
    if len(ring) > 4:
        return None
    turns = _cross(np.roll(ring, 1, axis=0), ring, np.roll(ring, -1, axis=0))
    if not ((turns > 0).all() or (turns < 0).all()):
        return None
    x, y = (ring - ring[0]).T
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _cell_areas(keys: Sequence[str], cell: float, polygons: bool):
    def run(rows: pa.Table) -> pa.Table:
        areas, firsts = [], []
        for own in _by_cell(rows, [*keys, "_cx", "_cy"]):
            cx, cy = own["_cx"][0].as_py(), own["_cy"][0].as_py()
            window = (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
            if polygons:
                rings = _rings(own["ring"])
                alone = len(rings) == 1 and (rings[0] >= window[:2]).all() and (rings[0] <= window[2:]).all()
                area = _convex_area(rings[0]) if alone else None
                areas.append(covered(rings, *window) if area is None else area)
            else:
                areas.append(covered_boxes(np.stack([own[c].to_numpy() for c in BOX], axis=1), *window))
            firsts.append(own.select(list(keys)).slice(0, 1))
        return pa.concat_tables(firsts).append_column("area", pa.array(areas))

    return run


def _in_cells(shapes: DataFrame, keys: list[str], cell: float, polygons: bool) -> DataFrame:
    """Areas of shapes with a box, summed over the cells of each group."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    spread = shapes.distinct().withColumn("_cx", span("minx", "maxx")).withColumn("_cy", span("miny", "maxy"))
    kinds = dict(shapes.dtypes)
    areas = _dealt(spread, [*keys, "_cx", "_cy"]).groupBy("_unit").applyInArrow(
        _cell_areas(keys, cell, polygons), ", ".join([f"{k} {kinds[k]}" for k in keys] + ["area double"]))
    return areas.groupBy(*keys).agg(F.sum("area").alias("union_area"))


def polygon_union_area(polygons: DataFrame, keys: Sequence[str], cell: float = 200.0) -> DataFrame:
    """(keys, union_area): the area that the rings of each group cover together. Groups are cut at grid cells, so a large
    one is spread over many tasks."""
    box = [v.alias(c) for v, c in zip(G.bounds(F.col("ring")), BOX)]
    return _in_cells(polygons.select(*keys, "ring", *box), list(keys), cell, True)


def union_area(boxes: DataFrame, keys: Sequence[str], cell: float = 200.0) -> DataFrame:
    """(keys, union_area): the area that the boxes of each group cover together."""
    return _in_cells(boxes.select(*keys, *[F.col(c).cast("double").alias(c) for c in BOX]), list(keys), cell, False)


def turned(ring: Column) -> Column:
    """A ring turned by the angle whose sides are 3, 4 and 5, and scaled by 5: whole coordinates stay whole."""
    return F.transform(ring, lambda p: G.point(3 * p["x"] - 4 * p["y"], 4 * p["x"] + 3 * p["y"]))
