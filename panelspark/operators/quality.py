"""Dataset audits: label format, pairing, leakage, cleaning, strata, disagreement, triage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelspark.config import AuditRules
from panelspark.functions import geo as G
from panelspark.functions import names as N
from panelspark.operators.components import numbered
from panelspark.operators.detect import AT_ONCE, PAIRWISE, _spread, box_candidates
from panelspark.operators.scale import pick_at, value_positions
from panelspark.session import cut_lineage, dealt, stored


def _numbers(line: Column) -> Column:
    return F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.try_cast("double"))


def _axis(numbers: Column, odd: int) -> Column:
    """Every second number after the class: x values (odd=0) or y values (odd=1)."""
    return F.filter(F.slice(numbers, F.lit(2), F.size(numbers) - 1), lambda v, i: i % 2 == odd)


def with_numbers(lines: DataFrame, line: str = "line") -> DataFrame:
    """Tokens as numbers, and the x and y extents of a label line (null when it has a non-number)."""
    df = lines.withColumn("_n", _numbers(F.col(line)))
    clean = ~F.exists(F.slice("_n", F.lit(2), F.size("_n")), lambda v: v.isNull())
    w = F.array_max(_axis(F.col("_n"), 0)) - F.array_min(_axis(F.col("_n"), 0))
    h = F.array_max(_axis(F.col("_n"), 1)) - F.array_min(_axis(F.col("_n"), 1))
    return df.withColumn("_clean", clean).withColumn("_w", F.when(clean, w)).withColumn("_h", F.when(clean, h))


def line_size_px(lines: DataFrame, line: str = "line", tile: int = 640) -> DataFrame:
    """longest box side of a label line in pixels; 0 for lines with a non-number or under four numbers."""
    df = with_numbers(lines, line)
    ok = F.col("_clean") & (F.size("_n") >= 5)
    return df.withColumn("size_px", F.when(ok, F.greatest(F.col("_w"), F.col("_h")) * tile).otherwise(F.lit(0.0))).drop(
        "_n", "_clean", "_w", "_h")


def range_violations(lines: DataFrame, line: str = "line", large: float = 0.85) -> DataFrame:
    """Per line, the number of coordinates outside [0, 1] and whether the object is oversize."""
    df = with_numbers(lines, line).where((F.size("_n") >= 7) & F.col("_clean"))
    out = F.size(F.filter(F.slice("_n", F.lit(2), F.size("_n") - 1), lambda v: (v < 0) | (v > 1)))
    return df.select(*lines.columns, F.col("_w").alias("w"), F.col("_h").alias("h"), out.alias("n_violations"),
                     ((F.col("_w") > large) | (F.col("_h") > large)).alias("oversize"))


def clean_dataset(images: DataFrame, lines: DataFrame, min_brightness: float = 15.0, min_px: float = 16.0) -> DataFrame:
    """One status per tile, first rule wins: dark, unlabeled, all tiny, pruned, kept.

    ``images`` is (split, stem, brightness), ``lines`` is (split, stem, line).
    """
    sized = line_size_px(lines.where(F.trim("line") != ""))
    per_tile = sized.groupBy("split", "stem").agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(F.col("size_px") >= min_px).alias("_large"))
    joined = images.join(per_tile, ["split", "stem"], "left")
    status = (
        F.when(F.col("brightness") < min_brightness, "removed_dark").when(F.col("_lines").isNull(), "removed_no_label")
        .when(F.col("_large") == 0, "removed_all_tiny").when(F.col("_large") < F.col("_lines"), "pruned").otherwise("kept"))
    return joined.select("split", "stem", status.alias("status"))


def cleaning_counts(statuses: DataFrame) -> DataFrame:
    """Counts per split; a pruned tile is also a kept one."""
    is_ = lambda *v: F.count_if(F.col("status").isin(*v))
    return statuses.groupBy("split").agg(
        F.count(F.lit(1)).alias("total"), is_("removed_dark").alias("removed_dark"), is_("removed_no_label").alias("removed_no_label"),
        is_("removed_all_tiny").alias("removed_all_tiny"), is_("pruned").alias("pruned_labels"), is_("kept", "pruned").alias("kept"))


def pair_files(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Paired, missing label, orphan label; one full outer join on (split, stem)."""
    i = images.select("split", "stem").distinct().withColumn("_i", F.lit(True))
    la = labels.select("split", "stem").distinct().withColumn("_l", F.lit(True))
    status = F.when(F.col("_i").isNull(), "orphan_label").when(F.col("_l").isNull(), "missing_label").otherwise("paired")
    return i.join(la, ["split", "stem"], "full_outer").select("split", "stem", status.alias("status"))


def split_leakage(images: DataFrame) -> DataFrame:
    """How many stems each pair of splits shares. One pass: a stem carries at most as many splits as exist."""
    sets = images.groupBy("stem").agg(F.array_sort(F.collect_set("split")).alias("_s")).where(F.size("_s") > 1)
    pairs = sets.select(F.explode("_s").alias("a"), "_s").select("a", F.explode("_s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))


def line_issues(lines: DataFrame) -> DataFrame:
    """Format verdict per label line: issue name or null, class, and whether the line counts as an object."""
    df = lines.where(F.trim("line") != "").withColumn("_n", _numbers(F.col("line")))
    size = F.size("_n")
    bad = F.exists("_n", lambda v: v.isNull())
    outside = F.exists(F.slice("_n", F.lit(2), size - 1), lambda v: (v < 0) | (v > 1))
    fatal = F.when(size < 7, "too_few_tokens").when(bad, "non_numeric").when((size - 1) % 2 != 0, "odd_coordinates")
    return df.select(
        *lines.columns, F.coalesce(fatal, F.when(outside, "outside_range")).alias("issue"), fatal.isNull().alias("counts"),
        F.when(fatal.isNull(), F.get("_n", 0).cast("int")).alias("class_id"))


def audit(images: DataFrame, labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Per split: images, labels, objects, empty labels and ratio, missing, orphans, format issues."""
    verdicts = line_issues(lines)
    per_label = verdicts.groupBy("split", "stem").agg(
        F.count_if("counts").alias("_objects"), F.count("issue").alias("_issues"))
    files = labels.select("split", "stem").distinct().join(per_label, ["split", "stem"], "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(F.coalesce("_objects", F.lit(0))).alias("objects"),
        F.count_if(F.coalesce("_objects", F.lit(0)) == 0).alias("empty_labels"),
        F.sum(F.coalesce("_issues", F.lit(0))).alias("format_issues"))
    pairs = pair_files(images, labels).groupBy("split").agg(
        F.count_if(F.col("status") != "orphan_label").alias("images"),
        F.count_if(F.col("status") == "missing_label").alias("missing_labels"),
        F.count_if(F.col("status") == "orphan_label").alias("orphan_labels"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ratio = F.when(F.col("labels") > 0, F.col("empty_labels") / F.col("labels")).otherwise(F.lit(0.0))
    return pairs.join(files, "split", "left").select(
        "split", "images", zero("labels"), zero("objects"), zero("empty_labels"), ratio.alias("empty_label_ratio"),
        "missing_labels", "orphan_labels", zero("format_issues"))


def class_counts(lines: DataFrame) -> DataFrame:
    """Objects per split and class."""
    return line_issues(lines).where("counts").groupBy("split", "class_id").agg(F.count(F.lit(1)).alias("objects"))


def audit_warnings(report: DataFrame, leakage: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """One row per broken rule. Works on the per-split report (a handful of rows)."""
    minimum = F.lit(0)
    for split, n in rules.min_images.items():
        minimum = F.when(F.col("split") == split, F.lit(n)).otherwise(minimum)
    hits = F.array_compact(F.array(
        F.when(F.col("images") < minimum, F.lit("too_few_images")),
        F.when(F.col("empty_label_ratio") > rules.max_empty_label_ratio, F.lit("too_many_empty_labels")),
        F.when(F.col("missing_labels") > 0, F.lit("missing_labels")),
        F.when(F.col("orphan_labels") > 0, F.lit("orphan_labels")),
        F.when(F.col("format_issues") > 0, F.lit("format_issues"))))
    per_split = report.select(F.col("split").alias("scope"), F.explode(hits).alias("warning"))
    leaks = leakage.where("overlap > 0").select(F.concat_ws("/", "a", "b").alias("scope"), F.lit("split_leakage").alias("warning"))
    balance = report.agg(F.count_if(F.col("objects") > 0).alias("_n")).where("_n < 2").select(
        F.lit("all").alias("scope"), F.lit("class_balance").alias("warning"))
    return per_split.unionByName(leaks).unionByName(balance)


def audit_status(warnings: DataFrame) -> DataFrame:
    return warnings.agg(F.count(F.lit(1)).alias("n_warnings")).withColumn(
        "status", F.when(F.col("n_warnings") > 0, "warning").otherwise("ok"))


def size_stats(lines: DataFrame) -> DataFrame:
    """Per split: objects, median and index-based p95 of width and height, violations, oversize objects."""
    # Lines are parsed once; everything else reads the counts of the distinct sizes.
    sizes = cut_lineage(range_violations(lines).groupBy("split", "w", "h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_violations").alias("violations"), F.count_if("oversize").alias("large")))
    base = sizes.groupBy("split").agg(
        F.sum("n").alias("total_objects"), F.sum("violations").alias("violations"), F.sum("large").alias("large_objects"))
    # Both axes and both picks come from one placement of the distinct sizes.
    long = sizes.select("split", "n", "w", "h").unpivot(["split", "n"], ["w", "h"], "axis", "size")
    placed = value_positions(long, "size", ["split", "axis"], "n").drop("n")
    middle = F.lit(0.5) * (F.col("total") - 1)
    tail = F.least(F.floor(F.lit(0.95) * F.col("total")), F.col("total") - 1)
    picks = placed.groupBy("split", "axis").agg(
        ((pick_at("size", F.floor(middle)) + pick_at("size", F.ceil(middle))) / 2).alias("median"), pick_at("size", tail).alias("p95"))
    of = lambda c, axis: F.max(F.when(F.col("axis") == axis, F.col(c))).alias(f"{c}_{axis}")
    wide = picks.groupBy("split").agg(*[of(c, axis) for axis in ("w", "h") for c in ("median", "p95")])
    return base.join(wide, "split", "left")


def canonical_join(names: DataFrame, index: DataFrame, name: str = "name", how: str = "left") -> DataFrame:
    """Raw tile names to the tile index by canonical name."""
    return names.withColumn("tile_name", N.canonical_tile(F.col(name))).join(index, "tile_name", how)


def strata(tiles: DataFrame, index: DataFrame) -> DataFrame:
    """(split, region, vintage) shares; ``tiles`` is (split, name, objects), ``index`` is (tile_name, source)."""
    known = index.select("tile_name", "source", F.lit(True).alias("_known"))
    joined = canonical_join(tiles, known)
    hit = F.col("_known").isNotNull()
    counts = joined.groupBy(
        "split", F.coalesce(N.region(F.col("source")), F.lit("unknown")).alias("region"), N.vintage(F.col("source")).alias("vintage"),
    ).agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum(F.when(hit, F.col("objects"))), F.lit(0)).alias("objects"),
          F.count_if(~hit).alias("unmatched"))
    total = F.sum("tiles").over(W.partitionBy("split"))
    return counts.select("*", (100 * F.col("tiles") / total).alias("tile_pct_of_split"),
                         (F.col("objects") / F.col("tiles")).alias("objs_per_tile"))


def tile_index_errors(index: DataFrame) -> DataFrame:
    """Rule names a tile-index row breaks; an unusual CRS is a warning in the list, too."""
    return index.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("transform").isNull() | F.col("crs").isNull() | F.col("width").isNull() | F.col("height").isNull(), F.lit("missing_key")),
        F.when(F.size("transform") != 6, F.lit("bad_transform")),
        F.when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit("bad_size")),
        F.when(~F.col("crs").contains(":"), F.lit("unusual_crs")))))


def merge_tile_indices(parts: Sequence[DataFrame], last_wins: bool = False) -> DataFrame:
    """Union of tile indices; a repeated name raises unless the later source may win."""
    merged = None
    for i, part in enumerate(parts):
        numbered = part.withColumn("_src", F.lit(i))
        merged = numbered if merged is None else merged.unionByName(numbered, allowMissingColumns=True)
    if not last_wins:
        again = merged.groupBy("tile_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
        if again:
            raise ValueError(f"duplicate tile names across indices: {[r['tile_name'] for r in again]}")
        return merged.drop("_src")
    values = [c for c in merged.columns if c not in ("tile_name", "_src")]
    return merged.groupBy("tile_name").agg(F.max_by(F.struct(*values), "_src").alias("_v")).select("tile_name", "_v.*")


def split_manifest(tiles: DataFrame) -> DataFrame:
    """Tiles per split and in total (split null)."""
    return tiles.rollup("split").agg(F.count(F.lit(1)).alias("tiles"))


def triage(tiles: DataFrame, preds: DataFrame, accept: float = 0.75) -> DataFrame:
    """Skip, auto_accept or review per tile, with prediction count, mean and maximum confidence."""
    per = preds.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("conf").alias("mean_conf"), F.max("conf").alias("max_conf"),
        F.min("conf").alias("_least"))
    action = F.when(F.col("_n").isNull(), "skip").when(F.col("_least") >= accept, "auto_accept").otherwise("review")
    return tiles.join(per, "tile_id", "left").select(
        "tile_id", F.coalesce("_n", F.lit(0)).alias("n_predictions"), "mean_conf", "max_conf", action.alias("recommended_action"))


def mask_blocks(ring: Column) -> Column:
    """Pixels of a filled polygon (those whose centre is inside) as an array of blocks (y0, y1, x0, x1), half open.

    A block covers all image rows in which the same upright sides lie left and right, so a box is one block whatever its
    height; where a slanted side is cut each image row has blocks of its own.
    """
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    sides = F.filter(F.zip_with(ring, nxt, lambda p, q: F.struct(
        F.least(p["y"], q["y"]).alias("lo"), F.greatest(p["y"], q["y"]).alias("hi"),
        F.when(p["y"] < q["y"], p["x"]).otherwise(q["x"]).alias("x"), F.try_divide(q["x"] - p["x"], q["y"] - p["y"]).alias("slope"))),
        lambda e: e["hi"] > e["lo"])
    # Between neighbouring breaks the image rows cut the same sides.
    breaks = F.array_sort(F.array_distinct(F.transform(ring, lambda p: F.ceil(p["y"] - 0.5))))

    def blocks(e: Column) -> Column:
        level = lambda y: y + 0.5
        cut = lambda y: F.filter(e["sides"], lambda s: (s["lo"] <= level(y)) & (level(y) < s["hi"]))
        strip = lambda y0, y1: F.struct(y0.alias("y0"), y1.alias("y1"))
        bands = F.zip_with(F.slice(e["breaks"], F.lit(1), F.size(e["breaks"]) - 1), F.slice(e["breaks"], 2, F.size(e["breaks"])), strip)
        strips = F.flatten(F.transform(bands, lambda b: F.when(F.forall(cut(b["y0"]), lambda s: s["slope"] == 0), F.array(b)).otherwise(
            F.transform(F.sequence(b["y0"], b["y1"] - 1), lambda y: strip(y, y + 1)))))
        # An even number of cuts, sorted: inside between the 1st and 2nd, 3rd and 4th, …
        cuts = F.transform(strips, lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), F.sort_array(
            F.transform(cut(b["y0"]), lambda s: s["x"] + (level(b["y0"]) - s["lo"]) * s["slope"])).alias("at")))
        return F.flatten(F.transform(F.filter(cuts, lambda c: F.size(c["at"]) >= 2), lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c["at"]) - 2, F.lit(2)), lambda i: F.struct(
                c["y0"].alias("y0"), c["y1"].alias("y1"), F.ceil(F.get(c["at"], i) - 0.5).alias("x0"), F.ceil(F.get(c["at"], i + 1) - 0.5).alias("x1")))))

    # Wrapping in a one-element array binds sides and breaks once per polygon instead of once per use.
    bound = F.transform(F.array(F.struct(sides.alias("sides"), breaks.alias("breaks"))), blocks)
    held = lambda r: (r["x1"] > r["x0"]) & (r["y1"] > r["y0"])
    # A box needs no sweep over its sides.
    x, y = _corners(ring)
    first, last = (lambda c: F.ceil(F.least(c[0], c[2]) - 0.5)), (lambda c: F.ceil(F.greatest(c[0], c[2]) - 0.5))
    box = F.struct(first(y).alias("y0"), last(y).alias("y1"), first(x).alias("x0"), last(x).alias("x1"))
    empty = (first(x) >= last(x)) | (first(y) >= last(y))
    return F.when(_is_box(ring), F.when(empty, F.slice(F.array(box), 1, 0)).otherwise(F.array(box))).when(F.size(ring) > 0, F.filter(F.get(bound, 0), held))


def _corners(ring: Column) -> tuple[list[Column], list[Column]]:
    return tuple([F.get(ring, i)[axis] for i in range(4)] for axis in ("x", "y"))


def _is_box(ring: Column) -> Column:
    x, y = _corners(ring)
    upright = lambda u, v: (u[0] == u[1]) & (u[2] == u[3]) & (v[1] == v[2]) & (v[3] == v[0])
    return (F.size(ring) == 4) & (upright(x, y) | upright(y, x))


def most_blocks(ring: Column) -> Column:
    """How many blocks ``mask_blocks`` gives at most, 1 at least: two sides bound a block of an image row."""
    level = lambda pick: pick(F.transform(ring, lambda p: F.ceil(p["y"] - 0.5)))
    tall = (level(F.array_max) - level(F.array_min)) * F.ceil(F.size(ring) / 2)
    return F.greatest(F.lit(1).cast("long"), F.when(F.size(ring) > 0, F.when(_is_box(ring), F.lit(1).cast("long")).otherwise(tall)))


def mask_runs(polygons: DataFrame, keys: Sequence[str], ring: str = "ring") -> DataFrame:
    """Pixel runs (keys, y, x0, x1) of filled polygons: half-open x ranges, one or more for each image row."""
    blocks = polygons.select(*keys, F.inline(mask_blocks(F.col(ring))))
    return blocks.select(*keys, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")


#: Side, in pixels, of the cells of a tile in which blocks meet.
CELL = 128


def block_pairs(blocks: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, a, b, shared): pixels that two shapes of a ``key`` share, ``a`` the smaller; pairs without any are left out.

    ``blocks`` is (key, shape, y0, y1, x0, x1), the blocks of a shape apart from each other. They meet in cells, and two
    blocks count in the cell with the first corner of what they share.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / CELL), F.floor((F.col(hi) - 1) / CELL))
    cut = blocks.where("x0 < x1 AND y0 < y1").withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))
    other = cut.select(key, "_cx", "_cy", F.col(shape).alias("b"), *[F.col(c).alias(f"_{c}") for c in ("y0", "y1", "x0", "x1")])
    both = cut.withColumnRenamed(shape, "a").join(other, [key, "_cx", "_cy"]).where("a < b")
    x, y = F.greatest("x0", "_x0"), F.greatest("y0", "_y0")
    w, h = F.least("x1", "_x1") - x, F.least("y1", "_y1") - y
    both = both.where((w > 0) & (h > 0) & (F.floor(x / CELL) == F.col("_cx")) & (F.floor(y / CELL) == F.col("_cy")))
    return both.groupBy(key, "a", "b").agg(F.sum(w * h).alias("shared"))


def mask_sums(runs: DataFrame, key: str, side: str, height: str | None = None) -> DataFrame:
    """(key, left, both, either): pixels under the runs whose ``side`` is true, under runs of both sides, under any.

    An ordered sweep of run starts and ends along each image row keeps two running counts of open runs; between
    neighbouring ends they don't change. Linear in the runs, one shuffle. With ``height`` a run stands for so many rows.
    """
    rows = F.lit(1) if height is None else F.col(height)
    ends = runs.select(key, "y", side, rows.alias("_rows"), F.inline(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("step")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("step")))))
    row = W.partitionBy(key, "y").orderBy("x")
    upto = row.rowsBetween(W.unboundedPreceding, 0)
    opened = lambda own: F.sum(F.when(own, F.col("step")).otherwise(F.lit(0))).over(upto)
    swept = ends.select(key, ((F.lead("x").over(row) - F.col("x")) * F.col("_rows")).alias("w"), opened(F.col(side)).alias("l"), opened(~F.col(side)).alias("p")).where("w > 0")
    under = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    l, p = F.col("l") > 0, F.col("p") > 0
    return swept.groupBy(key).agg(under(l).alias("left"), under(l & p).alias("both"), under(l | p).alias("either"))


def block_sums(blocks: DataFrame, key: str, side: str) -> DataFrame:
    """``mask_sums`` of blocks, cut at all block starts and ends of their ``key``: never more pieces than image rows."""
    at = blocks.select(key, F.explode(F.array("y0", "y1")).alias("at")).groupBy(key).agg(F.array_sort(F.collect_set("at")).alias("_at"))
    bands = F.arrays_zip(F.slice("_at", F.lit(1), F.size("_at") - 1).alias("y"), F.slice("_at", 2, F.size("_at")).alias("end"))
    inside = F.filter(bands, lambda b: (b["y"] >= F.col("y0")) & (b["end"] <= F.col("y1")))
    cut = blocks.join(at, key).select(key, side, "x0", "x1", F.inline(inside)).withColumn("_h", F.col("end") - F.col("y"))
    return mask_sums(cut, key, side, "_h")


#: Blocks of a tile up to which it is compared in one task, together with others.
LARGE = 5_000


def _meeting(boxes: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of boxes (n x 4; groups ascending) of the same group that may overlap, each pair once, the smaller row first."""
    count = np.bincount(group)
    end = np.cumsum(count)
    crowded = (count * count > PAIRWISE)[group]
    few = np.flatnonzero(~crowded)
    yield from _spread(few, few + 1, end[group[few]] - few - 1)
    many = np.flatnonzero(crowded)
    if len(many):
        own = np.unique(group[many], return_inverse=True)[1]
        for i, j in box_candidates(boxes[many], own, boxes[many], own, float(CELL)):
            once = i < j
            yield many[i[once]], many[j[once]]


def _shared_pixels(shape: np.ndarray, group: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared): shapes of the same group that share pixels, a < b, from their blocks."""
    n = int(shape.max(initial=-1)) + 1
    codes, pixels = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, j in _meeting(np.stack([x0, y0, x1, y1], axis=1).astype(float), group):
        w, h = np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j]), np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j])
        met = (w > 0) & (h > 0) & (shape[i] != shape[j])
        a, b = shape[i[met]], shape[j[met]]
        code, own = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        shared = np.zeros(len(code), dtype=np.int64)
        np.add.at(shared, own, w[met] * h[met])
        codes.append(code)
        pixels.append(shared)
    code, own = np.unique(np.concatenate(codes), return_inverse=True)
    shared = np.zeros(len(code), dtype=np.int64)
    np.add.at(shared, own, np.concatenate(pixels))
    return code // max(n, 1), code % max(n, 1), shared


def _swept(group: np.ndarray, label: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``block_sums`` of blocks in n groups: pixels of each group under blocks of both sides and under any."""
    levels, rank = np.unique(np.concatenate([y0, y1]), return_inverse=True)
    at, place = np.unique(np.tile(group, 2) * len(levels) + rank, return_inverse=True)
    low, high = place[: len(y0)], place[len(y0) :]
    level, owner = levels[at % max(len(levels), 1)], at // max(len(levels), 1)
    both, either = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    held = np.cumsum(np.bincount(low, minlength=len(at)) - np.bincount(high, minlength=len(at)))
    cuts = np.searchsorted(np.cumsum(held), np.arange(AT_ONCE, held.sum() + 1, AT_ONCE)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(at)]):
        rows = np.flatnonzero((low < stop) & (high > start))
        first, many = np.maximum(low[rows], start), np.minimum(high[rows], stop) - np.maximum(low[rows], start)
        band = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
        row = np.repeat(rows, many)
        band, side, x = np.tile(band, 2), np.tile(label[row], 2), np.concatenate([x0[row], x1[row]])
        step = np.repeat([1, -1], len(row))
        order = np.lexsort((x, band))
        band, side, x, step = band[order], side[order], x[order], step[order]
        # What is open is closed at the end of a band, so counts run on.
        l, p = np.cumsum(np.where(side, step, 0))[:-1] > 0, np.cumsum(np.where(side, 0, step))[:-1] > 0
        here = np.flatnonzero((band[1:] == band[:-1]) & (l | p))
        size = (x[here + 1] - x[here]) * (level[band[here] + 1] - level[band[here]])
        np.add.at(either, owner[band[here]], size)
        np.add.at(both, owner[band[here]], size * (l & p)[here])
    return both, either


def _compared(tile: str, high_conf: float, min_iou: float):
    """Shapes of whole tiles to the counts of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        group = numbered(rows, [tile])
        order = np.argsort(group, kind="stable")
        rows, group = rows.take(pa.array(order)), group[order]
        head, n = np.unique(group, return_index=True)[1], int(group[-1]) + 1
        label, lists = rows["_label"].to_numpy(), rows["_blocks"].combine_chunks()
        conf, known = pc.fill_null(rows["_conf"], 0.0).to_numpy(), rows["_conf"].is_valid().to_numpy()
        shape = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        blocks = lists.flatten()
        y0, y1, x0, x1 = (blocks.field(c).to_numpy() for c in ("y0", "y1", "x0", "x1"))
        area, best = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
        np.add.at(area, shape, (y1 - y0) * (x1 - x0))
        a, b, shared = _shared_pixels(shape, group[shape], y0, y1, x0, x1)
        cross = label[a] != label[b]
        iou = shared[cross] / (area[a] + area[b] - shared)[cross]
        np.maximum.at(best, a[cross], iou)
        np.maximum.at(best, b[cross], iou)

        def total(values: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = np.zeros(n, dtype=np.int64)
            np.add.at(out, of, values)
            return out

        both = total(shared[cross], group[a[cross]])
        either = total(area, group) - both
        # Two shapes of one side that share pixels make the sums of their tile more than areas.
        piled = np.zeros(n, dtype=bool)
        piled[group[a[~cross]]] = True
        if piled.any():
            of = np.flatnonzero(piled[group[shape]])
            swept = _swept(group[shape[of]], label[shape[of]], y0[of], y1[of], x0[of], x1[of], n)
            both, either = np.where(piled, swept[0], both), np.where(piled, swept[1], either)
        count = lambda which: np.bincount(group[which], minlength=n)
        given = ~label & known
        highest = np.full(n, -np.inf)
        np.maximum.at(highest, group[given], conf[given])
        # As in Spark, NaN is above all numbers.
        sure = given & ~(conf < high_conf)
        yield pa.RecordBatch.from_arrays([
            rows[tile].take(pa.array(head)).combine_chunks(), pa.array(count(label)), pa.array(count(label & (best < min_iou))), pa.array(count(~label)),
            pa.array(highest, mask=count(given) == 0), pa.array(count(sure & (best == 0))), pa.array(total(area[label], group[label])), pa.array(both), pa.array(either),
        ], names=[tile, "n_label_polys", "label_polys_uncovered", "n_pred", "max_pred_conf", "confident_fps", "_left", "_both", "_either"])

    return run


def label_disagreement(labels: DataFrame, preds: DataFrame, high_conf: float = 0.5, min_iou: float = 0.3,
                       agree_iou: float = 0.5, tile: str = "tile_id") -> DataFrame:
    """J21 + A27: per tile, labels no prediction covers, confident predictions that touch no label, the overall mask
    IoU, and the bucket they imply. ``labels`` is (tile, gt_idx, ring), ``preds`` is (tile, pred_idx, conf, ring).

    Whole tiles are dealt to tasks of about ROWS_A_TASK blocks, which is all that is shuffled. A tile of over LARGE
    blocks, and shapes without a tile, go through joins instead, over as many tasks as they need.
    """
    def own(df: DataFrame, index: str, is_label: bool, conf: Column) -> DataFrame:
        return df.select(F.col(tile), F.lit(is_label).alias("_label"), F.col(index).cast("long").alias("_i"), conf.alias("_conf"), F.col("ring").alias("_ring"))

    shapes = own(labels, "gt_idx", True, F.lit(None).cast("double")).unionByName(own(preds, "pred_idx", False, F.col("conf").cast("double")))
    sizes = shapes.groupBy(tile).agg(F.sum(most_blocks(F.col("_ring"))).alias("_n"))
    shapes = shapes.withColumn("_blocks", mask_blocks(F.col("_ring"))).drop("_ring")
    apart = F.col(tile).isNull() | (F.col("_n") > LARGE)
    seen = sizes.agg(F.sum("_n").alias("n"), F.coalesce(F.bool_or(apart), F.lit(False)).alias("apart")).first()
    large = stored(sizes.where(apart).select(tile)) if seen["apart"] else None
    few = shapes if large is None else shapes.where(F.col(tile).isNotNull()).join(large, tile, "left_anti")
    kind = dict(shapes.dtypes)[tile]
    layout = f"{tile} {kind}, n_label_polys bigint, label_polys_uncovered bigint, n_pred bigint, max_pred_conf double, confident_fps bigint, _left bigint, _both bigint, _either bigint"
    per_tile = dealt(few.select(tile, "_label", "_conf", "_blocks"), seen["n"] or 0, tile).mapInArrow(_compared(tile, high_conf, min_iou), layout)
    if large is not None:
        crowd = shapes.join(large, shapes[tile].eqNullSafe(large[tile]), "left_semi")
        per_tile = per_tile.unionByName(_compared_by_joins(crowd, high_conf, min_iou, tile))
    out = per_tile.select(
        tile, F.when(F.col("_either") > 0, F.col("_both") / F.col("_either")).otherwise(F.lit(0.0)).alias("overall_iou"),
        "n_label_polys", "n_pred", "confident_fps", "label_polys_uncovered", F.coalesce("max_pred_conf", F.lit(0.0)).alias("max_pred_conf"),
        (F.col("_left") > 0).alias("_label"))
    fps, miss = F.col("confident_fps"), F.col("label_polys_uncovered")
    bucket = (
        F.when((F.col("overall_iou") >= agree_iou) & (fps == 0) & (miss == 0), "agree")
        .when((fps > 0) & (miss == 0) & ~F.col("_label"), "confident_FP").when((miss > 0) & (fps == 0), "confident_FN")
        .when((fps > 0) & (miss > 0), "both_directions").when((fps > 0) & F.col("_label"), "confident_FP").otherwise("noisy"))
    return out.withColumn("bucket", bucket).withColumn("disagreement_score", fps + miss).drop("_label")


def _compared_by_joins(shapes: DataFrame, high_conf: float, min_iou: float, tile: str) -> DataFrame:
    """The counts of each tile without a tile in a task: blocks meet in cells by joins."""
    # Rasterised once; pairs, areas and sums read what is stored.
    shapes = stored(shapes.select(tile, F.struct(F.col("_label").alias("label"), F.col("_i").alias("i")).alias("_s"), "_conf", "_blocks", F.aggregate(
        "_blocks", F.lit(0).cast("long"), lambda n, b: n + (b["y1"] - b["y0"]) * (b["x1"] - b["x0"])).alias("_area")))
    blocks = shapes.select(tile, "_s", "_area", F.inline("_blocks"))
    met = block_pairs(blocks.withColumn("_s", F.struct("_s", "_area")).drop("_area"), tile, "_s")
    # A prediction comes before a label. Two shapes of one side that share pixels make the sums of their tile more than areas.
    same = F.col("a._s.label") == F.col("b._s.label")
    iou = F.when(~same, F.col("shared") / (F.col("a._area") + F.col("b._area") - F.col("shared")))
    per_shape = met.select(tile, F.inline(F.array(
        F.struct(F.col("a._s").alias("_s"), iou.alias("_iou"), F.lit(None).cast("long").alias("_shared"), same.alias("_same")),
        F.struct(F.col("b._s").alias("_s"), iou.alias("_iou"), F.when(~same, F.col("shared")).alias("_shared"), same.alias("_same"))))).groupBy(tile, "_s").agg(
        F.max("_iou").alias("best"), F.sum("_shared").alias("_shared"), F.max("_same").alias("_same"))
    is_label = F.col("_s.label")
    per_tile = stored(shapes.select(tile, "_s", "_conf", "_area").join(per_shape, [tile, "_s"], "left").groupBy(tile).agg(
        F.count_if(is_label).alias("n_label_polys"), F.count_if(is_label & (F.coalesce("best", F.lit(0.0)) < min_iou)).alias("label_polys_uncovered"),
        F.count_if(~is_label).alias("n_pred"), F.max("_conf").alias("max_pred_conf"),
        F.count_if(~is_label & (F.col("_conf") >= high_conf) & F.col("best").isNull()).alias("confident_fps"),
        F.coalesce(F.sum(F.when(is_label, F.col("_area"))), F.lit(0)).alias("_left"), F.coalesce(F.sum("_area"), F.lit(0)).alias("_all"),
        F.coalesce(F.sum("_shared"), F.lit(0)).alias("_met"), F.coalesce(F.max("_same"), F.lit(False)).alias("_piled")))
    piled = blocks.select(tile, is_label.alias("_label"), "y0", "y1", "x0", "x1").join(per_tile.where("_piled").select(tile), tile, "left_semi")
    return per_tile.join(block_sums(piled, tile, "_label").drop("left"), tile, "left").select(
        tile, "n_label_polys", "label_polys_uncovered", "n_pred", "max_pred_conf", "confident_fps", "_left",
        F.coalesce("both", "_met").alias("_both"), F.coalesce("either", F.col("_all") - F.col("_met")).alias("_either"))


def bucket_shares(tiles: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Counts and percentages per bucket."""
    counts = tiles.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def review_queue(scored: DataFrame, log: DataFrame, min_score: int = 1, top: int = 50) -> DataFrame:
    """Unseen tiles with enough disagreement, the strongest first."""
    from panelspark.sources.scans import unseen

    return unseen(scored.where(F.col("disagreement_score") >= min_score), log).orderBy(
        F.desc("disagreement_score"), "tile_id").limit(top)


def replay_decisions(labels: DataFrame, log: DataFrame) -> DataFrame:
    """Labels after all decisions on their tile, in order of time.

    Removals add up, and an index (one-based) counts the polygons that are left at that point; keeping or flagging a
    tile brings nothing back. A tile is flagged if its last decision says so. One tile's decisions and polygon numbers
    are folded in one row, as the label file of a tile is.
    """
    decided = log.where(F.col("action").isin("keep", "remove", "remove_all", "flag_for_reannotation"))
    flagged = decided.groupBy("tile_id").agg(F.max_by("action", F.struct("ts", "action")).alias("_last")).where(
        "_last = 'flag_for_reannotation'").select("tile_id", F.lit(True).alias("_f"))
    steps = decided.where(F.col("action").isin("remove", "remove_all")).groupBy("tile_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "action", "removed_indices"))).alias("_steps"))
    numbers = labels.join(steps.select("tile_id"), "tile_id", "left_semi").groupBy("tile_id").agg(F.array_sort(F.collect_set("poly_no")).alias("_all"))
    left = F.expr("""aggregate(_steps, _all, (kept, s) -> CASE WHEN s.action = 'remove_all' THEN slice(kept, 1, 0)
        ELSE filter(kept, (p, i) -> NOT array_contains(transform(split(coalesce(s.removed_indices, ''), ';'), v -> coalesce(try_cast(v AS INT), 0)), i + 1)) END)""")
    gone = numbers.join(steps, "tile_id").select("tile_id", F.explode(F.array_except("_all", left)).alias("poly_no"))
    kept = labels.join(gone, ["tile_id", "poly_no"], "left_anti")
    return kept.join(flagged, "tile_id", "left").withColumn("flagged", F.coalesce("_f", F.lit(False))).drop("_f")


def images_by_polygons(meta: DataFrame, first: Sequence[str], order: str, min_polygons: int = 0) -> DataFrame:
    """Polygons per image with the first row's attributes (in input order)."""
    out = meta.groupBy("image_name").agg(
        F.count("polygon_id").alias("polygons"), F.min_by(F.struct(*first), order).alias("_f"))
    return out.where(F.col("polygons") >= min_polygons).select("image_name", "polygons", "_f.*")


def top_images(images: DataFrame, limit: int = 0) -> DataFrame:
    """O05."""
    ranked = images.orderBy(F.desc("polygons"), "image_name")
    return ranked.limit(limit) if limit else ranked


def first_per_split(tiles: DataFrame, n: int, order: str = "name") -> DataFrame:
    """The first N tiles of each split; ranks are cut before the shuffle, so a split never gathers whole."""
    w = W.partitionBy("split").orderBy(order)
    return tiles.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def cloud_fraction(pixels: DataFrame, keys: Sequence[str], tile: int = 640) -> DataFrame:
    """Share of cloud or shadow pixels per tile."""
    hit = ((F.col("cloud") > 0) | (F.col("shadow") > 0)).cast("int")
    return pixels.groupBy(*keys, F.floor(F.col("x") / tile).alias("tile_x"), F.floor(F.col("y") / tile).alias("tile_y")).agg(
        F.avg(hit).alias("cloud_fraction"))


def pixel_area_m2(df: DataFrame, area: str, domain: str, resolution: dict[str, float]) -> DataFrame:
    """Pixel area to square metres by the ground resolution of the domain."""
    gsd = F.lit(None).cast("double")
    for name, r in resolution.items():
        gsd = F.when(F.col(domain) == name, F.lit(r)).otherwise(gsd)
    return df.withColumn("area_m2", F.col(area) * gsd * gsd)
